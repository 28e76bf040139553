import io
import zipfile

import pytest
from pyspark.sql import functions as F

from tests.pages import SAMPLE, SAMPLE_SIZE, images_of, words_of
from tidemark.plans import batch, rollup
from tidemark.sources import intake, sheet, sinks
from tidemark.streaming import intake as stream


def workbook(rows, shared=True):
    strings, cells = [], []
    for r, row in enumerate(rows, 1):
        out = []
        for k, v in enumerate(row):
            ref = f"{chr(65 + k)}{r}"
            if v is None:
                continue
            if isinstance(v, str) and shared:
                strings.append(v)
                out.append(f'<c r="{ref}" t="s"><v>{len(strings) - 1}</v></c>')
            elif isinstance(v, str):
                out.append(f'<c r="{ref}" t="inlineStr"><is><t>{v}</t></is></c>')
            else:
                out.append(f'<c r="{ref}"><v>{v}</v></c>')
        cells.append(f'<row r="{r}">{"".join(out)}</row>')
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="S" sheetId="1" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {ns}><sheetData>{''.join(cells)}</sheetData></worksheet>")
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}>{''.join(f'<si><t>{s}</t></si>' for s in strings)}</sst>")
    return buffer.getvalue()


def save(tmp_path, rows, **how):
    path = tmp_path / "sheet.xlsx"
    path.write_bytes(workbook(rows, **how))
    return str(path)


def kept(pair):
    good, bad = pair
    return sorted((r["row_number"], r["id"], r["weight"]) for r in good.collect()), sorted((r["row_number"], r["message"]) for r in bad.collect())


@pytest.mark.parametrize("shared", [True, False])
def test_workbook(spark, tmp_path, shared):
    path = save(tmp_path, [["LR", "New Weight"], [307869128, 425], ["307775718 ", "900"], [None, 5], ["x", "abc"], ["x", "7"], ["x", 8], ["blank"], ["hex", "0x10"]], shared=shared)
    rows = sheet.workbook_rows(spark, path)
    good, bad = kept(sheet.mapping(rows))
    assert good == [(2, "307869128", 425.0), (3, "307775718", 900.0), (6, "x", 7.0), (8, "blank", 0.0), (9, "hex", 16.0)]
    assert bad == [(5, 'Row 5: weight "abc" is not numeric, skipped'), (7, 'Row 7: duplicate ID "x", keeping first occurrence')]
    from tidemark.config import IntakeConfig

    good, bad = kept(sheet.mapping(rows, IntakeConfig(blank_weight_is_zero=False)))
    assert all(i != "blank" for _, i, _ in good) and len(bad) == 3
    sheet.register(spark)
    assert spark.read.format("workbook").load(path).count() == rows.count()


def test_headers(spark, tmp_path):
    assert sheet.header_columns(["foo", "AWB no", "Weight (kg)", "weight 2"]) == (1, 2)
    assert sheet.header_columns(["ID weight"]) == (0, 0)
    for names in (["Foo", "Bar"], ["grid", "weight"], ["shipment_id", "weight"], []):
        with pytest.raises(ValueError, match="ID.*Weight"):
            sheet.header_columns(names)
    path = tmp_path / "s.csv"
    path.write_text('Shipment ID,Weight\n1,2.5\n2,\n"3",x\n')
    assert kept(sheet.mapping(sheet.csv_rows(spark, str(path))))[0] == [(2, "1", 2.5), (3, "2", 0.0)]


def test_whole_job(spark, tmp_path):
    other = [("111111111", 90, 500, 20, 700, 60), ("ACTUAL", 90, 200, 300, 270, 320), ("CHARGED", 90, 320, 300, 400, 320), ("12.5", 90, 205, 350, 250, 362)]
    bare = [("222222222", 90, 500, 20, 700, 60)]
    pages = {"a": SAMPLE, "b": other, "c": [("999999999", 90, 500, 20, 700, 60)], "d": bare, "e": SAMPLE}
    sizes = {k: (1000, 1000) for k in "bcd"} | {"a": SAMPLE_SIZE, "e": SAMPLE_SIZE, "f": (1000, 1000, "no words.png")}
    rows = sheet.workbook_rows(spark, save(tmp_path, [["ID", "Weight"], ["307775718", 900], ["111111111", 5], ["222222222", 7.25]]))
    job = batch.reconcile_batch(words_of(spark, pages), images_of(spark, sizes), rows)
    got = {r["image_id"]: r for r in job.results.collect()}
    assert {k: r["status"] for k, r in got.items()} == {"a": "ok", "b": "partial_weight_detection" if len(got["b"]["regions"]) < 2 else "ok", "c": "unmatched", "d": "id_matched_no_weight_region", "e": "ok", "f": "unmatched"}
    assert got["a"]["output_name"] == "307775718.jpg" and got["e"]["output_name"] == "307775718_2.jpg" and got["f"]["output_name"] == "no words.png"
    assert got["c"]["shipment_id"] == "999999999" and got["c"]["shipment_id_source"] == "image_header_fragments"
    fixes = sorted((r["image_id"], r["kind"], r["original_text"], r["new_text"], r["differs"]) for r in job.corrections.filter("image_id = 'a'").collect())
    assert fixes == [("a", "actual", "802.91", "900.00", True), ("a", "charged", "802.91", "900.00", True)]
    counts = job.counts.first()
    assert counts["processed_files"] == 6 and counts["matched_files"] + counts["unmatched_files"] == 6


def test_one_bad_page_does_not_fail_the_batch(spark):
    from tidemark.operators import reconcile

    pages = {"a": SAMPLE, "x": SAMPLE}
    sizes = images_of(spark, {"a": SAMPLE_SIZE, "x": SAMPLE_SIZE}).withColumn("height", F.when(F.col("image_id") == "x", F.lit(None).cast("int")).otherwise(F.col("height")))
    rasters = spark.createDataFrame([("x", b"123", 2)], "image_id string, grey binary, raster_width int")
    matches = spark.createDataFrame([("a",), ("x",)], "image_id string")
    got = {r["image_id"]: r["status"] for r in reconcile.settle_pages(words_of(spark, pages), sizes, matches, rasters).collect()}
    assert got == {"a": "ok", "x": "error"}


def test_rollups(spark):
    done = spark.createDataFrame([("j", "ok"), ("j", "error"), ("j", None), ("k", "ok")], "job_id string, status string")
    assert {r["job_id"]: tuple(r)[1:] for r in rollup.rollup(done).collect()} == {"j": (3, 1, 2), "k": (1, 1, 0)}
    assert [rollup.shown(done, w).count() for w in ("all", "ok", "error", "review")] == [4, 2, 1, 1]
    jobs = spark.sql("select 'j' job_id, 3 total_files, timestamp'2026-01-01 00:00:00' created_at, cast(null as timestamp) started_at, timestamp'2026-01-01 00:00:02' completed_at, cast(null as string) error")
    row = rollup.job_table(jobs.withColumn("started_at", F.expr("timestamp'2026-01-01 00:00:01'")), done).first()
    assert row["status"] == "completed" and row["duration_ms"] == 1000 and row["zip_ready"]
    assert rollup.job_table(jobs, done).first()["status"] == "queued" and rollup.durations(jobs).first()["duration_ms"] == 2000


def test_files_words_and_sinks(spark, tmp_path):
    png = bytes.fromhex("89504e470d0a1a0a0000000d49484452") + (640).to_bytes(4, "big") + (480).to_bytes(4, "big") + b"rest"
    (tmp_path / "in" / "sub").mkdir(parents=True)
    for name in ("in/a.png", "in/sub/a.png", "in/b.txt", "in/c.JPG"):
        (tmp_path / name).write_bytes(png)
    files = intake.image_files(spark, str(tmp_path / "in"))
    assert sorted(r["filename"] for r in files.collect()) == ["a.png", "a.png", "c.JPG"] and files.select("image_id").distinct().count() == 3
    assert not intake.too_many(files)
    meta = intake.image_meta(files).collect()
    assert {(r["width"], r["height"]) for r in meta} == {(640, 480)}
    sizes = files.select("image_id", F.lit(10).alias("width"), F.lit(20).alias("height"), F.lit(6).alias("orientation"))
    assert {(r["width"], r["height"]) for r in intake.with_sizes(intake.image_meta(files), sizes).collect()} == {(20, 10)}

    def make():
        def read(content):
            if len(content) < 3:
                raise ValueError("short")
            return [("12", 90.0, 0, 0, 1, 1), ("34", 80.0, 2, 0, 3, 1)]

        return read

    words = intake.read_words(files, make)
    assert words.count() == 6
    merged = intake.merge_passes([words, words.withColumn("text", F.when(F.col("word_ord") == 1, "35").otherwise(F.col("text")))])
    assert merged.count() == 9
    nested = spark.sql("select 'p' image_id, array(named_struct('paragraphs', array(named_struct('lines', array(named_struct('words', array(named_struct('text','x','confidence',1.0D,'bbox',named_struct('x0',0D,'y0',0D,'x1',1D,'y1',1D)), named_struct('text','y','confidence',1.0D,'bbox',named_struct('x0',0D,'y0',0D,'x1',1D,'y1',1D))))))))) blocks")
    assert [(r["word_ord"], r["text"]) for r in intake.flatten_blocks(nested).orderBy("word_ord").collect()] == [(0, "x"), (1, "y")]
    done = spark.createDataFrame([("j", "a", "a.png", "1/2", "ok"), ("j", "b", "b.png", None, "error")], "job_id string, image_id string, filename string, shipment_id string, status string")
    named = sinks.output_names(done)
    assert sorted(r["output_name"] for r in named.collect()) == ["1_2.png", "b.png"]
    wanted = spark.createDataFrame([("x/1_2.png",), ("nope",)], "output_name string")
    assert [r["image_id"] for r in sinks.selected(named, wanted).collect()] == ["a"]
    sinks.write_results(done, str(tmp_path / "out"))
    assert sinks.job(sinks.read_results(spark, str(tmp_path / "out")), "j").count() == 2
    assert sinks.zip_files([str(tmp_path / "in/a.png")], str(tmp_path / "z.zip")) > 0


def test_stream_gives_what_the_batch_gives(spark, tmp_path):
    done = spark.createDataFrame([("j", "ok"), ("j", "error"), ("k", "ok")], "job_id string, status string")
    done.repartition(3).write.json(str(tmp_path / "in"))
    source = stream.read_stream(spark, str(tmp_path / "in"), "job_id string, status string", per_trigger=1)
    stream.run_available(source, lambda df: df.filter("status = 'ok'"), str(tmp_path / "out"), str(tmp_path / "c1")).awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2
    stream.running_counts(source, "counts", str(tmp_path / "c2")).awaitTermination(60)
    assert sorted(map(tuple, spark.table("counts").collect())) == sorted(map(tuple, rollup.rollup(done).collect()))


def jpeg(width, height, orientation=None, order="big"):
    """The headers of a JPEG file: an Exif part if an orientation is given, a table, the frame."""
    out = b"\xff\xd8"
    if orientation:
        mark = b"MM" if order == "big" else b"II"
        entry = (0x0112).to_bytes(2, order) + (3).to_bytes(2, order) + (1).to_bytes(4, order) + orientation.to_bytes(2, order) + b"\0\0"
        body = b"Exif\0\0" + mark + (42).to_bytes(2, order) + (8).to_bytes(4, order) + (1).to_bytes(2, order) + entry + b"\0\0\0\0"
        out += b"\xff\xe1" + (len(body) + 2).to_bytes(2, "big") + body
    out += b"\xff\xc4\x00\x04\x00\x00" + b"\xff\xc2\x00\x0b\x08" + height.to_bytes(2, "big") + width.to_bytes(2, "big") + b"\x01\x01\x11\x00"
    return out


def test_jpeg_sizes_and_orientation(spark):
    files = spark.createDataFrame([("a", "a.jpg", bytearray(jpeg(640, 480))), ("b", "b.jpg", bytearray(jpeg(640, 480, 6))), ("c", "c.jpg", bytearray(jpeg(640, 480, 3, "little"))), ("d", "d.jpg", bytearray(b"text")), ("e", "e.jpg", None)], "image_id string, filename string, content binary")
    got = {r["image_id"]: (r["width"], r["height"], r["orientation"]) for r in intake.image_meta(files).collect()}
    assert got == {"a": (640, 480, 1), "b": (480, 640, 6), "c": (640, 480, 3), "d": (None, None, 1), "e": (None, None, 1)}


def test_quoted_csv_and_several_sheets(spark, tmp_path):
    (tmp_path / "a.csv").write_text('Shipment ID,Note,Weight\n7,"x, y",2.5\n8,"two\nlines",3\n')
    rows = sheet.csv_rows(spark, str(tmp_path / "a.csv"))
    assert kept(sheet.mapping(rows))[0] == [(2, "7", 2.5), (3, "8", 3.0)]
    (tmp_path / "b.csv").write_text("ID,Weight\n7,1\n")
    with pytest.raises(ValueError, match="more than one sheet"):
        sheet.mapping(sheet.csv_rows(spark, str(tmp_path / "*.csv")))


def test_names_never_collide(spark):
    rows = [("j", f"{k:02d}", "p.png", i, "ok") for k, i in enumerate(["A", "A_2", "A", "A", "B", "B", "A_2", None, None])]
    named = sinks.output_names(spark.createDataFrame(rows, "job_id string, image_id string, filename string, shipment_id string, status string"))
    assert [r["output_name"] for r in named.orderBy("image_id").collect()] == ["A.png", "A_2.png", "A_3.png", "A_4.png", "B.png", "B_2.png", "A_2_2.png", "p.png", "p_2.png"]


def test_copies_of_inputs(spark, tmp_path):
    files = spark.createDataFrame([("a", bytearray(b"one")), ("b", bytearray(b"two!")), ("c", bytearray(b""))], "image_id string, content binary")
    names = spark.createDataFrame([("a", "x/a.jpg"), ("b", "b.jpg")], "image_id string, output_name string")
    done = sinks.copy_files(files, names, f"file://{tmp_path}/review").collect()
    assert sorted(map(tuple, done)) == [("a.jpg", 3), ("b.jpg", 4)]
    assert (tmp_path / "review" / "b.jpg").read_bytes() == b"two!"


def test_a_job_reads_each_page_once(spark, monkeypatch):
    from tests.pages import SAMPLE, SAMPLE_SIZE, images_of, mapping_of, words_of
    from tidemark.operators import identify, reconcile
    seen = []
    for module in (identify, reconcile):
        monkeypatch.setattr(module, "by_page", lambda *a, f=module.by_page, **k: seen.append(a) or f(*a, **k))
    done = reconcile.results(words_of(spark, {"a": SAMPLE}), images_of(spark, {"a": SAMPLE_SIZE, "b": (1000, 700)}), mapping_of(spark, [("307775718", 1)]))
    assert len(seen) == 1
    assert "MapInArrow" not in done._jdf.queryExecution().executedPlan().toString()
    assert {r["image_id"]: r["matched_id"] for r in done.collect()} == {"a": "307775718", "b": None}


def test_a_choice_among_passes_has_a_small_plan(spark):
    from tests.pages import SAMPLE, SAMPLE_SIZE, images_of, mapping_of, words_of
    from tidemark.plans import passes
    words = words_of(spark, {"a": SAMPLE})
    chosen = passes.choose_pass([words.limit(0), words, words], images_of(spark, {"a": SAMPLE_SIZE}), mapping_of(spark, [("307775718", 1)]))
    plan = chosen._jdf.queryExecution().optimizedPlan().toString()
    # the plan doesn't grow with the number of passes, and holds no page's pass
    assert plan.count("Join") <= 10 and "MapInArrow" not in plan
    assert [(r["image_id"], r["attempt"]) for r in chosen.collect()] == [("a", 1)]
