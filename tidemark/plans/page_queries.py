"""Queries for the page rules, the raster rules and the sources, each with its SQL.

Pages are made from orders in a number of kinds of damage, so that each rule decides some of them; rasters are
made from suppliers. The SQL says what each kind should come to.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.config import IntakeConfig
from tidemark.functions import numbers, text
from tidemark.operators import identify, layout, raster, reconcile
from tidemark.operators.boxes import Box, Region
from tidemark.operators.pages import by_page
from tidemark.plans import passes, rollup
from tidemark.sources import intake, sheet, sinks

#: Words of a kind of page: text ("$" is the page's price, "$1" the price with a 1 before it), x0, y0, x1, y1, confidence.
ACTUAL, CHARGED = ("ACTUAL", 200, 300, 270, 320, 90), ("CHARGED", 320, 300, 400, 320, 90)
LEFT, RIGHT = ("$", 205, 350, 255, 365, 90), ("$", 325, 350, 375, 365, 90)
KINDS: list[tuple[str, list[tuple[str, int, int, int, int, int]]]] = [
    ("plain", [ACTUAL, CHARGED, LEFT, RIGHT]),
    ("no id", [ACTUAL, CHARGED, LEFT, RIGHT]),
    ("bare", []),
    ("no values", [ACTUAL, CHARGED]),
    ("one value", [ACTUAL, CHARGED, LEFT]),
    ("charged only", [CHARGED, RIGHT, ("SAID", 440, 300, 480, 320, 90)]),
    ("goods", [ACTUAL, LEFT, ("SAID", 330, 300, 370, 320, 90), ("CONTAIN", 380, 300, 450, 320, 90)]),
    ("twin", [ACTUAL, LEFT, RIGHT]),
    ("smudged twin", [ACTUAL, LEFT, ("$1", 322, 350, 375, 365, 20)]),
    ("crammed", [ACTUAL, CHARGED, LEFT, ("$", 270, 350, 320, 365, 90)]),
    ("halves", [("WEI", 200, 300, 230, 320, 90), ("GHT", 234, 300, 270, 320, 90), LEFT]),
    ("tall", [ACTUAL, ("$", 205, 350, 255, 390, 90)]),
    ("digit", [ACTUAL, ("5", 205, 350, 215, 365, 90)]),
    ("misplaced", [ACTUAL, CHARGED, ("$", 150, 350, 260, 365, 90), RIGHT]),
    ("before goods", [("WEIGHT", 200, 300, 270, 320, 90), LEFT, ("SAID", 420, 300, 460, 320, 90), ("$", 260, 352, 310, 366, 90)]),
    ("error", [ACTUAL, CHARGED, LEFT, RIGHT]),
]


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")



def damaged_pages(spark: SparkSession, d: str, turn: bool = True) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(words, images, mapping, rasters): every order a page of one kind, in turn, or all plain ones."""
    kind = F.col("o_orderkey") % len(KINDS) if turn else F.lit(0)
    o = _t(spark, d, "orders").select("o_orderkey", "o_totalprice", kind.cast("int").alias("kind"))
    key = (F.col("o_orderkey") + 300_000_000).cast("string")
    price = (F.col("o_totalprice") % 900 + 10).cast("decimal(7,2)").cast("string")
    word = "struct<word_ord:int,text:string,confidence:double,bbox:struct<x0:double,y0:double,x1:double,y1:double>>"

    def shown(k: int, t: str, x0: int, y0: int, x1: int, y1: int, sure: int) -> Column:
        read = F.concat(F.lit("1"), price) if t == "$1" else price if t == "$" else F.lit(t)
        return F.struct(F.lit(k).alias("word_ord"), read.alias("text"), F.lit(float(sure)).alias("confidence"), F.struct(*[F.lit(float(v)).alias(n) for n, v in zip(("x0", "y0", "x1", "y1"), (x0, y0, x1, y1))]).alias("bbox")).cast(word)

    def page(name: str, words: list) -> Column:
        head = F.struct(F.lit(0).alias("word_ord"), (F.lit("unread") if name == "no id" else key).alias("text"), F.lit(90.0).alias("confidence"), F.struct(*[F.lit(v).alias(n) for n, v in zip(("x0", "y0", "x1", "y1"), (500.0, 30.0, 640.0, 60.0))]).alias("bbox")).cast(word)
        return F.array(head, *[shown(k, *w) for k, w in enumerate(words, 1)])

    words = F.lit(None)
    for k, (name, own) in enumerate(KINDS):
        words = F.when(F.col("kind") == k, page(name, own)).otherwise(words)
    image = F.concat(F.lit("p"), F.col("o_orderkey").cast("string"))
    pages = o.select(image.alias("image_id"), F.lit(0).alias("rotation"), F.lit("base").alias("pass"), F.explode(words).alias("w")).select("image_id", "rotation", "pass", "w.*")
    images = o.select(image.alias("image_id"), F.concat(image, F.lit(".jpg")).alias("filename"), F.lit(1000).alias("width"), F.lit(1000).alias("height"), F.lit(1).alias("orientation"))
    mapping = o.select(F.col("o_orderkey").cast("int").alias("row_number"), key.alias("id"), F.round(F.col("o_totalprice") / 1000, 1).alias("weight"))
    # a raster whose bytes don't make up whole rows
    broken = o.filter(F.col("kind") == [n for n, _ in KINDS].index("error")).select(image.alias("image_id"), F.lit(b"123").alias("grey"), F.lit(2).alias("raster_width"))
    return pages, images, mapping, broken


def page_statuses(spark, d):
    """Of each kind of page the status, the values found (kind, left edge, ? if not read), and the rules that decided."""
    pages, images, mapping, rasters = damaged_pages(spark, d)
    done = reconcile.results(pages, images, mapping, rasters)
    kind = F.element_at(F.array(*[F.lit(n) for n, _ in KINDS]), (F.substring("image_id", 2, 20).cast("long") % len(KINDS) + 1).cast("int"))
    shape = F.array_join(F.transform("regions", lambda r: F.concat(F.coalesce(r["kind"], F.lit("-")), F.lit("@"), F.round(r["bbox"]["x0"]).cast("int").cast("string"), F.when(r["original_text"] == "", "?").otherwise(""))), " ")
    return done.select(kind.alias("kind"), "status", "expected", shape.alias("found"), F.array_join("trail", " ").alias("trail")).groupBy("kind", "status", "expected", "found", "trail").agg(F.count("*").alias("n"))


def number_pieces(spark, d):
    """Prices read in pieces with a sign before them, put together for each value cell."""
    pages, images, _, _ = damaged_pages(spark, d)
    value = pages.filter("bbox.y0 = 350 and bbox.x0 = 205 and bbox.y1 = 365")
    more = value.select("image_id", "rotation", "pass", F.explode(F.array(*[
        F.struct(F.lit(50 + k).alias("word_ord"), F.lit(t).alias("text"), F.lit(50.0).alias("confidence"), F.struct(F.lit(x0).alias("x0"), F.lit(351.0).alias("y0"), F.lit(x1).alias("x1"), F.lit(364.0).alias("y1")).alias("bbox"))
        for k, (t, x0, x1) in enumerate((("£", 194.0, 203.0), (":7", 257.0, 266.0), ("kg", 268.0, 280.0), ("7", 600.0, 610.0)))])).alias("w")).select("image_id", "rotation", "pass", "w.*")
    found = layout.fragments(pages.unionByName(more), images).filter("size(signs) > 0")
    return found.select("image_id", F.array_join("pieces", " ").alias("pieces"), F.array_join("signs", " ").alias("signs"))


def own_ids(spark, d):
    """The number in each page's header that looks most like its id."""
    pages, images, _, _ = damaged_pages(spark, d)
    return identify.header_ids(pages, images).select("image_id", "id", "score", "source")


def numbers_shown(spark, d):
    """Numbers of each page for review, in the order that they are shown in."""
    pages, _, _, _ = damaged_pages(spark, d)
    return identify.shown_numbers(pages.filter("bbox.x0 >= 500 or bbox.x0 = 205")).select("image_id", "number", "place")


def file_names(spark, d):
    """Ids in file names: the longest run of digits that is known, the first on ties."""
    o = _t(spark, d, "orders")
    key = F.col("o_orderkey") + 300_000_000
    images = o.select(F.col("o_orderkey").cast("string").alias("image_id"), F.concat(F.lit("scan-"), (F.col("o_orderkey") + 1_000_000).cast("string"), F.lit("_"), key.cast("string"), F.lit("_"), (key + 1).cast("string"), F.lit(".jpg")).alias("filename"))
    mapping = o.select(key.cast("string").alias("id"))
    return identify.filename_matches(images, mapping).select("image_id", "id", "source")


def best_attempts(spark, d):
    """Line items as attempts to read an order: the best one by match, distance, regions and anchors."""
    i = _t(spark, d, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("attempt"), F.when(F.col("l_tax") > 0.02, (F.col("l_partkey") % 2).cast("int")).alias("distance"), (F.col("l_quantity") % 3).cast("int").alias("regions"), (F.col("l_suppkey") % 3).cast("int").alias("anchors"))
    return identify.better_analysis(i, "l_orderkey").select("l_orderkey", "attempt")


def merged_passes(spark, d):
    """Two passes over the same pages, the second one shifted by half a pixel or a whole one: words that are new stay."""
    pages, _, _, _ = damaged_pages(spark, d)
    by = F.when(F.col("word_ord") % 2 == 0, 0.25).otherwise(1.0)
    again = pages.withColumn("bbox", F.struct(*[(F.col(f"bbox.{n}") + by).alias(n) for n in ("x0", "y0", "x1", "y1")]))
    return intake.merge_passes([pages, again]).groupBy("image_id").agg(F.count("*").alias("words"))


def raster_pages(spark, d):
    """Suppliers as rasters: what rules, lines of print, columns and cells are found where they were drawn."""
    s = _t(spark, d, "supplier").select(F.col("s_suppkey").cast("string").alias("image_id"), F.lit(0).alias("word_ord"), "s_suppkey")

    def rule(rows: list[dict]) -> list[tuple]:
        k = rows[0]["s_suppkey"]
        a, step, y = 100 + k % 7, 60 + k % 5, 158 + k % 11
        grey = np.full((400, 600), 250 - k % 20, np.uint8)
        # a shadow over the lower part, four rules of one pixel, and a number in the second column
        grey[200:] -= np.uint8(15)
        for n in range(3):
            grey[110:300, a + n * step] = 20
        grey[110:300, a + 2 * step + 30] = 20
        x = a + step + 8
        for n in range(4):
            grey[y : y + 7, x + 9 * n : x + 9 * n + 4] = 30
            grey[y + 4 : y + 10, x + 9 * n + 4 : x + 9 * n + 7] = 30
        rules = raster.vertical_rules(grey, 100, 310, 0, 600)
        columns = raster.weight_columns(rules, 600)
        bands = raster.ink_bands(grey, (a + step, a + 2 * step), 150)
        box = raster.ink_box(grey, bands[0]) if bands else None
        value = Region(Box(x, y, x + 25, y + 10), "12.5", "CHARGED WEIGHT", "charged")
        partner = raster.sibling_cell(grey, value)
        single = raster.sibling_cell(grey, value._replace(kind="actual"))
        table = raster.cells_of_table(grey, [])
        held = raster.localise(grey, [value._replace(cell=(a + step, a + 2 * step))], [150.0])
        top = raster.rule_top(grey, a, 50, 350, 128)
        return [(
            k, [int(r.x) for r in rules], [int(v) for c in columns for v in c], len(bands), int(bands[0].top) if bands else None, int(bands[0].bottom) if bands else None, int(box.x0) if box else None, int(box.x1) if box else None,
            [int(v) for v in partner.cell] if partner else None, single is None, [r.kind for r in table], int(held[0].box.x0), int(held[0].box.y0), top, raster.template_kind(grey),
        )]

    schema = "s_suppkey long, rules array<int>, columns array<int>, bands int, band_top int, band_bottom int, ink_x0 int, ink_x1 int, sibling array<int>, no_right_sibling boolean, cells array<string>, held_x0 int, held_y0 int, rule_top int, template string"
    out = by_page(s, rule, schema)
    return out.select("s_suppkey", *[F.array_join(F.col(c).cast("array<string>"), ",").alias(c) for c in ("rules", "columns", "sibling", "cells")], "bands", "band_top", "band_bottom", "ink_x0", "ink_x1", "no_right_sibling", "held_x0", "held_y0", "rule_top", "template")


def sheet_rows(spark, d):
    """A sheet of orders: ids by customer, so most repeat, some weights blank or no numbers; what is kept and what is said."""
    o = _t(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    weight = F.when(F.col("o_orderkey") % 9 == 0, F.lit(None).cast("string")).when(F.col("o_orderkey") % 11 == 0, F.lit("n/a")).when(F.col("o_orderkey") % 13 == 0, F.lit("0x1F")).otherwise(F.col("o_totalprice").cast("decimal(12,2)").cast("string"))
    body = o.select((F.col("o_orderkey") + 2).cast("int").alias("row_number"), F.array(F.lit("x"), F.concat(F.lit(" "), F.col("o_custkey").cast("string")), weight).alias("cells"))
    head = spark.createDataFrame([(1, ["No", "Shipment ID", "New Weight"])], "row_number int, cells array<string>")
    return head.unionByName(body)


def sheet_kept(spark, d):
    return sheet.mapping(sheet_rows(spark, d))[0]


def sheet_warnings(spark, d):
    return sheet.mapping(sheet_rows(spark, d), IntakeConfig(blank_weight_is_zero=False))[1].select("row_number", "message")


def formatted(spark, d):
    """How durations, sizes, statuses and weights are shown."""
    o = _t(spark, d, "orders")
    ms = F.floor(F.col("o_totalprice") * 2).cast("long")
    return o.select("o_orderkey", numbers.duration_text(ms).alias("duration"), numbers.bytes_text(F.col("o_orderkey") * 77).alias("size"), numbers.status_text(F.lower(F.substring("o_orderpriority", 3, 20))).alias("status"),
                    numbers.format_weight(F.floor("o_totalprice") / 100, F.lit(3)).alias("fixed"), numbers.format_weight(F.floor(F.col("o_totalprice") / 1000) / 4, F.lit(0)).alias("short"))


def page_numbers(spark, d):
    """Header scores, enlargements, boxes put back on the page, and which pages may lie on their side."""
    o = _t(spark, d, "orders").withColumn("w", (F.col("o_orderkey") % 5000 + 100).cast("double")).withColumn("h", (F.col("o_custkey") % 5000 + 100).cast("double"))
    box = F.struct(*[(F.col("o_orderkey") % 100 + k).cast("double").alias(n) for k, n in enumerate(("x0", "y0", "x1", "y1"))])
    back = numbers.to_page(box, F.lit(2.0), F.lit(10.0), F.lit(20.0))
    score = numbers.header_score(F.lit(50.0), F.col("w") / 3, F.col("h") / 7, F.col("o_orderkey") % 30, F.length(F.col("o_orderkey").cast("string")), F.col("w"), F.col("h"))
    return o.select("o_orderkey", score.alias("score"), F.round(numbers.ocr_scale(F.col("w"), F.col("h"), F.lit(4.0)), 6).alias("scale"), back["x0"].alias("x0"), back["y1"].alias("y1"), numbers.try_quarter_turns(F.col("w"), F.col("h")).alias("turns"))


def job_states(spark, d):
    """Customers as jobs over their orders: counts, state and duration; and how many are up for review."""
    done = _t(spark, d, "orders").select(F.col("o_custkey").alias("job_id"), F.when(F.col("o_orderstatus") == "F", "ok").when(F.col("o_orderstatus") == "O", "unmatched").otherwise("error").alias("status"))
    at = lambda n: F.timestamp_millis(F.lit(1_700_000_000_000) + F.col("c_custkey") * n)
    jobs = _t(spark, d, "customer").select(F.col("c_custkey").alias("job_id"), F.lit(10).alias("total_files"), at(1).alias("created_at"), F.when(F.col("c_custkey") % 3 > 0, at(2)).alias("started_at"), at(5).alias("completed_at"), F.when(F.col("c_custkey") % 17 == 0, "disk").alias("error"))
    table = rollup.job_table(jobs, done)
    review = rollup.shown(done, "review").groupBy("job_id").agg(F.count("*").alias("review"))
    return table.join(review, "job_id", "left").select("job_id", "processed_files", "matched_files", "status", "duration_ms", "zip_ready", F.coalesce("review", F.lit(0)).alias("review"))


def output_files(spark, d):
    """Orders as images named by customer, some of which have a name that another would get: all names differ, a request picks some."""
    o = _t(spark, d, "orders").select(F.lit("j").alias("job_id"), F.format_string("%09d", "o_orderkey").alias("image_id"), F.lit("a.png").alias("filename"),
                                      F.when(F.col("o_orderkey") % 50 == 0, F.concat(F.col("o_custkey").cast("string"), F.lit("_2"))).otherwise(F.col("o_custkey").cast("string")).alias("shipment_id"))
    named = sinks.output_names(o)
    asked = _t(spark, d, "customer").select(F.concat(F.lit("some/folder/"), F.col("c_custkey").cast("string"), F.lit("_2.png")).alias("output_name"))
    picked = sinks.selected(named, asked).agg(F.count("*").alias("picked"))
    return named.agg(F.count("*").alias("files"), F.countDistinct("output_name").alias("names")).crossJoin(F.broadcast(picked))  # one row each


def chosen_passes(spark, d):
    """Pages read twice, the second time after a quarter turn, which only portrait pages have: the pass to go on with."""
    pages, images, mapping, _ = damaged_pages(spark, d, turn=False)
    number = F.substring("image_id", 2, 20).cast("long")
    sides = images.withColumn("width", F.when(number % 3 == 0, 800).otherwise(1000))
    # the first pass read only one header of every fourth page
    poor = pages.filter((F.col("word_ord") == 2) | (number % 4 != 0))
    return passes.choose_pass([poor, pages], sides, mapping, turned=[1])


KIND_OF = "CASE o_orderkey % {n} {cases} END".format(n=len(KINDS), cases=" ".join(f"WHEN {k} THEN '{n}'" for k, (n, _) in enumerate(KINDS)))
_PAGES = f"SELECT o_orderkey AS k, 'p' || o_orderkey AS image_id, {KIND_OF} AS kind, (o_orderkey + 300000000)::VARCHAR AS id, (o_totalprice % 900 + 10)::DECIMAL(7,2)::VARCHAR AS price FROM orders"
#: What each kind of page comes to: status, values expected, values found, rules that decided.
OUTCOMES = [
    ("plain", "ok", 2, "actual@205 charged@325", "count_columns own_cell"),
    ("no id", "unmatched", 2, "actual@205 charged@325", "count_columns own_cell"),
    ("bare", "id_matched_no_weight_region", 1, "", ""),
    ("no values", "partial_weight_detection", 2, "", "count_columns"),
    ("one value", "ok", 2, "actual@205 charged@325?", "count_columns missing_partner own_cell sibling_geometry"),
    ("charged only", "ok", 2, "actual@210? charged@325", "actual_before_charged own_cell"),
    ("goods", "ok", 1, "actual@205", "inherit_cells own_cell"),
    ("twin", "ok", 2, "actual@205 charged@325", "aligned_decimals"),
    ("smudged twin", "ok", 2, "actual@205 charged@322", "aligned_decimals"),
    ("crammed", "ok", 2, "actual@205 charged@325", "count_columns spaced_like_headers own_cell"),
    ("halves", "id_matched_no_weight_region", 1, "", "off_headers"),
    ("tall", "ok", 1, "actual@205", "one_line_high"),
    ("digit", "id_matched_no_weight_region", 1, "", "enough_digits"),
    ("misplaced", "ok", 2, "actual@201? charged@322?", "count_columns spaced_like_headers under_own_header own_cell"),
    ("before goods", "ok", 1, "actual@260", "value_before_goods"),
    ("error", "error", None, "", ""),
]
_VALUES = ", ".join(f"('{k}', '{s}', {'NULL' if e is None else e}, '{f}', '{t}')" for k, s, e, f, t in OUTCOMES)
_WORDS = ", ".join(f"('{name}', {1 + len(own) + (len(own) + 1) // 2})" for name, own in KINDS)
_SHEET = """b AS (SELECT (o_orderkey + 2)::INT AS row_number, o_custkey::VARCHAR AS id,
    CASE WHEN o_orderkey % 9 = 0 THEN '' WHEN o_orderkey % 11 = 0 THEN 'n/a' WHEN o_orderkey % 13 = 0 THEN '0x1F' ELSE o_totalprice::DECIMAL(12,2)::VARCHAR END AS raw FROM orders),
    g AS (SELECT row_number AS r, id, raw, CASE raw WHEN '' THEN NULL WHEN 'n/a' THEN NULL WHEN '0x1F' THEN 31.0 ELSE raw::DOUBLE END AS weight FROM b)"""
SQL: dict[str, str] = {
    "q36_page_statuses": f"SELECT v.kind, v.status, v.expected::INT AS expected, v.found, v.trail, count(*) AS n FROM ({_PAGES}) p JOIN (VALUES {_VALUES}) v(kind, status, expected, found, trail) ON p.kind = v.kind GROUP BY ALL",
    "q37_number_pieces": f"SELECT image_id, CASE WHEN kind = 'digit' THEN '5' ELSE price || ' :7' END AS pieces, '£' AS signs FROM ({_PAGES}) WHERE kind NOT IN ('bare', 'no values', 'charged only', 'tall', 'misplaced')",
    "q38_own_ids": f"SELECT image_id, id, 178.0::DOUBLE AS score, 'image_header_fragments' AS source FROM ({_PAGES}) WHERE kind <> 'no id'",
    "q39_numbers_shown": f"""WITH p AS ({_PAGES}) SELECT image_id, id AS number, 1 AS place FROM p WHERE kind <> 'no id' UNION ALL
        SELECT image_id, replace(price, '.', ''), CASE WHEN kind = 'no id' THEN 1 ELSE 2 END FROM p WHERE kind NOT IN ('bare', 'no values', 'charged only', 'digit', 'misplaced')""",
    "q40_file_names": "SELECT o_orderkey::VARCHAR AS image_id, (o_orderkey + 300000000)::VARCHAR AS id, 'filename_exact_sheet_match' AS source FROM orders",
    "q41_best_attempts": """WITH i AS (SELECT l_orderkey, l_linenumber AS attempt, CASE WHEN l_tax > 0.02 THEN l_partkey % 2 END AS distance, (l_quantity % 3)::INT AS regions, l_suppkey % 3 AS anchors FROM lineitem)
        SELECT l_orderkey, attempt FROM i QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY (distance IS NULL)::INT, coalesce(distance, 99), regions DESC, anchors DESC, attempt) = 1""",
    "q42_merged_passes": f"SELECT image_id, v.words::BIGINT AS words FROM ({_PAGES}) p JOIN (VALUES {_WORDS}) v(kind, words) ON p.kind = v.kind",
    "q43_raster_pages": """WITH s AS (SELECT s_suppkey AS k, 100 + s_suppkey % 7 AS a, 60 + s_suppkey % 5 AS d, 158 + s_suppkey % 11 AS y FROM supplier)
        SELECT k AS s_suppkey, concat_ws(',', a, a + d, a + 2 * d, a + 2 * d + 30) AS rules, concat_ws(',', a, a + d, a + d, a + 2 * d) AS columns, concat_ws(',', a, a + d) AS sibling, 'actual,charged' AS cells, 1 AS bands,
          y::INT AS band_top, (y + 10)::INT AS band_bottom, (a + d + 6)::INT AS ink_x0, (a + d + 44)::INT AS ink_x1, true AS no_right_sibling, (a + d + 6)::INT AS held_x0, (y - 1)::INT AS held_y0, 110 AS rule_top, 'two' AS template FROM s""",
    "q44_sheet_kept": f"WITH {_SHEET} SELECT r AS row_number, id, CASE WHEN raw = '' THEN 0.0 ELSE weight END::DOUBLE AS weight FROM g WHERE raw <> 'n/a' QUALIFY row_number() OVER (PARTITION BY id ORDER BY r) = 1",
    "q45_sheet_warnings": f"""WITH {_SHEET} SELECT r AS row_number, printf('Row %d: weight "%s" is not numeric, skipped', r, raw) AS message FROM g WHERE weight IS NULL UNION ALL
        SELECT r, printf('Row %d: duplicate ID "%s", keeping first occurrence', r, id) FROM (SELECT * FROM g WHERE weight IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY r) > 1)""",
    "q46_formatted": r"""WITH o AS (SELECT *, floor(o_totalprice * 2)::BIGINT AS ms, o_orderkey * 77 AS b, floor(o_totalprice / 1000)::BIGINT / 4.0::DOUBLE AS quarter FROM orders)
        SELECT o_orderkey, CASE WHEN ms < 1000 THEN printf('%d ms', ms) WHEN ms < 60000 THEN printf('%.1f s', floor(ms / 100.0::DOUBLE + 0.5::DOUBLE) / 10) ELSE printf('%dm %02ds', ms // 60000, ms % 60000 // 1000) END AS duration,
          CASE WHEN b < 1024 THEN printf('%d B', b) WHEN b < 1048576 THEN printf('%.1f KB', floor(b * 10 / 1024.0::DOUBLE + 0.5::DOUBLE) / 10) ELSE printf('%.1f MB', floor(b * 10 / 1048576.0::DOUBLE + 0.5::DOUBLE) / 10) END AS size,
          CASE substr(o_orderpriority, 3) WHEN 'NOT SPECIFIED' THEN 'Not Specified' ELSE substr(o_orderpriority, 3, 1) || lower(substr(o_orderpriority, 4)) END AS status,
          printf('%.3f', floor(o_totalprice) / 100) AS fixed, regexp_replace(printf('%.2f', quarter), '\.?0+$', '') AS short FROM o""",
    "q47_page_numbers": """WITH o AS (SELECT o_orderkey AS k, (o_orderkey % 5000 + 100)::DOUBLE AS w, (o_custkey % 5000 + 100)::DOUBLE AS h FROM orders)
        SELECT k AS o_orderkey, (70 + least(15, k % 30) + CASE WHEN len(k::VARCHAR) BETWEEN 8 AND 10 THEN 18 ELSE 0 END)::DOUBLE AS score, round(greatest(1.0::DOUBLE, least(4.0::DOUBLE, 4800 / greatest(w, h), sqrt(16000000 / (w * h)))), 6) AS scale,
          (k % 100) / 2.0::DOUBLE + 10 AS x0, (k % 100 + 3) / 2.0::DOUBLE + 20 AS y1, h > w * 1.1::DOUBLE AS turns FROM o""",
    "q48_job_states": """WITH d AS (SELECT o_custkey, count(*) AS n, count(*) FILTER (WHERE o_orderstatus = 'F') AS ok, count(*) FILTER (WHERE o_orderstatus = 'O') AS review FROM orders GROUP BY 1),
        j AS (SELECT c_custkey AS c, coalesce(n, 0) AS n, coalesce(ok, 0) AS ok, coalesce(review, 0) AS review FROM customer LEFT JOIN d ON c_custkey = o_custkey),
        s AS (SELECT *, CASE WHEN c % 17 = 0 THEN 'failed' WHEN c % 3 = 0 THEN 'queued' WHEN n < 10 THEN 'processing' ELSE 'completed' END AS status FROM j)
        SELECT c AS job_id, n AS processed_files, ok AS matched_files, status, CASE WHEN c % 3 > 0 THEN 3 * c ELSE 4 * c END AS duration_ms, status = 'completed' AS zip_ready, review FROM s""",
    "q50_chosen_passes": "SELECT 'p' || o_orderkey AS image_id, CASE WHEN o_orderkey % 12 = 0 THEN 1 ELSE 0 END AS attempt FROM orders",
    "q49_output_files": """WITH n AS (SELECT o_custkey, count(*) FILTER (WHERE o_orderkey % 50 <> 0) AS own, count(*) FILTER (WHERE o_orderkey % 50 = 0) AS other FROM orders GROUP BY 1)
        SELECT (SELECT count(*) FROM orders) AS files, (SELECT count(*) FROM orders) AS names, count(*) AS picked FROM n JOIN customer ON c_custkey = o_custkey WHERE own >= 2 OR other >= 1""",
}
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "q36_page_statuses": page_statuses, "q37_number_pieces": number_pieces, "q38_own_ids": own_ids, "q39_numbers_shown": numbers_shown, "q40_file_names": file_names, "q41_best_attempts": best_attempts, "q42_merged_passes": merged_passes,
    "q43_raster_pages": raster_pages, "q44_sheet_kept": sheet_kept, "q45_sheet_warnings": sheet_warnings, "q46_formatted": formatted, "q47_page_numbers": page_numbers, "q48_job_states": job_states, "q49_output_files": output_files, "q50_chosen_passes": chosen_passes,
}
