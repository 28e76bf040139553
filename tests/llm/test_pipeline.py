import corpus_pipeline

SF = "/root/testdata/sf0.001"


def test_stages_follow_each_other(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    counts = [docs.count()]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == columns
        docs = spark.createDataFrame(out.collect(), out.schema)
        counts.append(docs.count())
    assert counts[1] < counts[0] and counts[2] < counts[1] and counts[3] <= counts[2] and counts[4] <= counts[3] and 0 < counts[5] <= counts[4]
    whole = corpus_pipeline.run(spark, SF)
    assert sorted(map(str, whole.collect())) == sorted(map(str, docs.collect()))


def test_mixing_gives_each_row_its_own_share(docs, spark):
    """Different texts under one id and under none, and equal rows."""
    data = [(k % 3 or None, f"t{k} " * (5 + k), f"s{k % 2}") for k in range(24)] + [(50, "same row of a text", "s0")] * 3
    frame = docs(data)
    got = corpus_pipeline.mixing(spark, frame, SF).collect()
    want = corpus_pipeline.mix(frame).filter("taken > 0").collect()
    name = lambda r: (str(r["doc_id"]), r["source"], r["size"], r["taken"])
    assert sorted(map(name, got)) == sorted(map(name, want))
    assert all(len(r["text"].split()) == r["size"] for r in got)


NAMES = ("_text_key", "_id", "_key", "_rows", "_quality_score", "_spans", "_n_removed", "size", "taken", "repeats", "key", "rows", "score", "c0")


def test_odd_rows_and_clashing_names_pass_every_stage(docs, odd, spark):
    """Null, empty, blank, long and repeated texts, a null id, and columns named as those made inside."""
    from pyspark.sql import functions as F

    frame = docs(odd)
    for n in NAMES:
        frame = frame.withColumn(n, F.lit(n))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, frame, SF)
        assert out.columns == frame.columns
        assert all(r[n] == n for r in out.collect() for n in NAMES)
    last = corpus_pipeline.mixing(spark, frame, SF)
    assert last.columns == ["doc_id", "text", "lang", "source", "size", "taken", "repeats"]
    assert sum(r["doc_id"] == 5 for r in last.collect()) <= 2


def test_empty_tables(docs, spark):
    empty = docs([])
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF).collect() == []


def test_stages_against_brute_force(docs, spark):
    """The near-duplicate, suffix-array and decontamination stages on a small table, each against all its pairs."""
    import random

    from tests.llm.test_near_dedup import brute as near_brute
    from tests.llm.test_suffix_dedup import brute as byte_brute

    rng = random.Random(3)
    words = [f"w{k}" for k in range(300)]
    rows = []
    for k in range(80):
        t = [rng.choice(words) for _ in range(rng.randrange(3, 90))]
        rows.append((k, " ".join(t)))
        if k % 3 == 0:
            t[rng.randrange(len(t))] = "changed"
            rows.append((200 + k, " ".join(t)))
    frame = docs(rows)
    kept = {r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, frame, SF).collect()}
    assert kept == {c for _, _, c in near_brute(rows, width=5)}
    cut = {r["doc_id"]: len((r["text"] or "").encode()) for r in corpus_pipeline.repeated_passages(spark, frame, SF).collect()}
    assert cut == {i: n - gone for i, n, gone, *_ in byte_brute(rows, 200) if n > gone}
    item = spark.read.parquet(f"{SF}/benchmark.parquet").first()["text"]
    leaks = [(900, "before " + item + " after"), (901, "clean text of no item at all"), (902, item.replace(" ", "  "))]
    assert [r["doc_id"] for r in corpus_pipeline.decontamination(spark, docs(leaks), SF).collect()] == [901]
