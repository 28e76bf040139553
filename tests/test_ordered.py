import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tidemark.operators import ordered, spatial


@pytest.fixture(scope="module")
def data(spark):
    rng = random.Random(7)
    rows = [(k, rng.randrange(6), rng.randrange(15), rng.choice(["a", "b", "c", "", None])) for k in range(400)]
    return rows, spark.createDataFrame(rows, "ord int, g int, v int, s string").repartition(5)


def test_first_last_and_duplicates(data):
    rows, df = data
    first, last, place = {}, {}, {}
    for o, g, v, s in rows:
        first.setdefault((g, v), (o, s))
        last[g, v] = (o, s)
        place.setdefault((g, v), o)
    assert {(r["g"], r["v"]): (r["ord"], r["s"]) for r in ordered.keep_first(df, ["g", "v"], "ord").collect()} == first
    assert {(r["g"], r["v"]): (r["ord"], r["s"], r["first_ord"]) for r in ordered.keep_last(df, ["g", "v"], "ord").collect()} == {k: (*x, place[k]) for k, x in last.items()}
    assert ordered.duplicates(df, "g", "ord").count() == len(rows) - len({g for _, g, _, _ in rows})


@pytest.mark.parametrize("ratio", [0.0, 0.33, 0.5, 0.9, 1.0])
def test_quantiles(data, ratio):
    rows, df = data
    by = {}
    for _, g, v, _ in rows:
        by.setdefault(g, []).append(v)
    by = {g: sorted(v) for g, v in by.items()}
    assert {r["g"]: r["percentile"] for r in ordered.floor_percentile(df, "g", "v", ratio).collect()} == {g: v[min(len(v) - 1, int(len(v) * ratio))] for g, v in by.items()}
    assert {r["g"]: r["upper_median"] for r in ordered.upper_median(df, "g", "v").collect()} == {g: v[len(v) // 2] for g, v in by.items()}


def test_first_mode(data):
    rows, df = data
    want = {}
    for g in {r[1] for r in rows}:
        seen = [s for _, g2, _, s in rows if g2 == g and s]
        want[g] = max(Counter(seen).items(), key=lambda kv: (kv[1], -seen.index(kv[0])))[0]
    assert {r["g"]: r["mode"] for r in ordered.first_mode(df, "g", "s", "ord").collect()} == want


def test_islands(spark):
    df = spark.createDataFrame([("a", x, float(s)) for x, s in [(1, 5), (2, 9), (3, 9), (6, 1), (7, 4), (20, 2)]], "g string, x int, score double")
    best = sorted((r["x"], r["score"]) for r in ordered.best_of_islands(df, "g", "x", 1, "score").collect())
    assert best == [(2, 9.0), (7, 4.0), (20, 2.0)]


def test_overlaps_and_names(spark):
    df = spark.createDataFrame([("p", 0, 0.0, 10.0), ("p", 1, 1.0, 11.0), ("p", 2, 30.0, 40.0), ("p", 3, 2.0, 12.0), ("q", 0, 0.0, 1.0)], "g string, o int, lo double, hi double")
    assert sorted((r["g"], r["o"]) for r in ordered.overlap_dedupe(df, "g", "o", "lo", "hi").collect()) == [("p", 0), ("p", 2), ("q", 0)]
    named = ordered.suffix_names(df, ["g"], "o", F.col("g"), F.lit(".png"))
    assert {(r["g"], r["o"]): r["output_name"] for r in named.collect()} == {("p", 0): "p.png", ("p", 1): "p_2.png", ("p", 2): "p_3.png", ("p", 3): "p_4.png", ("q", 0): "q.png"}


def test_union_and_except(spark):
    a = spark.createDataFrame([(0, "x", 1.4), (1, "x", 1.6)], "o int, t string, v double")
    b = spark.createDataFrame([(0, "x", 0.6), (1, "y", 5.0)], "o int, t string, v double")
    got = ordered.union_first([a, b], [F.col("t"), ordered.half_up(F.col("v"))], "o").collect()
    assert sorted((r["t"], r["v"]) for r in got) == [("x", 1.4), ("x", 1.6), ("y", 5.0)]
    assert [r["t"] for r in ordered.except_seen(b, a, "t").collect()] == ["y"]
    near = spark.createDataFrame([("p", 0, 0.0, 0.0), ("p", 1, 1.0, 1.0), ("p", 2, 5.0, 1.0)], "g string, o int, x double, y double")
    assert sorted(r["o"] for r in ordered.spread_out(near, "g", "o", "x", "y").collect()) == [0, 2]


def test_range_joins_against_loops(spark):
    rng = random.Random(3)
    a = [(rng.randrange(4), k, rng.random() * 100) for k in range(150)]
    b = [(rng.randrange(4), k, rng.random() * 100) for k in range(150)]
    left, right = spark.createDataFrame(a, "g int, i int, at double"), spark.createDataFrame(b, "g int, j int, then double")
    want = {}
    for g, i, x in a:
        hits = [(y - x, j) for h, j, y in b if h == g and 0 <= y - x <= 7]
        if hits:
            want[i] = min(hits)[1]
    assert {r["i"]: r["j"] for r in spatial.nearest_after(left, right, ["g"], "at", "then", 7.0, "j").collect()} == want
    got = sorted((r["i"], r["j"]) for r in spatial.band_join(left.drop("g"), right.drop("g"), "at", "then", 1.5).collect())
    assert got == sorted((i, j) for _, i, x in a for _, j, y in b if abs(x - y) < 1.5)
    bands = right.withColumn("low", F.col("then")).withColumn("high", F.col("then") + F.col("j") / 10)
    got = sorted((r["i"], r["j"]) for r in spatial.within(left, bands.select("g", "j", "low", "high"), ["g"], "at", "low", "high", 5.0).collect())
    assert got == sorted((i, j) for g, i, x in a for h, j, y in b if g == h and y <= x <= y + j / 10)


def test_covered_regions(spark):
    box = "struct<x0:double,y0:double,x1:double,y1:double>"
    r = spark.createDataFrame([("p", 0, (0.0, 0.0, 10.0, 10.0)), ("p", 1, (100.0, 0.0, 110.0, 10.0))], f"image_id string, o int, bbox {box}")
    a = spark.createDataFrame([("p", (0.0, 0.0, 10.0, 8.0))], f"image_id string, bbox {box}")
    assert [x["o"] for x in spatial.not_covered(r, a, "image_id").collect()] == [1]
