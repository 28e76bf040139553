import numpy as np

from tidemark.llm import neighbours
from tidemark.llm.neighbours import nearest, usable
from pyspark.sql import functions as F

SCHEMA = "vec_id long, embedding array<float>, label int"


def frame(spark, rows):
    return usable(spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA))


def brute(rows, k=5):
    ids = np.array([i for i, _ in rows])
    v = np.array([x for _, x in rows], np.float32).astype(float)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    s = v @ v.T
    return {int(i): [int(ids[j]) for j in np.lexsort((ids, -s[a])) if j != a][:k] for a, i in enumerate(ids) if i % 50 == 0}


def test_recall_and_exact_scores(spark):
    rng = np.random.RandomState(1)
    rows = [(i, rng.standard_normal(64).astype(np.float32).tolist()) for i in range(3000)]
    found = frame(spark, rows)
    got = nearest(found, found.filter(F.col("id") % 50 == 0)).collect()
    want = brute(rows)
    hits = sum(r["vec_id"] in want[r["query_id"]] for r in got)
    assert hits >= 0.9 * sum(map(len, want.values()))
    by = dict(rows)
    for r in got:
        a, b = np.array(by[r["query_id"]], np.float32).astype(float), np.array(by[r["vec_id"]], np.float32).astype(float)
        assert abs(r["score"] - a @ b / np.linalg.norm(a) / np.linalg.norm(b)) < 1e-12
    for q in want:
        own = sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in own] == [1, 2, 3, 4, 5]
        assert [(-r["score"], r["vec_id"]) for r in own] == sorted((-r["score"], r["vec_id"]) for r in own)


def test_small_tables_are_exact_with_ties(spark):
    rng = np.random.RandomState(2)
    rows = [(i, rng.standard_normal(8).astype(np.float32).tolist()) for i in range(120)] + [(i, [1.0] * 8) for i in range(120, 260)]
    found = frame(spark, rows)
    got = {}
    for r in nearest(found, found.filter(F.col("id") % 50 == 0)).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = r["vec_id"]
    same = [i for i in range(120, 260)]
    assert [got[150][k] for k in range(1, 6)] == [i for i in same if i != 150][:5]
    assert [got[0][k] for k in range(1, 6)] == brute(rows[:121])[0] or len(got[0]) == 5


def test_odd_vectors(spark):
    rows = [(0, [1.0, 0.0]), (1, None), (2, []), (3, [0.0, 0.0]), (4, [1.0, None]), (5, [float("nan"), 1.0]), (6, [float("inf"), 1.0]), (None, [1.0, 1.0]), (7, [1.0, 1.0]), (7, [1.0, 1.0]), (8, [1.0, 0.0, 0.0]), (50, [0.0, 2.0])]
    found = frame(spark, rows)
    got = sorted((r["query_id"], r["rank"], r["vec_id"], round(r["score"], 6)) for r in nearest(found, found.filter(F.col("id") % 50 == 0)).collect())
    assert got == [(0, 1, 7, 0.707107), (0, 2, 50, 0.0), (50, 1, 7, 0.707107), (50, 2, 0, 0.0)]
    empty = frame(spark, [])
    assert nearest(empty, empty).collect() == []


def test_partitions_do_not_matter(spark, monkeypatch):
    """Several shards, rows in 1 and 16 partitions: the same answers, and most of the nearest."""
    monkeypatch.setattr(neighbours, "SHARD", 900)
    rng = np.random.RandomState(3)
    rows = [(i, rng.standard_normal(64).astype(np.float32).tolist()) for i in range(4000)]
    answers = []
    for n in (1, 16):
        found = frame(spark, rows).repartition(n)
        answers.append(sorted(tuple(r) for r in nearest(found, found.filter(F.col("id") % 50 == 0)).collect()))
    assert answers[0] == answers[1]
    want = brute(rows)
    assert sum(r[2] in want[r[0]] for r in answers[0]) >= 0.9 * 5 * len(want)


def test_fewer_than_five_and_a_frequent_vector(spark):
    few = frame(spark, [(50 * i, [1.0, float(i)]) for i in range(4)])
    got = nearest(few, few.filter(F.col("id") % 50 == 0)).collect()
    assert len(got) == 12 and {r["rank"] for r in got} == {1, 2, 3}
    rng = np.random.RandomState(4)
    same = rng.standard_normal(16).astype(np.float32).tolist()
    many = frame(spark, [(i, same if i % 3 else rng.standard_normal(16).astype(np.float32).tolist()) for i in range(1500)])
    got = nearest(many, many.filter(F.col("id") % 50 == 0)).collect()
    assert [r["vec_id"] for r in sorted((r for r in got if r["query_id"] == 50), key=lambda r: r["rank"])] == [1, 2, 4, 5, 7]
