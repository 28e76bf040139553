import random

import numpy as np
import pytest

from tidemark.llm import near_dedup
from tidemark.llm.near_dedup import keep_one, link


def sets(rows, width):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    out = []
    for _, t in rows:
        w = [x for x in (t or "").translate(low).split()]
        out.append({tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set())
    return out


def brute(rows, width=4, percent=80):
    s = sets(rows, width)
    # sets as bits of one number each, for quick intersections
    place = {g: k for k, g in enumerate(dict.fromkeys(g for x in s for g in x))}
    bits = [sum(1 << place[g] for g in x) for x in s]
    root = list(range(len(rows)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a in range(len(rows)):
        for b in range(a):
            if find(a) != find(b) and s[a] and s[b]:
                both = (bits[a] & bits[b]).bit_count()
                if 100 * both >= percent * (len(s[a]) + len(s[b]) - both):
                    root[find(a)] = find(b)
    low = {}
    for a, (i, _) in enumerate(rows):
        if i is not None:
            low[find(a)] = min(i, low.get(find(a), i))
    return sorted(((i, len(s[a]), low.get(find(a)) if s[a] else i) for a, (i, _) in enumerate(rows)), key=str)


def corpus(rng, groups=25, each=8):
    words = [f"w{k}" for k in range(400)]
    rows, n = [], 0
    for _ in range(groups):
        base = [rng.choice(words) for _ in range(rng.randrange(5, 160))]
        for _ in range(rng.randrange(1, each)):
            t = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 3, 6])):
                t[rng.randrange(len(t))] = rng.choice(words)
            rows.append((n, " ".join(t)))
            n += 1
    rng.shuffle(rows)
    return rows


def result(frame, **how):
    got = link(frame, **how).collect()
    assert all(r["kept"] == (r["doc_id"] is not None and r["doc_id"] == r["component_id"]) for r in got)
    return sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got), key=str)


@pytest.mark.parametrize("rows_per_partition", [40_000, 300])
def test_against_brute_force(docs, monkeypatch, rows_per_partition):
    monkeypatch.setattr(near_dedup, "ROWS_PER_PARTITION", rows_per_partition)
    rows = corpus(random.Random(rows_per_partition))
    assert result(docs(rows)) == brute(rows)


@pytest.mark.parametrize("n, crowd, load, rows_per_partition", [(600, 1024, 2_000_000, 40_000), (600, 64, 4_000, 500), (2200, 256, 2_000_000, 3_000)])
def test_one_large_group_of_near_copies(docs, monkeypatch, n, crowd, load, rows_per_partition):
    monkeypatch.setattr(near_dedup, "CROWD", crowd)
    monkeypatch.setattr(near_dedup, "LOAD", load)
    monkeypatch.setattr(near_dedup, "ROWS_PER_PARTITION", rows_per_partition)
    rng = random.Random(8)
    base = [f"b{k}" for k in range(150)]
    rows = []
    for k in range(n):
        t = list(base)
        for _ in range(rng.randrange(0, 9)):
            t[rng.randrange(150)] = f"x{rng.random()}"
        rows.append((k, " ".join(t)))
    assert result(docs(rows)) == brute(rows)


def test_small_batches(docs, spark, monkeypatch):
    """Batches of five rows: what is compared doesn't depend on where they end."""
    monkeypatch.setattr(near_dedup, "prepare", lambda spark: spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5"))
    rows = corpus(random.Random(21), groups=12)
    try:
        assert result(docs(rows)) == brute(rows)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_ties_and_long_texts(docs):
    """Neighbours that agree alike, and two near copies of 60,000 words beside short ones."""
    long = [f"w{k % 50_021}" for k in range(60_000)]
    rows = [(1, " ".join(long)), (2, " ".join(long[:-500])), (3, " ".join(long[:200]))]
    base = [f"b{k}" for k in range(40)]
    rows += [(10 + k, " ".join([*base, f"x{k}"])) for k in range(6)] + [(30, " ".join(base)), (31, " ".join(base))]
    assert result(docs(rows)) == brute(rows)


def test_short_case_and_odd_rows(docs, odd):
    rows = [*odd, (20, "One two"), (21, "one  TWO"), (22, "one"), (23, "É é É é É"), (24, "é é é é é")]
    assert result(docs(rows, extra=True)) == brute(rows)
    assert result(docs([])) == []


def test_keep_one(docs, odd):
    text = " ".join(f"w{k}" for k in range(40))
    rows = [(5, text), (3, text + " end"), (9, text), (11, "something else that is of no group at all"), (2, None), (2, None)]
    out = keep_one(docs(rows))
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert sorted((r["doc_id"], r["text"]) for r in out.collect() if r["doc_id"] != 2) == [(3, text + " end"), (11, rows[3][1])]
    assert [r["text"] for r in out.collect() if r["doc_id"] == 2] == [None, None]
    assert sorted((r["doc_id"] for r in keep_one(docs(odd)).collect()), key=str) == [1, 2, 3, 4, 5, 7, None]
    twice = [(1, text), (1, "another text under the same id, which stays"), (1, text), (None, text)]
    assert sorted(r["text"] for r in keep_one(docs(twice)).collect()) == sorted([text, twice[1][1]])


@pytest.mark.parametrize("crowd", [1024, 64])
def test_partners_far_apart_in_a_crowded_region(spark, monkeypatch, crowd):
    """Two signatures that agree but in one value, at the two ends of a region of 700; half of it is one component."""
    monkeypatch.setattr(near_dedup, "CROWD", crowd)
    rng = np.random.RandomState(12)
    sig = rng.randint(1, 65535, (700, near_dedup.VALUES)).astype(np.uint16)
    sig[:, :2] = 7
    sig[699] = sig[0]
    sig[0, 2], sig[699, 2] = 0, 65535
    sig[5] = sig[2]
    raw = [s.astype(">u2").tobytes() for s in sig]
    rows = [(0, bytearray(s[:4]), k, k if k > 350 else 1, 9, bytearray(s)) for k, s in enumerate(raw)]
    frame = spark.createDataFrame(rows, "tree int, head binary, cid long, comp long, n long, sig binary")
    pieces = near_dedup.deal(frame)
    assert pieces.groupBy("piece").count().agg({"count": "max"}).first()[0] <= (700 if crowd > 700 else 4 * crowd)
    near = near_dedup.in_pieces(frame, near_dedup.across(80), "tree int, cid long").distinct().collect()
    assert sorted(r["cid"] for r in near) == [0, 699]  # 2 and 5 are of one component


def test_clashing_names(docs):
    from pyspark.sql import functions as F

    frame = docs([(1, "one and the same text of some words"), (2, "one and the same text of some words"), (3, None)])
    for n in ("_text_key", "_id", "_key", "_rows", "id", "key", "rows", "cid", "n", "c0"):
        frame = frame.withColumn(n, F.lit(n))
    out = keep_one(frame)
    assert out.columns == frame.columns
    assert sorted((r["doc_id"], r["_id"], r["rows"]) for r in out.collect()) == [(1, "_id", "rows"), (3, "_id", "rows")]


@pytest.mark.parametrize("crowd", [1024, 64])
def test_crowded_family_against_brute_force(docs, monkeypatch, crowd):
    """A family of similarities about 0.7 with some pairs over 0.8; regions in one piece and in blocks."""
    monkeypatch.setattr(near_dedup, "CROWD", crowd, raising=False)
    rng = random.Random(13)
    base, rows = [f"b{k}" for k in range(200)], []
    for k in range(400):
        t = list(base)
        for at in rng.sample(range(0, 200, 5), 8):
            t[at] = f"x{k}-{at}"
        rows.append((2 * k, " ".join(t)))
        if k % 20 == 0:
            t[rng.randrange(1, 200, 5)] = f"y{k}"
            rows.append((2 * k + 1, " ".join(t)))
    rng.shuffle(rows)
    assert result(docs(rows)) == brute(rows)
