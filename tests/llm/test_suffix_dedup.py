import collections
import hashlib
import random

import numpy as np
import pytest

from tidemark.llm import suffix_dedup
from tidemark.llm.suffix_dedup import remove, strip_repeats


def brute(rows, length):
    texts = [(r[1] or "").encode() for r in rows]
    count = collections.Counter(t[k : k + length] for t in texts for k in range(len(t) - length + 1))
    out = []
    for (doc, *_), t in zip(rows, texts):
        gone = np.zeros(len(t), bool)
        for k in range(len(t) - length + 1):
            if count[t[k : k + length]] > 1:
                gone[k : k + length] = True
        spans = int(np.diff(np.concatenate([[0], gone.astype(int)])).clip(0).sum())
        out.append((doc, len(t), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(t, np.uint8)[~gone].tobytes()).hexdigest()))
    return sorted(out, key=str)


def got(frame, **how):
    out, made = remove(frame, **how)
    return sorted(((r["doc_id"], *(r[m] for m in made)) for r in out.collect()), key=str)


def noise(rng, n):
    return "".join(rng.choice("abcdefghij éü") for _ in range(n))


@pytest.mark.parametrize("widths", [(16, 4, 1), (64, 8, 1), (1,)])
def test_against_brute_force(docs, monkeypatch, widths):
    monkeypatch.setattr(suffix_dedup, "WIDTHS", widths)
    rng = random.Random(len(widths))
    shared = [noise(rng, n) for n in (150, 199, 200, 230, 700)]
    rows = []
    for k in range(60):
        parts = [noise(rng, rng.randrange(0, 300))]
        for _ in range(rng.randrange(0, 4)):
            s = rng.choice(shared)
            if rng.random() < 0.4:
                cut = rng.randrange(len(s))
                s = s[:cut] + rng.choice("xyz") + s[cut:]
            parts += [s, noise(rng, rng.randrange(0, 120))]
        rows.append((k, "".join(parts)))
    rows += [(100, "ab" * 300), (101, "x" * 450), (102, "x" * 199), (103, rows[3][1]), (104, rows[3][1]), (104, rows[3][1])]
    assert got(docs(rows)) == brute(rows, 200)


def test_other_lengths(docs):
    rng = random.Random(9)
    shared = noise(rng, 90)
    rows = [(k, noise(rng, rng.randrange(200)) + shared[rng.randrange(30) :] + noise(rng, 50)) for k in range(30)]
    assert got(docs(rows), length=40, seed=16) == brute(rows, 40)


def test_odd_rows(docs, odd):
    assert got(docs(odd, extra=True)) == brute(odd, 200)
    assert got(docs([])) == []


def test_texts_over_several_pieces(docs, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "PIECE", 5000)
    monkeypatch.setattr(suffix_dedup, "BLOCK", 1000)
    rng = random.Random(2)
    a, b = noise(rng, 9000), noise(rng, 300)
    rows = [(1, a[:4900] + b + a[4900:]), (2, noise(rng, 50) + b), (3, a[2000:2600])]
    assert got(docs(rows)) == brute(rows, 200)


def test_stage_keeps_columns_and_clean_documents(docs):
    rng = random.Random(4)
    passage = noise(rng, 400).strip()
    out = strip_repeats(docs([(1, "one " + passage), (2, "two " + passage), (3, "clean"), (4, passage), (5, None)]))
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert {r["doc_id"]: r["text"] for r in out.collect()} == {1: "one", 2: "two", 3: "clean", 5: None}  # the blank before the passage repeats too


def test_one_passage_in_many_surroundings(docs):
    """A sample that stands in hundreds of places, cut off at many lengths to both sides."""
    rng = random.Random(6)
    passage = noise(rng, 420)
    rows = [(k, noise(rng, rng.randrange(0, 90)) + passage[rng.randrange(0, 200) : rng.randrange(230, 420)] + noise(rng, rng.randrange(0, 90))) for k in range(300)]
    assert got(docs(rows)) == brute(rows, 200)


def test_one_row_many_times(docs, spark):
    from pyspark.sql import functions as F

    rng = random.Random(7)
    text = noise(rng, 260)
    many = docs([(1, text)]).crossJoin(spark.range(100_000).select(F.lit(0).alias("zero"))).drop("zero")
    out, made = remove(many)
    rows = out.groupBy("doc_id", *made[:3]).count().collect()
    size = len(text.encode())
    assert [tuple(r) for r in rows] == [(1, size, size, 1, 100_000)]


def test_clashing_names(docs):
    from pyspark.sql import functions as F

    rng = random.Random(8)
    passage = noise(rng, 300)
    frame = docs([(1, "one " + passage), (2, "two " + passage)])
    for n in ("key", "spans", "_key", "_spans", "_n_removed", "_N_Bytes", "_sha256", "c0", "c1", "start", "at", "core"):
        frame = frame.withColumn(n, F.lit(n))
    out = strip_repeats(frame)
    assert out.columns == frame.columns
    assert all(r[n] == n for r in out.collect() for n in ("key", "_key", "_n_removed", "c1"))
