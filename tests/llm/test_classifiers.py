import random
import zlib

import numpy as np
import pytest

from tidemark.llm import quality, toxicity


@pytest.fixture
def labels(spark):
    return lambda rows: spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def prose(rng, n):
    return " ".join(rng.choice(["the", "of", "river", "stone", "walked", "quiet", "morning", "Light", "and", "house,"]) + ("." if rng.random() < 0.08 else "") for _ in range(n)).capitalize()


def junk(rng, n):
    return " ".join(rng.choice(["BUY", "NOW", "CLICK", "WIN"]) + rng.choice(["!!", "***", "$$$"]) for _ in range(n))


def test_quality_learns_and_holds_out(docs, labels):
    rng = random.Random(1)
    rows = [(k, prose(rng, rng.randrange(8, 80)) if k % 3 else junk(rng, rng.randrange(4, 60))) for k in range(400)]
    out = quality.classify(docs(rows, extra=True), labels([(k, int(bool(k % 3)), 0) for k in range(400)])).collect()
    assert len(out) == 400
    for r in out:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7)
    held = [r for r in out if r["held_out"]]
    assert np.mean([r["predicted"] == int(bool(r["doc_id"] % 3)) for r in held]) > 0.97
    kept = quality.keep_good(docs(rows), labels([(k, int(bool(k % 3)), 0) for k in range(400)]))
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars"] and abs(kept.count() - 266) < 12


def test_held_out_labels_do_not_matter(docs, labels):
    rng = random.Random(2)
    rows = [(k, prose(rng, 30) if k % 2 else junk(rng, 30)) for k in range(200)]
    plain = [(k, k % 2, k % 2) for k in range(200)]
    for module, modulus, rest, column in ((quality, 4, 2, 1), (toxicity, 5, 0, 2)):
        turned = [tuple(1 - v if c == column and zlib.crc32(str(r[0]).encode()) % modulus == rest else v for c, v in enumerate(r)) for r in plain]
        a, b = (sorted((r["doc_id"], r["score"]) for r in module.classify(docs(rows), labels(x)).collect()) for x in (plain, turned))
        assert a == b


def test_toxicity_finds_words_and_their_endings(docs, labels):
    rng = random.Random(3)
    rows, marks = [], []
    for k in range(600):
        words = prose(rng, rng.randrange(10, 90)).split()
        bad = k % 5 == 0
        for _ in range(rng.randrange(1, 4) if bad else 0):
            words.insert(rng.randrange(len(words)), rng.choice(["vermin", "blockhead", "schurk" + rng.choice("abcdefghi") + rng.choice("xyz")]))
        rows.append((k, " ".join(words)))
        marks.append((k, 1, int(bad)))
    out = toxicity.classify(docs(rows, extra=True), labels(marks)).collect()
    held = [r for r in out if r["held_out"]]
    assert len(held) > 60
    assert np.mean([r["predicted"] == int(r["doc_id"] % 5 == 0) for r in held]) > 0.97
    assert all(r["evidence"] for r in out if r["predicted"])


def test_index_finds_the_exact_neighbours():
    rng = np.random.RandomState(4)
    v = (rng.random_sample((700, 40)) * (rng.random_sample((700, 40)) < 0.1)).astype(np.float32)
    v = v[v.any(axis=1)]
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    rows = [(np.flatnonzero(x), x[np.flatnonzero(x)]) for x in v]
    index = toxicity.Index([b"w%d" % k for k in range(40)], np.ones(40), rng.randint(0, 2, len(v)).astype(float), rows, list(range(len(v))), 0.0)
    for _ in range(50):
        columns = np.sort(rng.choice(40, 4, replace=False))
        weights = rng.random_sample(4)
        at, best = index.nearest(columns, weights)
        want = np.sort(v[:, columns] @ weights)[::-1][: toxicity.NEIGHBOURS]
        assert np.allclose(best, want[want > 0])
        assert np.allclose(v[index.ids[at]][:, columns] @ weights, best)


def test_odd_rows(docs, labels, odd):
    for module in (quality, toxicity):
        out = module.classify(docs(odd, extra=True), labels([(1, 1, 0), (5, 0, 1), (4, 1, 0), (4, None, None), (None, 1, 1)])).collect()
        assert len(out) == len(odd) and all(0 <= r["score"] <= 1 for r in out)
        assert module.classify(docs([]), labels([])).collect() == []
        assert len(module.classify(docs(odd), labels([])).collect()) == len(odd)


def test_copies_of_a_toxic_text_hide_no_insult(docs, labels):
    """One toxic text stands 300 times; its insult is also in 30 other toxic texts."""
    rng = random.Random(6)
    rows = [(k, prose(rng, 20) + " vermin") for k in range(30)]
    rows += [(30 + k, rows[0][1]) for k in range(300)]
    rows += [(400 + k, prose(rng, 20)) for k in range(300)]
    out = toxicity.classify(docs(rows), labels([(i, 1, int(i < 400)) for i, _ in rows])).collect()
    assert [r["doc_id"] for r in out if r["predicted"] != int(r["doc_id"] < 400)] == []
    assert all("vermin" in r["evidence"] for r in out if r["doc_id"] < 400)


def test_quality_scores_against_brute_force(docs, labels, odd):
    """Every document's score from all its cosines, one text at a time, in double precision."""
    rng = random.Random(9)
    rows = [(k, prose(rng, rng.randrange(8, 60)) if k % 3 else junk(rng, rng.randrange(4, 40))) for k in range(240)] + [(1000 + k, t) for k, (_, t) in enumerate(odd)]
    rows += [(2000, rows[5][1]), (2000, rows[5][1])]  # ties with a labelled text
    marks = labels([(k, int(bool(k % 3)), 0) for k in range(240)])
    frame = docs(rows)
    model = quality.fit(frame, marks)
    got = {}
    for r in quality.classify(frame, marks).collect():
        got.setdefault(r["doc_id"], []).append(r["score"])
    import pyarrow as pa

    from tidemark.llm.textvec import blocks

    for i, t in rows:
        (block,) = blocks(pa.array([t], pa.string()))
        _, column, count = quality.terms(block)
        x = np.zeros(quality.TERMS)
        x[column] = (1 + np.log(count)) * model.idf[column]
        z = x @ model.basis
        if np.linalg.norm(z) < 1e-9:
            want = model.prior
        else:
            z /= np.linalg.norm(z)
            cosine = np.array([float(np.dot(z, row)) for row in model.latent.astype(float)])
            near = np.argsort(-cosine, kind="stable")[: quality.NEIGHBOURS]
            weight = np.clip(cosine[near], 0, 1) ** quality.POWER
            want = float((weight * model.labels[near]).sum() / weight.sum()) if weight.sum() else model.prior
        assert all(abs(s - want) < 2e-2 for s in got[i]), (i, got[i], want)  # float32 cosines may order near ties otherwise
    assert got[2000][0] == got[2000][1] == got[5][0]


def test_extra_columns_and_empty_tables_of_the_quality_stage(docs, labels):
    from pyspark.sql import functions as F

    rng = random.Random(10)
    frame = docs([(k, prose(rng, 20) if k % 2 else junk(rng, 20)) for k in range(60)]).withColumn("_quality_score", F.lit("mine")).withColumn("SCORE", F.lit(7))
    marks = labels([(k, k % 2, 0) for k in range(60)])
    kept = quality.keep_good(frame, marks)
    assert kept.columns == frame.columns and {r["_quality_score"] for r in kept.collect()} == {"mine"}
    assert quality.keep_good(docs([]), marks).collect() == []


def test_calibration_rises_and_is_reliable():
    """Votes of noisy labels: the steps rise, and scores are near the shares of label 1 that they stand for; ties get one score."""
    rng = np.random.RandomState(5)
    rows, labels = [], []
    for _ in range(900):
        kind = rng.randint(6)
        rows.append((np.array([kind]), np.array([1.0])))
        labels.append(float(rng.random_sample() < kind / 6))
    index = toxicity.Index([b"w%d" % k for k in range(6)], np.ones(6), np.array(labels), rows, list(range(900)), 0.0)
    index.calibrate(rows, np.array(labels))
    x, y = index.steps
    assert (np.diff(x) > 0).all() and (np.diff(y) >= 0).all() and 0 <= y.min() and y.max() <= 1
    assert sum(n for n, _, _ in index.reliability) == 900
    got = [index.score(np.array([k]), np.array([1]))[0] for k in range(6)]
    assert all(abs(s - np.mean([y for (c, _), y in zip(rows, labels) if c[0] == k])) < 0.25 for k, s in enumerate(got))


def test_the_sample_is_bounded_when_ids_repeat(docs, labels):
    from tidemark.llm.labelled import sample
    from pyspark.sql import functions as F

    frame = docs([(1, f"text {k % 3}") for k in range(300)] + [(2, "other"), (3, None)])
    got = sample(frame, labels([(1, 1, 0), (2, 0, 1), (3, 1, 1), (1, 1, 0)]), "quality", F.lit(True), 10).collect()
    assert sorted((r["doc_id"], r["y"]) for r in got) == [(1, 1), (2, 0), (3, 1)]
