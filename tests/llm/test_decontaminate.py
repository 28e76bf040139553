import random

import pytest

from tidemark.llm.decontaminate import drop_leaks, find_leaks


def edit(a, b):
    """Smallest word edits of a against any stretch of b."""
    row = [0] * (len(b) + 1)
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j - 1] + (x != y), row[j] + 1, new[j - 1] + 1))
        row = new
    return min(row)


@pytest.fixture
def bench(spark):
    return lambda rows: spark.createDataFrame(rows, "item_id long, text string")


def test_against_brute_force(docs, bench):
    rng = random.Random(1)
    words = [f"v{k}" for k in range(300)]
    items = [(100 + k, " ".join(rng.choice(words) for _ in range(rng.randrange(5, 45)))) for k in range(25)]
    rows = []
    for k in range(150):
        t = [rng.choice(words) for _ in range(rng.randrange(0, 80))]
        if k % 2:
            own = rng.choice(items)[1].split()
            for _ in range(rng.randrange(0, 1 + len(own) // 4)):
                kind, at = rng.randrange(3), rng.randrange(len(own))
                own = own[:at] + ([rng.choice(words)] if kind == 0 else [rng.choice(words), own[at]] if kind == 1 else []) + own[at + 1 :]
            at = rng.randrange(len(t) + 1)
            t[at:at] = own
        rows.append((k, " ".join(t)))
    want = {}
    for d, t in rows:
        for i, x in items:
            x = x.split()
            e = edit(x, t.split())
            if e <= len(x) // 5:
                want[d, i] = e
    got = {(r["doc_id"], r["item_id"]): r["distance"] for r in find_leaks(docs(rows), bench(items)).collect()}
    missed = set(want) - set(got)
    assert not set(got) - set(want)
    assert len(missed) <= 0.02 * len(want)  # the target recall leaves few
    assert all(got[k] == want[k] for k in got)
    assert all(k in got for k, e in want.items() if e == 0)


def test_place_and_marks(docs, bench):
    items = [(1, "The quick brown fox jumps over the lazy dog today")]
    rows = [(1, "zero one THE QUICK, brown fox; jumps over the (lazy) dog today. end"), (2, "the quick brown fox sat"), (3, "The quick brown fox jumps over a lazy dog today")]
    got = {r["doc_id"]: (r["distance"], r["start_word"], r["end_word"]) for r in find_leaks(docs(rows), bench(items)).collect()}
    assert got == {1: (0, 2, 12), 3: (1, 0, 10)}


def test_odd_rows(docs, bench, odd):
    items = [(1, None), (2, ""), (3, "one two"), (None, "a text without an id at all"), (4, "repeated row of a text"), (5, "repeated row of a text"), (6, "word " * 30)]
    got = sorted(((r["doc_id"], r["item_id"], r["distance"]) for r in find_leaks(docs(odd, extra=True), bench(items)).collect()), key=str)
    assert got == [(4, 6, 0), (5, 4, 0), (5, 4, 0), (5, 5, 0), (5, 5, 0)]
    assert find_leaks(docs([]), bench(items)).collect() == [] and find_leaks(docs(odd), bench([])).collect() == []
    left = drop_leaks(docs(odd), bench(items))
    assert left.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert sorted((r["doc_id"] for r in left.collect()), key=str) == [1, 2, 3, 7, None]


def test_long_items_with_deletions(docs, bench):
    """Items of 100 to 500 words, floor(0.2 m) of them lost or put in between, are all found."""
    rng = random.Random(5)
    items = [(k, " ".join(f"i{k}w{j}" for j in range(100 + 50 * k))) for k in range(9)]
    rows, want = [], {}
    for k, t in items:
        own = t.split()
        m, edits = len(own), len(own) // 5
        lost = set(rng.sample(range(m), edits))
        rows.append((2 * k, " ".join(w for j, w in enumerate(own) if j not in lost)))
        more = list(own)
        for _ in range(edits):
            more.insert(rng.randrange(len(more) + 1), "between")
        rows.append((2 * k + 1, " ".join(more)))
        for d, text in rows[-2:]:
            e = edit(own, text.split())
            if e <= edits:
                want[d, k] = e
    got = {(r["doc_id"], r["item_id"]): r["distance"] for r in find_leaks(docs(rows), bench(items)).collect()}
    assert got == want


def test_recall_of_the_proposed_windows():
    """Items with as many edits as are allowed, of one kind or mixed: what the walks propose and verification confirms."""
    import pyarrow as pa

    from tidemark.llm import decontaminate
    from tidemark.llm.textvec import blocks

    rng = random.Random(11)
    for m in (14, 30, 59, 150):
        items = [[f"i{k}w{rng.randrange(10**9)}" for _ in range(m)] for k in range(25)]
        index = decontaminate.Items(list(range(25)), [" ".join(x) for x in items])
        assert index.recall >= decontaminate.RECALL or index.walks == decontaminate.MOST_WALKS
        met = 0
        for k, x in enumerate(items):
            for kind in range(4):
                y = list(x)
                for _ in range(m // 5):
                    how, at = kind if kind < 3 else rng.randrange(3), rng.randrange(len(y))
                    y[at : at + (how != 1)] = [f"new{rng.randrange(10**9)}"] if how < 2 else []
                text = " ".join([*(f"a{rng.randrange(10**6)}" for _ in range(9)), *y, *(f"b{rng.randrange(10**6)}" for _ in range(40))])
                (block,) = blocks(pa.array([text]))
                met += any(r[1] == k for r in decontaminate.match_block(index, block))
        assert met >= 0.97 * 100, (m, met)


def test_short_equal_and_tied_items(docs, bench):
    items = [(1, "Yes"), (2, "two words"), (3, "two, WORDS"), (4, "one two three four"), *((100 + k, "the very same item of eight words here") for k in range(500))]
    rows = [(1, "say yes: two words and two words"), (2, "one two three four five"), (3, "x the very same item of eight words here y the very same item of eight words there"), (4, "twowords yesterday")]
    found = find_leaks(docs(rows), bench(items)).collect()
    got = {(r["doc_id"], r["item_id"]): (r["distance"], r["start_word"], r["end_word"]) for r in found}
    assert len(found) == len(got) == 3 + 1 + 500
    assert got[1, 1] == (0, 1, 2) and got[1, 2] == got[1, 3] == (0, 2, 4) and got[2, 4] == (0, 0, 4)
    assert {v for (d, _), v in got.items() if d == 3} == {(0, 1, 9)}  # the nearer of two places
    assert sorted(r["doc_id"] for r in drop_leaks(docs(rows), bench(items)).collect()) == [1, 2, 4]
