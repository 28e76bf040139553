import re

from tidemark.llm.licenses import BASE, scan

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(text):
    w = WORD.findall((text or "").translate(LOW))
    places = sorted((k, label) for phrase, label in BASE.items() for k in range(len(w)) if w[k : k + len(phrase.split())] == phrase.split())
    starts = [k for k, _ in places]
    return len(w), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places}))


TEXTS = [
    "Released under the MIT License.", "MIT license, mit LICENSE; apache-license", "Licensed under CC BY-NC 4.0.", "x mit\nlicense", "mitlicense", "mit ß license", "cc by cc by cc by", "This work is licensed under the GNU General Public License, version 3.",
    "GNU General Public", "Licensed under the Apache License, Version 2.0.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", "Free of charge, permission granted by us to a person", "ÄCC BY", "nothing",
]


def test_base_columns_against_brute_force(docs, odd):
    rows = [*odd, *((100 + k, t) for k, t in enumerate(TEXTS)), (200, "filler " * 50_000 + "gnu general public license")]
    got = sorted(((r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in scan(docs(rows, extra=True)).collect()), key=str)
    assert got == sorted(((i, *brute(t)) for i, t in rows), key=str)
    assert scan(docs([])).collect() == []


def test_labels_of_the_method(docs):
    got = {r["doc_id"]: (r["labels"], r["score"]) for r in scan(docs(list(enumerate(TEXTS)))).collect()}
    assert got[0] == ("mit,mit-notice", 1.0)
    assert got[2] == ("cc-by,cc-by-nc-4.0", 1.0)
    assert got[7] == ("gpl,gpl-3.0", 1.0)
    assert got[9] == ("apache,apache-2.0", 1.0)
    assert got[10] == ("mit-text", 1.0)
    assert got[1] == ("apache,mit", 0.5)
    assert got[11] == got[13] == ("", 0.0)


def test_labels_and_scores_against_brute_force(docs):
    """Templates whole, cut, with words changed or put in between: every alignment of every template, without an index."""
    import math
    import random

    from tidemark.llm.licenses import MIN_COVERAGE, SLACK, TEMPLATES

    rng = random.Random(4)
    filler = ["code", "the", "of", "file", "license", "public", "version", "note", "2"]
    rows = []
    for k in range(260):
        t = [rng.choice(filler) for _ in range(rng.randrange(0, 12))]
        for _ in range(rng.randrange(0, 3)):
            own = rng.choice(TEMPLATES)[1].split()
            for _ in range(rng.choice([0, 0, 1, 2, 4])):
                at = rng.randrange(len(own))
                own[at : at + rng.randrange(2)] = [rng.choice(filler)] * rng.randrange(2)
                own = own or ["x"]
            t += own[rng.choice([0, 0, 0, 2]) :] + [rng.choice(filler) for _ in range(rng.randrange(0, 9))]
        rows.append((k, " ".join(t)))
    sets = [set(t.split()) for _, t in rows]
    idf = lambda w: math.log((1 + len(rows)) / (1 + sum(w in s for s in sets))) + 1
    known = {w: idf(w) for _, t, _ in TEMPLATES for w in t.split()}

    def holds(words, phrase):
        phrase = phrase.split()
        return any(words[i : i + len(phrase)] == phrase for i in range(len(words)))

    want = {}
    for i, t in rows:
        w, found = t.split(), {}
        for name, text, keys in TEMPLATES:
            x = text.split()
            anchors = {max(k.split(), key=lambda v: (known[v], v)) for k in keys}
            for start in range(-len(x) + 1, len(w)):
                same = [0 <= start + q < len(w) and w[start + q] == x[q] for q in range(len(x))]
                if not any(s and x[q] in anchors for q, s in enumerate(same)):
                    continue
                cover = sum(known[v] for v, s in zip(x, same) if s) / sum(known[v] for v in x)
                near = w[max(0, start - SLACK) : start + len(x) + SLACK]
                if cover >= MIN_COVERAGE and all(holds(near, k) for k in keys):
                    found[name] = max(cover, found.get(name, 0))
        want[i] = found
    assert sum(bool(f) for f in want.values()) > 60
    for r in scan(docs(rows)).collect():
        base = {x for x in r["base_labels"].split(",") if x}
        assert r["labels"] == ",".join(sorted(base | set(want[r["doc_id"]]))), rows[r["doc_id"]]
        assert abs(r["score"] - min(1.0, max([0.5 * bool(base), *want[r["doc_id"]].values()]))) < 1e-9
