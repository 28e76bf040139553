import random
import re

import numpy as np
import pytest

from tidemark.llm.tokens import VOCABULARY, Automaton, count_tokens, read_vocabulary

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def greedy(pieces, longest, word):
    n = i = 0
    while i < len(word):
        for j in range(min(len(word), i + longest), i, -1):
            if word[i:j] in pieces:
                n, i = n + 1, j
                break
        else:
            return 1
    return n


@pytest.mark.parametrize("seed", range(4))
def test_random_vocabularies(seed):
    rng = random.Random(seed)
    pieces = {bytes(rng.choices(b"abc", k=rng.randrange(1, 7))) for _ in range(rng.randrange(3, 60))} | ({b"a", b"b", b"c"} if seed % 2 else set()) | {b" "}
    machine = Automaton(sorted(pieces))
    words = [bytes(rng.choices(b"abcd" if seed == 2 else b"abc", k=rng.randrange(1, 40))) for _ in range(800)]
    ends = np.cumsum([len(w) for w in words])
    data = np.frombuffer(b"".join(words), np.uint8)
    starts = ends - np.array([len(w) for w in words])
    assert machine.counts(data, starts, ends).tolist() == [greedy(pieces, 7, b" " + w) for w in words]
    assert machine.counts(data, starts, ends, lead=None).tolist() == [greedy(pieces, 7, w) for w in words]


def test_counts_of_documents(docs, odd):
    pieces = set(read_vocabulary(VOCABULARY))
    longest = max(map(len, pieces))
    rows = [*odd, (30, "The quick brown fox; jumps over 12,345 lazy dogs!"), (31, "naïve café — 東京 🙂")]
    got = sorted(((r["doc_id"], r["n_words"], r["n_tokens"], r["n_bytes"]) for r in count_tokens(docs(rows, extra=True)).collect()), key=str)
    want = []
    for i, t in rows:
        b = (t or "").encode()
        w = WORD.findall(b)
        want.append((i, len(w), sum(greedy(pieces, longest, b" " + x) for x in w) if len(w) < 1000 else sum(greedy(pieces, longest, b" word") for _ in w), len(b)))
    assert got == sorted(want, key=str)
    assert count_tokens(docs([])).collect() == []
