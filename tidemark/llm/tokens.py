"""Token counts by greedy longest match, in time linear in the text.

A trie of the vocabulary gets failure links: where no longer piece fits, the longest piece so far is popped
(perhaps several, one after another) and reading goes on at the trie node of the rest. How many pieces each
such move pops is computed beforehand, so that a word's number of pieces is a sum along its bytes and no
piece is ever built. After Song et al., "Fast WordPiece Tokenization" (2021), on bytes. Moves through several
links are folded into one table of next state and pops, and many words take their steps together.

A word is a run of ``[^\\x20\\x09-\\x0D]`` and is read with one blank before it, as in the vocabulary. A word
that the vocabulary can't spell counts as one token (with all 256 bytes in it, there is none).

Defined results: a null or empty text has 0 words and 0 tokens; repeated rows each get their row; a very long
text is one block, read whole; an empty table gives an empty result; other columns are ignored, whatever their
names. The vocabulary is read once on the driver from a path that is a parameter; its size is bounded by
``MAX_VOCABULARY_BYTES`` and ``MAX_NODES``, beyond which it is refused.
"""

from __future__ import annotations

import base64
import hashlib
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidemark.llm.common import lean, prepare
from tidemark.llm.textvec import NOT_BLANK, blocks

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
MAX_VOCABULARY_BYTES = 64 << 20
#: Nodes of the trie; each has 1,280 bytes of tables in every worker process, so 256 MB at most.
MAX_NODES = 200_000
BLANK = 32


def read_vocabulary(path: str) -> list[bytes]:
    """Pieces of a file with one base64 piece and its rank per line."""
    if os.path.getsize(path) > MAX_VOCABULARY_BYTES:
        raise ValueError(f"{path} is larger than {MAX_VOCABULARY_BYTES} bytes")
    with open(path, "rb") as f:
        return [base64.b64decode(line.split()[0]) for line in f if line.strip()]


class Automaton:
    """Tables step[state * 256 + byte] -> next state, pops[...] -> pieces popped, rest[state] -> pieces at a word's end.

    State 0 is the root, the last state is where no piece fits.
    """

    def __init__(self, pieces: list[bytes]):
        child: list[dict[int, int]] = [{}]
        final = [False]
        for piece in pieces:
            at = 0
            for b in piece:
                nxt = child[at].get(b)
                if nxt is None:
                    if len(child) == MAX_NODES:
                        raise ValueError(f"the vocabulary has more than {MAX_NODES} beginnings of pieces")
                    nxt = child[at][b] = len(child)
                    child.append({})
                    final.append(False)
                at = nxt
            if at:
                final[at] = True
        n = len(child)
        dead = n
        self.step = np.full((n + 1, 256), dead, np.int32)
        self.pops = np.zeros((n + 1, 256), np.uint8 if max(map(len, pieces), default=0) < 200 else np.uint16)
        self.rest = np.zeros(n + 1, np.int32)
        for b, v in child[0].items():
            self.step[0, b] = v
        link, popped = [dead] * n, [0] * n
        level = [(0, b, v) for b, v in child[0].items()]
        while level:
            below = []
            for parent, b, v in level:
                if final[v]:
                    link[v], popped[v] = 0, 1
                elif parent:
                    # what the parent pops, then the same byte again
                    z = link[parent]
                    link[v] = int(self.step[z, b])
                    popped[v] = popped[parent] + int(self.pops[z, b]) if link[v] != dead else 0
                z = link[v]
                self.step[v] = self.step[z]
                self.pops[v] = self.pops[z] + popped[v]
                self.rest[v] = self.rest[z] + popped[v]
                if z == dead:
                    self.rest[v] = -1
                elif self.rest[z] < 0:
                    self.rest[v] = -1
                for c, x in child[v].items():
                    self.step[v, c], self.pops[v, c] = x, 0
                below += [(v, c, x) for c, x in child[v].items()]
            level = below
        self.dead = dead

    def counts(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, lead: int | None = BLANK) -> np.ndarray:
        """Pieces of each word data[start:end]; all words take one step at a time, longest first."""
        step, pops = self.step.reshape(-1), self.pops.reshape(-1)
        size = end - start
        order = np.argsort(-size, kind="stable")
        at, left = start[order].astype(np.int64), size[order]
        state = np.full(len(at), 0 if lead is None else self.step[0, lead], np.int64)
        total = np.zeros(len(at), np.int64)
        active = np.searchsorted(-left, -np.arange(1, (left[0] if len(left) else 0) + 1), "right")
        for k, n in enumerate(active):
            key = state[:n] * 256 + data[at[:n] + k]
            total[:n] += pops[key]
            state[:n] = step[key]
        tail = self.rest[state]
        total = np.where((state == self.dead) | (tail < 0), 1, total + tail)
        out = np.empty(len(at), np.int64)
        out[order] = total
        return out


_built: dict[bytes, Automaton] = {}


def automaton(key: bytes, pieces: list[bytes]) -> Automaton:
    """One automaton for a worker process; key: digest of the pieces."""
    if key not in _built:
        _built.clear()
        _built[key] = Automaton(pieces)
    return _built[key]


def count_tokens(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, n_words, n_tokens, n_bytes of every document."""
    prepare(docs.sparkSession)
    pieces = read_vocabulary(vocabulary)
    shared = docs.sparkSession.sparkContext.broadcast(pieces)
    key = hashlib.sha256(b"\n".join(base64.b64encode(p) for p in pieces)).digest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = automaton(key, shared.value)
        for batch in batches:
            for block in blocks(batch.column(1)):
                w = block.words(NOT_BLANK)
                sums = np.concatenate([[0], np.cumsum(machine.counts(block.data, w.start, w.end))])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(block.first, block.n).cast(pa.int64()), pa.array(w.count, pa.int64()), pa.array(sums[w.first[1:]] - sums[w.first[:-1]], pa.int64()), pa.array(np.diff(block.off), pa.int64())],
                    ["doc_id", "n_words", "n_tokens", "n_bytes"],
                )

    return docs.select("doc_id", "text").mapInArrow(lean(run), "doc_id long, n_words long, n_tokens long, n_bytes long")


def op9_token_counts(spark, sf_dir: str) -> DataFrame:
    return count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"))
