"""Texts as byte arrays: words, word hashes and shingles of whole Arrow columns, without Python strings.

A block holds consecutive texts, about a quarter of a megabyte or one text if it is longer, so that working
vectors stay small at any text length.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 1 << 18
U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INV = pow(_BASE, -1, 1 << 64)

#: Bytes of the class [^\x20\x09-\x0D].
NOT_BLANK = np.array([not (b == 32 or 9 <= b <= 13) for b in range(256)])
#: Bytes of the class [^\x00-\x2F\x3A-\x60\x7B-\x7F], after A-Z are lower-cased.
ALNUM = np.array([b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 for b in range(256)])
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
_VALUES = np.random.RandomState(20240229).randint(1, 1 << 62, 256).astype(U) * U(2) + U(1)


def mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of a public hash function, on a whole vector."""
    x = x ^ (x >> U(33))
    x = x * U(0xFF51AFD7ED558CCD)
    x = x ^ (x >> U(33))
    x = x * U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U(33))


_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, n or more."""
    have = _powers.get(0)
    if have is None or len(have[0]) < n:
        size = max(BLOCK_BYTES + 1, n)
        up, down = np.full(size, U(_BASE)), np.full(size, U(_INV))
        up[0] = down[0] = 1
        made = np.multiply.accumulate(up), np.multiply.accumulate(down)
        if size > 8 * BLOCK_BYTES:
            return made  # a very long text; not worth keeping
        _powers[0] = have = made
    return have


class Block:
    """Consecutive texts: their bytes, and offsets that start at 0."""

    def __init__(self, first: int, data: np.ndarray, offsets: np.ndarray):
        self.first, self.data, self.off = first, data, offsets
        self.n = len(offsets) - 1

    def words(self, kind: np.ndarray, data: np.ndarray | None = None) -> "Words":
        return Words(self, self.data if data is None else data, kind)


class Words:
    """Maximal runs of bytes of a class within each text."""

    def __init__(self, block: Block, data: np.ndarray, kind: np.ndarray):
        self.block, self.data = block, data
        inside = kind[data]
        edge = np.zeros(len(data) + 1, bool)
        edge[block.off] = True
        before = np.empty(len(data), bool)
        after = np.empty(len(data), bool)
        if len(data):
            before[0] = after[-1] = False
            before[1:] = inside[:-1]
            after[:-1] = inside[1:]
            before &= ~edge[:-1]
            after &= ~edge[1:]
        self.start = np.flatnonzero(inside & ~before)
        self.end = np.flatnonzero(inside & ~after) + 1
        #: words of text i: first[i] .. first[i + 1]
        self.first = np.searchsorted(self.start, block.off)
        self.count = np.diff(self.first)

    def __len__(self) -> int:
        return len(self.start)

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(self.block.n), self.count)

    def hashes(self) -> np.ndarray:
        return run_hashes(self.data, self.start, self.end)


class RunHasher:
    """64-bit hashes of runs of bytes, equal for equal bytes; the sums along the data are made once."""

    def __init__(self, data: np.ndarray):
        up, self.down = powers(len(data) + 1)
        self.total = np.empty(len(data) + 1, U)
        self.total[0] = 0
        np.cumsum(_VALUES[data] * up[: len(data)], out=self.total[1:])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.total[end] - self.total[start]) * self.down[start] + (end - start).astype(U) * U(0xD6E8FEB86659FD93))


def run_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of data[start:end]."""
    return RunHasher(data)(start, end) if len(start) else np.zeros(0, U)


def word_hash(word: str) -> int:
    data = np.frombuffer(word.encode(), np.uint8)
    return int(run_hashes(data, np.array([0]), np.array([len(data)]))[0])


def phrase_hashes(text: str) -> np.ndarray:
    """Hashes of a phrase's words, for words split by single blanks."""
    return np.array([word_hash(w) for w in text.split()], U)


def shingles(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hashes of each run of width consecutive words, as if all were of one text; len - width + 1 of them."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, U)
    acc = np.full(n, U(0x243F6A8885A308D3))
    for k in range(width):
        acc = mix(acc * U(0x9E3779B97F4A7C15) + hashes[k : k + n])
    return acc


def whole(words: Words, width: int) -> np.ndarray:
    """Which of the shingles lie within one text."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, bool)
    doc = words.doc
    return doc[:n] == doc[width - 1 :]


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null is empty."""
    kind = pa.large_binary()
    column = column.cast(pa.large_string()) if pa.types.is_string(column.type) else column
    column = pc.fill_null(column, "") if column.null_count else column
    column = column.cast(kind) if column.type != kind else column
    _, where, data = column.buffers()
    offsets = np.frombuffer(where, np.int64)[column.offset : column.offset + len(column) + 1] if where and len(column) else np.zeros(len(column) + 1, np.int64)
    bytes_ = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and data.size else np.zeros(0, np.uint8)
    return bytes_, offsets - offsets[0]


def blocks(column: pa.Array, most: int = BLOCK_BYTES) -> Iterator[Block]:
    data, off = column_bytes(column)
    lo, n = 0, len(off) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + most, "right")) - 1)
        yield Block(lo, data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
        lo = hi


def unique_by_text(doc: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text, value) pairs, by text, then value."""
    order = np.lexsort((values, doc))
    doc, values = doc[order], values[order]
    keep = np.ones(len(doc), bool)
    keep[1:] = (doc[1:] != doc[:-1]) | (values[1:] != values[:-1])
    return doc[keep], values[keep]


@lru_cache(maxsize=4)
def odd_numbers(n: int, seed: int) -> np.ndarray:
    rng = np.random.RandomState(seed)
    return rng.randint(0, 1 << 62, n).astype(U) * U(4) + rng.randint(0, 1 << 31, n).astype(U) * U(2) + U(1)
