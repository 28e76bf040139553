"""Benchmark decontamination by edit distance over words.

A document is contaminated by an item of m words if some stretch of its words is within ``floor(0.2 m)`` word
edits of the item (similarity 0.8 or more). Words are runs of letters, digits and non-ASCII, A-Z lower-cased.

1. Embedding. A random walk reads words from a place on; at each step it writes down the word that it stands at,
   and a random bit of that word and step says whether it moves on. Two texts within few edits are read in step
   again soon after each edit, so edit distance becomes Hamming distance between what the walks wrote (after
   Chakraborty, Goldenberg and Koucky, "Streaming Algorithms for Embedding and Computing Edit Distance", 2016).
   The walk starts at every word of a text; walks that meet go on as one, which makes that cheap. Half of the
   walks read backwards, from the windows' ends.
2. Bit sampling. A window of an item's size class has signatures of ``SAMPLED`` positions of the walk, ``REPEATS``
   of them for each walk. Windows that share a signature with an item, and agree in ``AGREEING`` of all sampled
   positions, are candidates. Items longer than their class are several windows, one after another, and any will
   do. How many walks are made is measured, not assumed: items with as many random edits as are allowed (a seeded
   sample of them, ``MEASURED``, each with words put in, lost, changed, and all three) must be found in ``RECALL``
   of the cases of the worst kind, else walks are added up to ``MOST_WALKS``. Items with fewer edits are found
   more often.
3. Verification. A semi-global alignment of the item against every candidate window and its surroundings gives the
   exact smallest distance and where the match stands, so nothing is reported that isn't there.

Items of fewer than ``MIN_WORDS`` words allow no edit and are looked up as they are.

Every document is read once, whole, in a map without a shuffle. Items are a table on the driver's side of
this method: they are taken in blocks of ``ITEM_BLOCK``, each block one pass, so what is broadcast is bounded
at any benchmark size. Equal items are looked for once.

Defined results: null and empty texts match nothing, nor do items without words; repeated items with different
ids each match, also where thousands are equal; repeated documents each get their rows; an item that matches
several times in a text is reported once, with its smallest distance and, among those, the first place; long
texts are aligned only around candidates; empty tables give an empty result; other columns are ignored, whatever
their names. ``drop_leaks`` leaves documents alone that hold only items of fewer than ``MIN_WORDS`` words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import lean, prepare
from tidemark.llm.textvec import ALNUM, LOWER, U, blocks, mix, shingles

EDIT_SHARE, MIN_WORDS = 0.2, 5
ITEM_BLOCK = 20_000
#: Words of windows that are compared at once.
CELLS = 400_000
#: Smallest items of the size classes. A class' walks have two steps for each word of its smallest item.
CLASSES = (5, 14)
SAMPLED, REPEATS, FEWEST_WALKS, MOST_WALKS = 3, 4, 4, 24
#: Of all positions of a walk that are sampled for a class, those in which a candidate agrees at least.
AGREEING = 5
RECALL, MEASURED = 0.99, 100
OUT = "doc_id long, item_id long, distance int, item_words int, start_word long, end_word long"


def lead(size: int) -> int:
    """Steps of a class before the first that is sampled: walks of neighbouring starts have met by then."""
    return max(2, min(8, size // 3))


def samples(walk: int, size: int) -> list[list[int]]:
    """The sampled steps of a class' signatures for a walk."""
    rng = np.random.RandomState(1000 * walk + size)
    return [sorted(int(t) for t in rng.choice(np.arange(lead(size), 2 * size), SAMPLED, replace=False)) for _ in range(REPEATS)]


class Walk:
    """One random walk from every word of h, for some size classes.

    Walks that stand at one word go on as one, so the number of different ones falls with the square root of the
    steps. base[size]: where those of a class stand after its lead; of[size]: which of them each start became.
    """

    def __init__(self, h: np.ndarray, walk: int, sizes: list[int], starts: bool = False):
        self.h, self.base, self.of = np.append(h, U(0)), {}, {}
        self.place: dict[int, dict[int, np.ndarray]] = {k: {} for k in sizes}
        wanted = {k: {t for steps in samples(walk, k) for t in steps} for k in sizes}
        now, start = np.arange(len(h), dtype=np.int32), np.arange(len(h), dtype=np.int32) if starts else None
        onto: dict[int, np.ndarray] = {}
        for t in range(2 * max(sizes)):
            if t % 64 == 0:
                # 64 steps' bits of every word; the end of the text stays where it is
                bits = np.append(mix(h ^ U((0x9E3779B97F4A7C15 * (64 * walk + t // 64 + 1)) % (1 << 64))), U(0)).view(np.uint8).reshape(-1, 8)
            if t % 8 == 0:
                few = np.ascontiguousarray(bits[:, t % 64 // 8])
            for k in sizes:
                if t == lead(k):
                    self.base[k], self.of[k], onto[k] = now, start, None
                if t in wanted[k]:
                    self.place[k][t] = now if onto[k] is None else now.take(onto[k])
            now = now + ((few.take(now) >> np.uint8(t % 8)) & np.uint8(1))
            if t % 4 == 3 and len(now):
                fresh = np.concatenate([[True], now[1:] != now[:-1]])
                to = np.cumsum(fresh, dtype=np.int32) - np.int32(1)
                onto = {k: to if x is None else to.take(x) for k, x in onto.items()}
                start = to[start] if starts else None
                now = now[fresh]

    def signatures(self, size: int, steps: list[int]) -> np.ndarray:
        out = np.full(len(self.base[size]), U(size))
        for t in steps:
            out = out * U(0x9E3779B97F4A7C15) + self.h.take(self.place[size][t])
        return out ^ (out >> U(32))


class Items:
    """A block of benchmark items: word hashes, allowed edits, and the tables of their windows' signatures."""

    def __init__(self, ids: list[int], texts: list[str]):
        column = pa.array(texts, pa.string())
        same: dict[bytes, list[int]] = {}
        for block in blocks(column):
            w = block.words(ALNUM, LOWER[block.data])
            h = w.hashes()
            for d in range(block.n):
                if w.count[d]:
                    same.setdefault(h[w.first[d] : w.first[d + 1]].tobytes(), []).append(ids[block.first + d])
        self.ids = [np.array(sorted(x), np.int64) for x in same.values()]
        self.words = [np.frombuffer(x, U) for x in same]
        self.size = np.array([len(h) for h in self.words], np.int64)
        self.edits = (self.size * EDIT_SHARE + 1e-9).astype(np.int64)
        #: short items by number of words: sorted hashes and items
        self.short = {}
        for m in range(1, MIN_WORDS):
            at = np.flatnonzero(self.size == m)
            if len(at):
                hashes = np.array([shingles(self.words[k], m)[0] for k in at], U)
                order = np.argsort(hashes)
                self.short[m] = hashes[order], at[order]
        # windows: (item, offset, size class)
        windows = []
        for k, m in enumerate(self.size.tolist()):
            if m >= MIN_WORDS:
                size = max(c for c in CLASSES if c <= m)
                windows += [(k, o, size) for o in range(0, m - size + 1, size)]
        self.windows = np.array(windows, np.int64).reshape(-1, 3)
        self.sizes = [int(c) for c in np.unique(self.windows[:, 2])]
        self.walks, self.recall = 0, 1.0
        #: by walk, class and repeat: sorted signatures and their windows; by walk and class: words at all sampled steps
        self.tables: dict[tuple[int, int, int], tuple[np.ndarray, np.ndarray]] = {}
        self.written: dict[tuple[int, int], tuple[np.ndarray, ...]] = {}
        if self.sizes:
            while self.walks < FEWEST_WALKS or (self.recall < RECALL and self.walks < MOST_WALKS):
                for walk in range(self.walks, self.walks + 2):
                    self.add(walk)
                self.walks += 2
                if self.walks >= FEWEST_WALKS:
                    self.recall = self.measure()

    def add(self, walk: int) -> None:
        """What a walk writes for the items' windows."""
        for size in self.sizes:
            own = self.windows[self.windows[:, 2] == size]
            # each window's words and as many fillers as it has steps, in the direction of the walk
            parts, first, real, at = [], [], [], 0
            for item, offset, _ in own.tolist():
                h = self.words[item]
                h = (h[offset:] if walk % 2 == 0 else h[: self.size[item] - offset][::-1])[: 2 * size]
                first.append(at)
                real.append(at + len(h))
                parts += [h, np.zeros(2 * size, U)]
                at += len(h) + 2 * size
            w = Walk(np.concatenate(parts), walk, [size], starts=True)
            first, real = np.array(first), np.array(real)
            mine = w.of[size][first]
            steps = sorted(w.place[size])
            words = np.array([np.where(w.place[size][t][mine] < real, w.h[w.place[size][t][mine]], U(0)) for t in steps])
            self.written[walk, size] = own[:, 0], own[:, 1], w.base[size][mine] - first, words
            for s, some in enumerate(samples(walk, size)):
                ok = np.flatnonzero((words[[steps.index(t) for t in some]] != 0).all(axis=0))
                hashes = w.signatures(size, some)[mine][ok]
                order = np.argsort(hashes, kind="stable")
                self.tables[walk, size, s] = hashes[order], ok[order]

    def measure(self) -> float:
        """Of items with as many random edits as they are allowed the share that become candidates where they stand, for the worst kind of edits."""
        rng = np.random.RandomState(7)
        able = np.flatnonzero(self.size >= MIN_WORDS)
        chosen = rng.choice(able, MEASURED, replace=len(able) < MEASURED)
        found = []
        for kind in range(4):
            parts, true, at = [], [], 0
            for k in chosen.tolist():
                words = self.words[k].tolist()
                for _ in range(int(self.edits[k])):
                    how, place, word = kind if kind < 3 else rng.randint(3), rng.randint(len(words)), int(rng.randint(1, 1 << 62))
                    words[place : place + (how != 1)] = [word] if how < 2 else []
                around = rng.randint(1, 1 << 62, 2 * len(words) + 40).astype(U)
                half = len(around) // 2
                parts += [around[:half], np.array(words, U), around[half:]]
                true.append(at + half)
                at += len(around) + len(words)
            item, start, _ = self.candidates(np.concatenate(parts), np.zeros(at, np.int64))
            found.append(np.mean([bool((np.abs(start[item == k] - t) <= 2 * self.edits[k]).any()) for k, t in zip(chosen.tolist(), true)]))
        return float(min(found))

    def candidates(self, h: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(item, window start, text), distinct, of all windows that share a signature with an item.

        A start is known to within the item's edits, and is rounded down to a multiple of them.
        """
        items, starts, docs = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for walk in range(self.walks):
            back = walk % 2 == 1
            w = Walk(h[::-1] if back else h, walk, self.sizes)
            for size in self.sizes:
                item, offset, on, words = self.written[walk, size]
                met = [np.zeros(0, np.int64)]
                for s, steps in enumerate(samples(walk, size)):
                    hashes, window = self.tables[walk, size, s]
                    if not len(hashes):
                        continue
                    g = w.signatures(size, steps)
                    mask = U((1 << (32 * len(hashes)).bit_length()) - 1)
                    at = np.flatnonzero(self.low(walk, size, s, mask).take((g & mask).view(np.int64)))
                    a, b = np.searchsorted(hashes, g[at]), np.searchsorted(hashes, g[at], "right")
                    n = b - a
                    which = np.repeat(a, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                    met.append(np.repeat(at, n) * len(item) + window[which])
                key = np.unique(np.concatenate(met))
                at, window = key // len(item), key % len(item)
                agree = np.zeros(len(key), np.int64)
                for row, t in zip(words, sorted(w.place[size])):
                    agree += w.h[w.place[size][t][at]] == row[window]
                place = w.base[size][at].astype(np.int64)
                ok = (agree >= AGREEING) & (place < len(h))
                place, window = place[ok], window[ok]
                k = item[window]
                items.append(k)
                if back:
                    starts.append(len(h) - (place - on[window]) + offset[window] - self.size[k])
                    docs.append(doc[len(h) - 1 - place])
                else:
                    starts.append(place - on[window] - offset[window])
                    docs.append(doc[place])
        item, start, text = np.concatenate(items), np.concatenate(starts), np.concatenate(docs)
        start -= start % (self.edits[item] + 1)
        order = np.lexsort((start, item, text))
        item, start, text = item[order], start[order], text[order]
        keep = np.ones(len(item), bool)
        keep[1:] = (item[1:] != item[:-1]) | (start[1:] != start[:-1]) | (text[1:] != text[:-1])
        return item[keep], start[keep], text[keep]

    def low(self, walk: int, size: int, s: int, mask: np.uint64) -> np.ndarray:
        """Table of the signatures' low bits, made when first asked for."""
        made = self.__dict__.setdefault("_low", {})
        if (walk, size, s) not in made:
            made[walk, size, s] = np.zeros(int(mask) + 1, bool)
            made[walk, size, s][self.tables[walk, size, s][0] & mask] = True
        return made[walk, size, s]

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "_low"}


def align(item: np.ndarray, regions: np.ndarray, free_start: bool = True) -> np.ndarray:
    """Last rows of the edit distances of one item with rows of regions; 0 in a region matches no word."""
    n, width = regions.shape
    step = np.arange(width + 1)
    row = np.zeros((n, width + 1), np.int64) if free_start else np.broadcast_to(step, (n, width + 1)).copy()
    for i, word in enumerate(item):
        new = np.empty_like(row)
        new[:, 0] = i + 1
        new[:, 1:] = np.minimum(row[:, :-1] + (regions != word), row[:, 1:] + 1)
        row = np.minimum.accumulate(new - step, axis=1) + step
    return row


def verify(items: Items, item: np.ndarray, start: np.ndarray, doc: np.ndarray, h: np.ndarray, first: np.ndarray) -> dict[tuple[int, int], tuple[int, int, int]]:
    """(distance, start word, end word) by (text, item) of the candidates within their item's edits."""
    found: dict[tuple[int, int], tuple[int, int, int]] = {}
    for k in np.unique(item):
        own = np.flatnonzero(item == k)
        m, edits, words = int(items.size[k]), int(items.edits[k]), items.words[k]
        # a start may be off by the edits and by its rounding
        width = m + 3 * edits
        step = max(1, CELLS // width)
        for lo in range(0, len(own), step):
            part = own[lo : lo + step]
            at = start[part][:, None] - edits + np.arange(width)
            inside = (at >= first[doc[part]][:, None]) & (at < first[doc[part] + 1][:, None])
            regions = np.where(inside, h[np.clip(at, 0, len(h) - 1)], U(0))
            last = align(words, regions)
            best, end = last.min(axis=1), last.argmin(axis=1)
            for x in np.flatnonzero(best <= edits):
                tail = regions[x, : end[x]][::-1][None, :]
                back = align(words[::-1], tail, free_start=False)[0]
                length = int(back.argmin())
                d = int(doc[part[x]])
                stop = int(start[part[x]] - edits + end[x] - first[d])
                hit = (int(best[x]), stop - length, stop)
                found[d, int(k)] = min(hit, found.get((d, int(k)), hit))
    return found


def match_block(items: Items, block, short: bool = True) -> list[tuple[int, int, int, int, int]]:
    """(text, item, distance, start word, end word) of a block's matches, by text and item."""
    w = block.words(ALNUM, LOWER[block.data])
    h, doc = w.hashes(), w.doc
    found: dict[tuple[int, int], tuple[int, int, int]] = {}
    if len(h) and items.sizes:
        found = verify(items, *items.candidates(h, doc), h, w.first)
    for m, (hashes, item) in items.short.items() if short else ():
        g = shingles(h, m)
        at = np.flatnonzero(np.isin(g, hashes))
        at = at[doc[at] == doc[at + m - 1]]
        which = item[np.searchsorted(hashes, g[at])]
        for d, k, p in zip(doc[at].tolist(), which.tolist(), at.tolist()):
            found.setdefault((d, k), (0, p - int(w.first[d]), p - int(w.first[d]) + m))
    return [(d, k, *v) for (d, k), v in sorted(found.items())]


def item_blocks(benchmark: DataFrame) -> Iterator[Items]:
    rows = benchmark.select(F.col("item_id").cast("long"), F.coalesce("text", F.lit("")).alias("text")).filter("item_id is not null").toLocalIterator()
    ids, texts = [], []
    for r in rows:
        ids.append(r[0])
        texts.append(r[1])
        if len(ids) == ITEM_BLOCK:
            yield Items(ids, texts)
            ids, texts = [], []
    if ids:
        yield Items(ids, texts)


def find_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row for each document and item that it holds."""
    spark = docs.sparkSession
    prepare(spark)
    out = None
    for items in item_blocks(benchmark):
        shared = spark.sparkContext.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            ix = shared.value
            for batch in batches:
                ids = batch.column(0).cast(pa.int64())
                for block in blocks(batch.column(1)):
                    rows = match_block(ix, block)
                    if rows:
                        d, k, distance, a, b = (np.array(x) for x in zip(*rows))
                        # one row for each id of equal items
                        n = np.array([len(ix.ids[x]) for x in k])
                        d, distance, size, a, b = (np.repeat(x, n) for x in (d, distance, ix.size[k], a, b))
                        yield pa.RecordBatch.from_arrays(
                            [ids.take(pa.array(d + block.first)), pa.array(np.concatenate([ix.ids[x] for x in k])), pa.array(distance, pa.int32()), pa.array(size, pa.int32()), pa.array(a, pa.int64()), pa.array(b, pa.int64())],
                            ["doc_id", "item_id", "distance", "item_words", "start_word", "end_word"],
                        )

        part = docs.select("doc_id", "text").mapInArrow(lean(run), OUT)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else spark.createDataFrame([], OUT)


def drop_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that hold no item, with their own columns; decided row by row within the map."""
    spark = docs.sparkSession
    prepare(spark)
    at, schema = docs.columns.index("text"), docs.schema
    for items in item_blocks(benchmark):
        shared = spark.sparkContext.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep = np.ones(batch.num_rows, bool)
                for block in blocks(batch.column(at)):
                    keep[[block.first + r[0] for r in match_block(shared.value, block, short=False)]] = False
                yield batch.filter(pa.array(keep))

        docs = docs.mapInArrow(lean(run), schema)
    return docs


def op6_decontaminate(spark, sf_dir: str) -> DataFrame:
    return find_leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
