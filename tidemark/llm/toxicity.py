"""Toxicity by the nearest labelled examples, found exactly in a block-max inverted index.

Terms are words (A-Z lower-cased runs of letters, digits and non-ASCII) and the beginnings of words, of 4 to
10 bytes, as insults get endings. Terms that go with label 1 in the sample, by a chi-square test and a share
of ``MIN_SHARE`` of the texts that hold them, make the vocabulary; its document frequencies are counted over
all documents. Texts are
TF-IDF vectors over it. The sample's vectors are stored as postings in blocks of ``BLOCK`` examples with the
largest weight of each word per block. A query visits blocks in the order of their upper bounds and stops
when no block left can beat the k-th best cosine, so its neighbours are the exact ones. Neighbours vote with
a weight that falls with distance, and the vote is calibrated by the sample's own votes, each example left out of
its own; the words that a text shares with the vocabulary and the nearest examples are the evidence. Texts without a word of the vocabulary score as the sample's texts without one do.

The sample has at most ``SAMPLE`` labelled rows, in seeded order; all else covers all rows.

Defined results: null and empty texts score as texts without evidence; without labelled rows every score is
0.0; ties between neighbours go to the smaller place in the index; repeated rows each get their row; a very long
text is one block, read whole; an empty table gives an empty result; other columns are ignored, whatever their
names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import lean, prepare
from tidemark.llm.labelled import crc_class, sample
from tidemark.llm.textvec import ALNUM, LOWER, RunHasher, blocks, mix, run_hashes

SAMPLE, BLOCK, NEIGHBOURS = 16000, 64, 15
PREFIXES = range(4, 11)
CHI_SQUARE, MIN_SHARE = 24.0, 0.4
THRESHOLD, PRIOR = 0.5, 5.0
MODULUS, HELD_OUT = 5, 0


class Index:
    """Postings of the examples' vectors, by term and block of examples, with each block's largest weight."""

    def __init__(self, words: list[bytes], idf: np.ndarray, labels: np.ndarray, rows: list[tuple[np.ndarray, np.ndarray]], ids: list[int], bare: float):
        """rows: (columns, weights) of the examples, of length 1; bare: score of texts without evidence."""
        self.bare, self.words, self.idf = bare, words, idf
        self.hashes, self.order = ranked_hashes(words)
        # examples with alike leading words stand together, which makes the blocks' bounds tight
        lead = np.array([c[np.argmax(w)] for c, w in rows], int)
        # in an order that labels have no part in, as ties go by it
        place = np.lexsort((mix(np.array(ids, np.int64).view(np.uint64)), lead)) if rows else np.zeros(0, int)
        self.labels, self.ids, self.given = labels[place], np.array([ids[k] for k in place], np.int64), place
        #: steps of calibration, none yet: (votes, shares of label 1); examples, mean vote and share of each
        self.steps: tuple[np.ndarray, np.ndarray] = (np.zeros(0), np.zeros(0))
        self.reliability: list[tuple[int, float, float]] = []
        sizes = np.array([len(rows[k][0]) for k in place], int)
        term = np.concatenate([rows[k][0] for k in place]) if rows else np.zeros(0, int)
        weight = np.concatenate([rows[k][1] for k in place]) if rows else np.zeros(0)
        at = np.repeat(np.arange(len(place)), sizes)
        by_term = np.lexsort((at, term))
        self.at, self.weight = at[by_term], weight[by_term]
        cell = term[by_term].astype(np.int64) * (len(place) // BLOCK + 1) + self.at // BLOCK
        #: postings of a term's blocks: start of each, its block and largest weight; terms' first entries
        self.start = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]])) if len(cell) else np.zeros(0, int)
        self.block = self.at[self.start] // BLOCK
        self.largest = np.maximum.reduceat(self.weight, self.start) if len(cell) else np.zeros(0)
        self.first = np.searchsorted(term[by_term][self.start], np.arange(len(words) + 1))
        self.start = np.append(self.start, len(cell))
        self.found: dict[bytes, tuple[float, list[int]]] = {}

    def nearest(self, columns: np.ndarray, weights: np.ndarray, most: int = NEIGHBOURS) -> tuple[np.ndarray, np.ndarray]:
        """Places and cosines of the nearest examples; blocks in the order of their bounds, until none can beat the last of them."""
        own = [(self.first[c], self.first[c + 1], w) for c, w in zip(columns, weights)]
        bound = np.zeros(len(self.labels) // BLOCK + 1)
        for lo, hi, w in own:
            bound[self.block[lo:hi]] += w * self.largest[lo:hi]
        best, at = np.zeros(0), np.zeros(0, int)
        for b in np.argsort(-bound, kind="stable"):
            if bound[b] <= 0 or (len(best) >= most and bound[b] < best[most - 1] - 1e-12):
                break
            score = np.zeros(BLOCK)
            for lo, hi, w in own:
                k = lo + np.searchsorted(self.block[lo:hi], b)
                if k < hi and self.block[k] == b:
                    part = slice(self.start[k], self.start[k + 1])
                    score[self.at[part] - b * BLOCK] += w * self.weight[part]
            hit = np.flatnonzero(score)
            best, at = np.concatenate([best, score[hit]]), np.concatenate([at, hit + b * BLOCK])
            keep = np.lexsort((at, -best))[:most]
            best, at = best[keep], at[keep]
        return at, best

    def score(self, columns: np.ndarray, counts: np.ndarray) -> tuple[float, list[int]]:
        """Score and nearest examples' ids of one text's words; equal word counts are answered once."""
        key = columns.tobytes() + counts.tobytes()
        if key not in self.found:
            weights = (1 + np.log(counts)) * self.idf[columns]
            at, cosine = self.nearest(columns, weights / np.linalg.norm(weights))
            score = self.calibrated(self.vote(at, cosine))
            if len(self.found) > 50_000:
                self.found.clear()
            self.found[key] = score, [int(x) for x in self.ids[at[:3]]]
        return self.found[key]


    def vote(self, at: np.ndarray, cosine: np.ndarray) -> float:
        """Share of label 1 among neighbours, the nearer the heavier."""
        weight = (cosine > 1e-12) / (1.05 - np.clip(cosine, 0, 1))
        return float((weight * self.labels[at]).sum() / weight.sum()) if weight.sum() else self.bare

    def calibrated(self, vote: float) -> float:
        return float(np.interp(vote, *self.steps)) if len(self.steps[0]) else vote

    def calibrate(self, rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray) -> None:
        """Turn votes into shares of label 1, as the examples themselves show when each is left out of its own vote.

        rows and labels in the order they were given in. Votes are put into steps whose shares rise (pooling
        neighbours that don't); a step of n examples counts PRIOR more at its own mean vote.
        """
        votes = []
        for place, (columns, weights) in enumerate(rows):
            at, cosine = self.nearest(columns, weights, NEIGHBOURS + 1)
            own = self.given[at] != place
            votes.append(self.vote(at[own][:NEIGHBOURS], cosine[own][:NEIGHBOURS]))
        # equal votes are one step from the beginning
        level, which = np.unique(np.round(votes, 9), return_inverse=True) if votes else (np.zeros(0), np.zeros(0, int))
        n, ones = np.bincount(which, minlength=len(level)).astype(float), np.bincount(which, labels, minlength=len(level))
        steps: list[list[float]] = []  # sum of labels, examples, sum of votes
        for k in range(len(level)):
            steps.append([float(ones[k]), float(n[k]), float(level[k] * n[k])])
            while len(steps) > 1 and steps[-2][0] * steps[-1][1] >= steps[-1][0] * steps[-2][1]:
                last = steps.pop()
                steps[-1] = [a + b for a, b in zip(steps[-1], last)]
        x = np.array([v / n for _, n, v in steps])
        y = np.array([(s + PRIOR * v / n) / (n + PRIOR) for s, n, v in steps])
        self.steps = x, np.maximum.accumulate(y) if len(y) else y
        self.reliability = [(int(n), round(v / n, 4), round(s / n, 4)) for s, n, v in steps]


BEGINNING = np.uint64(0x9FB21C651E98DF25)


def term_hash(term: bytes) -> int:
    """Hash of a term: a word, or a beginning, which ends in "*"."""
    data = np.frombuffer(term.removesuffix(b"*"), np.uint8)
    h = run_hashes(data, np.array([0]), np.array([len(data)]))[0]
    return int(h ^ BEGINNING if term.endswith(b"*") else h)


def all_terms(block):
    """(lower-cased bytes, word starts, term ends, texts, hashes, is a beginning) of a block, one entry per occurrence."""
    data = LOWER[block.data]
    w = block.words(ALNUM, data)
    hasher, doc, size = RunHasher(data), w.doc, w.end - w.start
    parts = [(w.start, w.end, doc, hasher(w.start, w.end), np.zeros(len(w), bool))]
    for k in PREFIXES:
        at = np.flatnonzero(size > k)
        s = w.start[at]
        parts.append((s, s + k, doc[at], hasher(s, s + k) ^ BEGINNING, np.ones(len(at), bool)))
    return data, *(np.concatenate(x) for x in zip(*parts))


def select_terms(few: DataFrame) -> list[bytes]:
    """Terms of the sample (doc_id, y, text) whose presence goes with label 1.

    Equal texts of one label count once, so copies neither make a term nor outweigh one. Terms are listed from
    texts of label 1 only, those that could pass the test if no other text held them, and are then counted over
    the sample.
    """

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column(0)):
                data, start, end, doc, h, cut = all_terms(block)
                _, at = np.unique(mix(doc.astype(np.uint64) + np.uint64(1)) ^ h, return_index=True)
                yield pa.RecordBatch.from_arrays([pa.array([data[start[k] : end[k]].tobytes() + b"*" * bool(cut[k]) for k in at], pa.binary())], ["term"])

    few = few.select("text", "y").dropDuplicates()
    n, positive = few.agg(F.count("*"), F.sum("y")).first()
    positive = positive or 0
    negative = n - positive
    if not positive or not negative:
        return []
    often = few.filter("y = 1").select("text").mapInArrow(lean(spread), "term binary").groupBy("term").agg(F.count("*").alias("a"))
    # the largest chi-square that a texts of label 1 can give, when no text of label 0 holds the term
    often = often.filter(F.lit(float(n) * negative) * F.col("a") >= F.lit(CHI_SQUARE * positive) * (F.lit(n) - F.col("a")))
    listed = {bytes(r["term"]): r["a"] for r in often.collect()}
    terms = sorted(listed)
    total = frequencies(few, terms)[1]
    counts = {}
    for t, c in zip(terms, total):
        a = listed[t]
        gap = a * negative - (c - a) * positive
        if a >= MIN_SHARE * c and gap > 0 and (c == n or n * gap * gap >= CHI_SQUARE * positive * negative * c * (n - c)):
            counts[t] = (a, c)
    # a beginning tells nothing beside a longer term that stands in as many texts
    longer = {(t[:k] + b"*", n_) for t, n_ in counts.items() for k in PREFIXES if k < len(t.removesuffix(b"*"))}
    return sorted(t for t, n_ in counts.items() if (t, n_) not in longer)


def term_counts(block, hashes: np.ndarray, order: np.ndarray):
    """(text, column, count) of the terms of a sorted vocabulary in a block."""
    if not len(hashes):
        return np.zeros(0, int), np.zeros(0, int), np.zeros(0, int)
    _, _, _, doc, h, _ = all_terms(block)
    if not len(h):
        return np.zeros(0, int), np.zeros(0, int), np.zeros(0, int)
    # a table of the hashes' low bits first: few occurrences are of the vocabulary
    mask = np.uint64((1 << (16 * len(hashes)).bit_length()) - 1)
    low = np.zeros(int(mask) + 1, bool)
    low[hashes & mask] = True
    maybe = np.flatnonzero(low[h & mask])
    at = np.searchsorted(hashes, h[maybe])
    at[at == len(hashes)] = 0
    same = hashes[at] == h[maybe]
    key, count = np.unique(doc[maybe[same]] * len(hashes) + order[at[same]], return_counts=True)
    return key // len(hashes), key % len(hashes), count


def ranked_hashes(terms: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    hashes = np.array([term_hash(t) for t in terms], np.uint64)
    order = np.argsort(hashes)
    return hashes[order], order


def frequencies(docs: DataFrame, words: list[bytes]) -> tuple[int, np.ndarray]:
    """Number of documents, and how many hold each word, over all documents."""
    ranked, order = ranked_hashes(words)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, sums = 0, np.zeros(len(words), np.int64)
        for batch in batches:
            total += batch.num_rows
            for block in blocks(batch.column(0)):
                sums += np.bincount(term_counts(block, ranked, order)[1], minlength=len(words))
        at = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array([*at.tolist(), -1], pa.int32()), pa.array([*sums[at].tolist(), total], pa.int64())], ["word", "n"])

    got = {r["word"]: r["n"] for r in docs.select("text").mapInArrow(lean(count), "word int, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()}
    return got.get(-1, 0), np.array([got.get(k, 0) for k in range(len(words))], float)


def fit(docs: DataFrame, labels: DataFrame) -> Index:
    few = sample(docs, labels, "toxic", crc_class(F.col("doc_id"), MODULUS) != HELD_OUT, SAMPLE).select("doc_id", "y", "text")
    words = select_terms(few)
    n, df = frequencies(docs, words)
    idf = np.log((1 + n) / (1 + df)) + 1
    ranked, order = ranked_hashes(words)

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column(2)):
                doc, column, count = term_counts(block, ranked, order)
                cut = np.searchsorted(doc, np.arange(block.n + 1))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(block.first, block.n), batch.column(1).slice(block.first, block.n).cast(pa.int32()),
                     pa.array([column[a:b].astype(np.int32).tobytes() for a, b in zip(cut[:-1], cut[1:])], pa.binary()), pa.array([count[a:b].astype(np.int32).tobytes() for a, b in zip(cut[:-1], cut[1:])], pa.binary())],
                    ["doc_id", "y", "columns", "counts"],
                )

    rows = sorted((r["doc_id"], r["y"], bytes(r["columns"]), bytes(r["counts"])) for r in few.mapInArrow(lean(extract), "doc_id long, y int, columns binary, counts binary").collect())
    bare = [y for _, y, c, _ in rows if not c]
    all_y = [r[1] for r in rows]
    base = float(np.mean(bare)) if bare else float(np.mean(all_y)) if all_y else 0.0
    full = []
    for doc_id, y, c, m in rows:
        if c:
            column = np.frombuffer(c, np.int32)
            weight = (1 + np.log(np.frombuffer(m, np.int32))) * idf[column]
            full.append((doc_id, y, (column, weight / np.linalg.norm(weight))))
    index = Index(words, idf, np.array([r[1] for r in full], float), [r[2] for r in full], [r[0] for r in full], base)
    index.calibrate([r[2] for r in full], np.array([r[1] for r in full], float))
    return index


def score(docs: DataFrame, index: Index) -> DataFrame:
    """doc_id, score, evidence (words), nearest (ids of examples) of every document."""
    prepare(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix = shared.value
        for batch in batches:
            for block in blocks(batch.column(1)):
                doc, column, count = term_counts(block, ix.hashes, ix.order)
                cut = np.searchsorted(doc, np.arange(block.n + 1))
                scores, nearest, words = [ix.bare] * block.n, [None] * block.n, [""] * block.n
                for d in np.unique(doc):
                    a, b = cut[d], cut[d + 1]
                    if len(ix.labels):
                        scores[d], nearest[d] = ix.score(column[a:b], count[a:b])
                    words[d] = b",".join(ix.words[c] for c in column[a:b]).decode("utf-8", "ignore")
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(block.first, block.n).cast(pa.int64()), pa.array(scores, pa.float64()), pa.array(words, pa.string()), pa.array(nearest, pa.list_(pa.int64()))], ["doc_id", "score", "evidence", "nearest"]
                )

    return docs.select("doc_id", "text").mapInArrow(lean(run), "doc_id long, score double, evidence string, nearest array<long>")


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score(docs, fit(docs, labels)).select(
        "doc_id", (crc_class(F.col("doc_id"), MODULUS) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "evidence", "nearest"
    )


def op8_toxicity(spark, sf_dir: str) -> DataFrame:
    prepare(spark)
    return classify(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")).drop("evidence", "nearest")
