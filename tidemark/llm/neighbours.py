"""Approximate nearest neighbours by a forest of hash prefixes.

Every row is indexed. Rows are dealt by a hash of their id into shards of about ``SHARD``; a shard has ``TREES``
trees, and a tree is the sorted array of the rows' hash strings, of ``BITS`` bits each, the signs of random
projections. For a query each tree gives the rows that share a prefix of its hash string. The search starts at
the longest prefix that anything matches and ascends in all trees at once, one bit at a time, until the trees
together have met ``SHARE`` of the shard's rows, and ``FEWEST`` of them in any case; all rows met are candidates
and are compared exactly, in double precision. After Bawa, Condie and Ganesan, "LSH Forest" (2005).

Queries are a stated set. They go to every shard by a shuffle and pass by its forest batch by batch, so a task
holds one shard and one batch, and nothing goes through the driver. Each shard answers with its best, and a top-k
over shards is the result. The work grows with queries times rows, as the stated set does with the table; what
the forest saves is 1 - SHARE of the comparisons. The nearer to isotropic the vectors, the larger SHARE has to
be: README gives the recall measured. No row is left out of a shard, whatever its group: equal vectors are looked
at once and bring their smallest ids, which are the only ones that can be among the k.

The answer depends on the table only, not on how its rows are partitioned.

Defined results: rows with a null id, and vectors that are null, empty, zero or hold null or non-finite
numbers take no part; vectors of different lengths are never compared; a query meets all rows but those with
its own id; equal rows count once; of different vectors under one id the smallest is the query and all are
candidates, the id listed once with its best score; ties go to the smaller id; an empty table gives an empty
result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import lean, prepare

TREES, BITS, SHARE, FEWEST = 64, 24, 0.4, 100
SHARD = 25_000


def planes(size: int) -> np.ndarray:
    return np.random.RandomState(4242 + size).standard_normal((size, TREES * BITS)).astype(np.float32)


def hash_strings(vectors: np.ndarray, normal: np.ndarray) -> np.ndarray:
    """(trees, rows): the signs of BITS projections as one number, the first bit highest."""
    out = np.zeros((TREES, len(vectors)), np.uint64)
    weights = np.uint64(1) << np.arange(BITS - 1, -1, -1, dtype=np.uint64)
    for lo in range(0, len(vectors), 4096):
        bits = (vectors[lo : lo + 4096].astype(np.float32) @ normal > 0).reshape(-1, TREES, BITS)
        out[:, lo : lo + 4096] = (bits * weights).sum(axis=2, dtype=np.uint64).T
    return out


class Forest:
    """A shard's trees."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int):
        # equal vectors: one row, with the k + 1 smallest ids
        order = np.lexsort((ids, *vectors.T[::-1]))
        ids, vectors = ids[order], vectors[order]
        fresh = np.concatenate([[True], (vectors[1:] != vectors[:-1]).any(axis=1)])
        head = np.flatnonzero(fresh)
        group = np.cumsum(fresh) - 1
        own = np.concatenate([[True], ids[1:] != ids[:-1]]) | fresh
        place = np.cumsum(own) - np.cumsum(own)[head][group]
        keep = own & (place <= k)
        self.ids = [list(x) for x in np.split(ids[keep], np.cumsum(np.bincount(group[keep]))[:-1])]
        self.vectors = vectors[head]
        self.norms = np.sqrt((self.vectors * self.vectors).sum(axis=1))
        self.normal = planes(vectors.shape[1])
        strings = hash_strings(self.vectors, self.normal)
        self.order = np.argsort(strings, axis=1)
        self.sorted = np.take_along_axis(strings, self.order, axis=1)
        self.want = min(len(head), max(FEWEST, int(np.ceil(SHARE * len(head)))))

    def ranges(self, strings: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """(trees, queries): first and end of the rows that share ``depth`` leading bits."""
        shift = np.uint64(BITS - depth)
        low = strings >> shift << shift
        a = np.stack([np.searchsorted(s, q) for s, q in zip(self.sorted, low)])
        b = np.stack([np.searchsorted(s, q + (np.uint64(1) << shift) - np.uint64(1), "right") for s, q in zip(self.sorted, low)])
        return a, b

    def candidates(self, queries: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """Each query with the rows that its ascent meets."""
        left = np.arange(len(queries))
        strings = hash_strings(queries, self.normal)
        # descend: no prefix longer than log2(rows) + some bits matches more than a few rows
        for depth in range(min(BITS, len(self.vectors).bit_length() + 8), -1, -1):
            a, b = self.ranges(strings[:, left], depth)
            done = (b - a).sum(axis=0) >= self.want
            for q in np.flatnonzero(done):
                met = np.zeros(len(self.vectors), bool)
                for t in range(TREES):
                    met[self.order[t, a[t, q] : b[t, q]]] = True
                rows = np.flatnonzero(met)
                done[q] = len(rows) >= self.want
                if done[q]:
                    yield int(left[q]), rows
            left = left[~done]
            if not len(left):
                return

    def search(self, ids: np.ndarray, queries: np.ndarray, k: int) -> Iterator[tuple[int, int, float]]:
        """(query's id, row's id, cosine) of each query's k best here."""
        norms = np.sqrt((queries * queries).sum(axis=1))
        for q, rows in self.candidates(queries):
            # a sum along each row: equal rows get equal scores, which a matrix product doesn't promise
            score = (self.vectors[rows] * queries[q]).sum(axis=1) / (self.norms[rows] * norms[q])
            if len(rows) > k + 1:
                least = np.partition(score, -(k + 1))[-(k + 1)]
                rows, score = rows[score >= least], score[score >= least]
            best = sorted((-s, i) for s, r in zip(score.tolist(), rows.tolist()) for i in self.ids[r] if i != ids[q])[:k]
            for s, i in best:
                yield int(ids[q]), int(i), -s


def usable(rows: DataFrame) -> DataFrame:
    """(id, v) of the rows that take part."""
    v = F.col("embedding").cast("array<double>")
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists("v", lambda x: x != 0)
    return rows.select(F.col("vec_id").cast("long").alias("id"), v.alias("v")).filter(F.col("id").isNotNull() & F.col("v").isNotNull()).filter(fine)


def matrix(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """(places, vectors) by length."""
    size = column.value_lengths().to_numpy()
    flat = column.flatten().to_numpy()
    start = np.cumsum(size) - size
    return [(at := np.flatnonzero(size == n), flat[(start[at][:, None] + np.arange(n)).ravel()].reshape(-1, n)) for n in np.unique(size)]


def nearest(rows: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each query (id, v) among rows (id, v)."""
    prepare(rows.sparkSession)
    shards = max(1, math.ceil(rows.count() / SHARD))
    dealt = rows.select(F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int").alias("shard"), F.lit(0).alias("role"), "id", "v")
    # of different vectors under one id the smallest asks
    asked = queries.groupBy("id").agg(F.min("v").alias("v")).select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.lit(1).alias("role"), "id", "v")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, forests = None, {}
        waiting: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        for batch in batches:
            shard, role, ids = (batch.column(c).to_numpy() for c in range(3))
            place = shard.astype(np.int64) * 2 + role
            head = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]])) if len(place) else []
            for lo, hi in zip(head, [*head[1:], len(place)]):
                part = matrix(batch.column(3).slice(lo, hi - lo))
                if shard[lo] != now:
                    now, forests, waiting = shard[lo], {}, {}
                if role[lo] == 0:
                    for at, vectors in part:
                        waiting.setdefault(vectors.shape[1], []).append((ids[lo + at], vectors))
                    continue
                for at, vectors in part:
                    n = vectors.shape[1]
                    if n in waiting:
                        parts = waiting.pop(n)
                        forests[n] = Forest(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]), k)
                    if n in forests:
                        found = list(forests[n].search(ids[lo + at], vectors, k))
                        if found:
                            q, i, s = zip(*found)
                            yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(i, pa.int64()), pa.array(s, pa.float64())], ["query_id", "vec_id", "score"])

    met = dealt.unionByName(asked).repartition("shard").sortWithinPartitions("shard", "role", "id").mapInArrow(lean(run), "query_id long, vec_id long, score double")
    best = met.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", place).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op2_nearest(spark, sf_dir: str) -> DataFrame:
    rows = usable(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return nearest(rows, rows.filter(F.col("id") % 50 == 0))
