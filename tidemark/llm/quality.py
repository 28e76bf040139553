"""Quality by nearest-neighbour voting on latent-semantic vectors.

Terms are shapes of words (letters, digits and marks with runs collapsed), pairs of neighbouring shapes,
word lengths, and marks for word pairs that the same text already had; they say how a text is written, not
what it is about. Terms are hashed to ``TERMS`` columns and weighted by TF-IDF, with document frequencies
over all documents. The leading ``RANK`` singular directions of the labelled sample's matrix give the latent
space. The sample's vectors (at most ``SAMPLE`` of each label) are broadcast, every document's cosine with
all of them is computed exactly in blocks, and the ``NEIGHBOURS`` nearest vote with their similarity.

Defined results: a null or empty text, like any text without a vector, gets the sample's share of label 1;
without labelled rows every score is 0.5; ties between neighbours go to the earlier sample row; repeated
rows each get their row; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import fresh_names, lean, prepare
from tidemark.llm.labelled import crc_class, sample
from tidemark.llm.textvec import NOT_BLANK, Block, U, blocks, mix, run_hashes, shingles, unique_by_text

SAMPLE, TERMS, RANK, NEIGHBOURS, POWER = 1500, 2048, 48, 25, 8
THRESHOLD = 0.7
MODULUS, HELD_OUT = 4, 2

_CLASS = np.arange(256, dtype=np.uint8)
_CLASS[97:123] = 97
_CLASS[65:91] = 65
_CLASS[48:58] = 48
_CLASS[128:] = 97


def terms(block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, column, count) of a block's terms, by text and column."""
    w = block.words(NOT_BLANK)
    doc = w.doc
    kinds = _CLASS[block.data]
    # letters of two bytes: capitals of the Latin-1 range, else small ones; the second byte is dropped below as a run
    lead = np.flatnonzero(block.data == 0xC3)
    lead = lead[lead + 1 < len(block.data)]
    upper = lead[(block.data[lead + 1] >= 0x80) & (block.data[lead + 1] <= 0x9E) & (block.data[lead + 1] != 0x97)]
    kinds[upper] = kinds[upper + 1] = 65
    keep = np.ones(len(kinds), bool)
    keep[1:] = kinds[1:] != kinds[:-1]
    keep[w.start] = True
    place = np.concatenate([[0], np.cumsum(keep)])
    shape = run_hashes(kinds[keep], place[w.start], place[w.end])
    pair = shingles(shape, 2)
    same = doc[1:] == doc[:-1]
    size = np.floor(np.log2((w.end - w.start).clip(1))).astype(U)
    words2 = shingles(w.hashes(), 2)
    pairs_doc, _ = unique_by_text(doc[:-1][same], words2[same])
    distinct = np.bincount(pairs_doc, minlength=block.n)
    total = np.bincount(doc[:-1][same], minlength=block.n)
    column = np.concatenate([shape, pair[same], mix(size + U(7))]) % U(TERMS - 8)
    owner = np.concatenate([doc, doc[:-1][same], doc])
    key, count = np.unique(owner * TERMS + column.astype(np.int64), return_counts=True)
    extra = [(np.arange(block.n) * TERMS + TERMS - 1, total - distinct), (np.arange(block.n) * TERMS + TERMS - 2, distinct)]
    for k, n in extra:
        key, count = np.concatenate([key, k[n > 0]]), np.concatenate([count, n[n > 0]])
    order = np.argsort(key)
    return key[order] // TERMS, key[order] % TERMS, count[order]


def frequencies(docs: DataFrame) -> tuple[int, np.ndarray]:
    """Number of documents, and of documents per column; one row per column leaves each task."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, sums = 0, np.zeros(TERMS, np.int64)
        for batch in batches:
            total += batch.num_rows
            for block in blocks(batch.column(0)):
                sums += np.bincount(terms(block)[1], minlength=TERMS)
        yield pa.RecordBatch.from_arrays([pa.array([*range(TERMS), -1], pa.int32()), pa.array([*sums.tolist(), total], pa.int64())], ["term", "n"])

    out, total = np.zeros(TERMS), 0
    for r in docs.select("text").mapInArrow(lean(count), "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).collect():
        if r["term"] < 0:
            total = r["n"]
        else:
            out[r["term"]] = r["n"]
    return total, out


def project(parts: tuple[np.ndarray, np.ndarray, np.ndarray], n: int, idf: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """Latent vectors of length 1 (or 0) of n texts."""
    doc, column, count = parts
    weight = (1 + np.log(count)) * idf[column]
    out = np.zeros((n, basis.shape[1]))
    if len(doc):
        head = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
        out[doc[head]] = np.add.reduceat(basis[column] * weight[:, None], head)
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.where(norm > 1e-9, norm, 1) * (norm > 1e-9)


class Model:
    def __init__(self, idf: np.ndarray, rows: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]):
        """rows: (label, columns, counts) of the sample."""
        self.idf = idf
        self.labels = np.array([r[0] for r in rows], float)
        self.prior = float(self.labels.mean()) if rows else 0.5
        matrix = np.zeros((len(rows), TERMS))
        for k, (_, column, count) in enumerate(rows):
            matrix[k, column] = (1 + np.log(count)) * idf[column]
        matrix /= np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), 1e-12)
        _, vectors = np.linalg.eigh(matrix.T @ matrix)
        self.basis = np.ascontiguousarray(vectors[:, ::-1][:, :RANK])
        latent = matrix @ self.basis
        norm = np.linalg.norm(latent, axis=1, keepdims=True)
        self.latent = (latent / np.where(norm > 1e-9, norm, 1)).astype(np.float32)

    def score(self, z: np.ndarray) -> np.ndarray:
        out = np.full(len(z), self.prior)
        known = np.flatnonzero(np.abs(z).sum(axis=1) > 0)
        if not len(self.labels) or not len(known):
            return out
        k = min(NEIGHBOURS, len(self.labels))
        for lo in range(0, len(known), 512):
            at = known[lo : lo + 512]
            cosine = z[at].astype(np.float32) @ self.latent.T
            near = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
            weight = np.clip(np.take_along_axis(cosine, near, axis=1), 0, 1).astype(float) ** POWER
            total = weight.sum(axis=1)
            out[at] = np.where(total > 0, (weight * self.labels[near]).sum(axis=1) / np.where(total > 0, total, 1), self.prior)
        return np.clip(out, 0, 1)


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Fit on rows that aren't held out; what reaches the driver is bounded by SAMPLE and TERMS."""

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column(2)):
                doc, column, count = terms(block)
                cut = np.searchsorted(doc, np.arange(block.n + 1))
                rows = [(column[a:b].astype(np.int32).tobytes(), count[a:b].astype(np.int32).tobytes()) for a, b in zip(cut[:-1], cut[1:])]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(block.first, block.n), batch.column(1).slice(block.first, block.n).cast(pa.int32()), pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.binary())],
                    ["doc_id", "y", "columns", "counts"],
                )

    n, df = frequencies(docs)
    idf = np.log((1 + n) / (1 + df)) + 1
    few = sample(docs, labels, "quality", crc_class(F.col("doc_id"), MODULUS) != HELD_OUT, SAMPLE, per_label=True).select("doc_id", "y", "text")
    rows = sorted((r["doc_id"], r["y"], bytes(r["columns"]), bytes(r["counts"])) for r in few.mapInArrow(lean(extract), "doc_id long, y int, columns binary, counts binary").collect())
    return Model(idf, [(y, np.frombuffer(c, np.int32), np.frombuffer(m, np.int32)) for _, y, c, m in rows])


def score(docs: DataFrame, model: Model) -> tuple[DataFrame, str]:
    """docs with one more column, and its name, which is none of theirs; all columns stay."""
    prepare(docs.sparkSession)
    (name,) = fresh_names(docs.columns, ["quality_score"])
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")
    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            parts = [m.score(project(terms(block), block.n, m.idf, m.basis)) for block in blocks(batch.column(at))]
            got = np.concatenate(parts) if parts else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(got, pa.float64())], [*batch.schema.names, name])

    return docs.mapInArrow(lean(run), schema), name


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    scored, name = score(docs.select("doc_id", "text"), fit(docs, labels))
    return scored.select(
        "doc_id", (crc_class(F.col("doc_id"), MODULUS) == HELD_OUT).alias("held_out"), F.col(name).alias("score"), (F.col(name) >= THRESHOLD).cast("int").alias("predicted")
    )


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows whose score reaches the threshold, with their own columns."""
    scored, name = score(docs, fit(docs, labels))
    return scored.filter(F.col(name) >= THRESHOLD).drop(name)


def op3_quality(spark, sf_dir: str) -> DataFrame:
    prepare(spark)
    return classify(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
