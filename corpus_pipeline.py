"""A training corpus from raw documents: five stages, each an operator of ``tidemark.llm``.

Each stage takes (spark, docs, sf_dir) and its result is written as Parquet and read again for the next.
All but the last return the columns of documents; the last returns each document that the mix takes, with
its text and how many of its words are taken, repeats counted.

Defined results, by stage:

- quality classifier: a null, empty or blank text scores as the labelled sample's share of label 1 and stays or
  goes by that; equal rows score alike.
- near-duplicates: of equal rows one stays; texts without words are no duplicates and all stay; of a group the
  smallest id stays, a null id only if there is no other.
- suffix-array dedup: texts under 200 bytes stay as they are, nulls too; bytes of a character that a cut splits
  are lost with it; documents of which nothing is left go.
- benchmark decontamination: null and empty texts stay; items without words match nothing.
- mixing: texts without words take nothing and go; equal rows and different texts under one id, null ids too,
  each have their own share.

Texts of any length are worked on whole. Empty tables give empty results; without labels every score is 0.5, so
nothing passes the quality stage. All columns of documents pass through the first four stages, whatever their
names; the last returns doc_id, text, lang, source, size, taken and repeats.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import cut, delete, shared_folder, table
from tidemark.llm.decontaminate import drop_leaks
from tidemark.llm.mixture import mix
from tidemark.llm.near_dedup import keep_one
from tidemark.llm.quality import keep_good
from tidemark.llm.suffix_dedup import strip_repeats


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return keep_good(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays (five-word shingles, similarity 0.8 or more)."""
    return keep_one(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Byte strings of 200 that also stand elsewhere are cut out; documents with nothing left go."""
    out = strip_repeats(docs)
    return out.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in docs.columns else out


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: documents with their text, the words taken and how often the text is repeated; what it takes nothing of goes."""
    key = ["doc_id", "source", "_key"]
    keyed = docs.select("doc_id", "text", "lang", "source").withColumn("_key", F.xxhash64("text", "lang"))
    shares = mix(keyed, also=["_key"]).groupBy(*key, "size", "taken", "repeats").agg(F.count("*").alias("_n"))
    rows = F.sum("_n").over(Window.partitionBy(*key))
    shares = cut(shares.withColumn("_rows", rows).filter("taken > 0").withColumnsRenamed({c: f"_of_{c}" for c in key}))
    same = F.lit(True)
    for c in key:
        same &= F.col(c).eqNullSafe(F.col(f"_of_{c}"))
    out = ["doc_id", "text", "lang", "source", "size", "taken", "repeats"]
    single = keyed.join(shares.filter("_rows = 1"), same).select(*out)
    # equal rows: one of them, as often as each share is given
    several = shares.filter("_rows > 1")
    if several.isEmpty():
        return single
    one = keyed.join(several.select(*[f"_of_{c}" for c in key]).distinct(), same).dropDuplicates(key).select(*key, "text", "lang")
    return single.unionByName(one.join(several, same).withColumn("_k", F.explode(F.sequence(F.lit(1), F.col("_n").cast("int")))).select(*out))


STAGES = [
    ("quality classifier", quality),
    ("near-duplicates", near_duplicates),
    ("suffix-array dedup", repeated_passages),
    ("benchmark decontamination", decontamination),
    ("mixing", mixing),
]

#: The quality and near-duplicate stages have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            out.write.parquet(f"{folder}/{k}")
            docs = spark.read.parquet(f"{folder}/{k}")
            if k:
                delete(spark, f"{folder}/{k - 1}")
    return out  # reads the last folder, which therefore stays
