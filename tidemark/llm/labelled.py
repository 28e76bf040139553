"""Bounded, seeded samples of labelled documents, for the classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def crc_class(doc_id: Column, modulus: int) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus


def sample(docs: DataFrame, labels: DataFrame, label: str, learn_from: Column, most: int, per_label: bool = False, seed: int = 11) -> DataFrame:
    """(doc_id, y, text) of at most ``most`` labelled rows (of each label, if per_label) that may be learned from.

    Rows are taken in the order of a seeded hash of their id, so a rerun takes the same. Rows with a null id
    or label take no part. The sample's ids are few by the bound, so the join broadcasts them; of several texts
    under one id one is learned from, so the bound holds for the texts too.
    """
    rows = labels.select("doc_id", F.col(label).cast("int").alias("y")).filter(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1) & learn_from).dropDuplicates(["doc_id", "y"])
    rows = rows.withColumn("_h", F.xxhash64(F.col("doc_id"), F.lit(seed)))
    if per_label:
        taken = rows.filter("y = 0").orderBy("_h", "doc_id").limit(most).unionByName(rows.filter("y = 1").orderBy("_h", "doc_id").limit(most))
    else:
        taken = rows.orderBy("_h", "doc_id", "y").limit(most)
    rows = docs.select("doc_id", "text").join(F.broadcast(taken.select("doc_id", "y")), "doc_id")
    return rows.groupBy("doc_id", "y").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
