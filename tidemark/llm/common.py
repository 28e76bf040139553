"""Shared plumbing of the operators: tables, Arrow maps, memory, the shared folder."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import cut, ensure_checkpoint_dir, ship_package

#: Most rows and bytes of an Arrow batch handed to Python; texts can be long, so batches stay small.
ARROW_ROWS, ARROW_BYTES = 2000, 16 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share, as a URL: where checkpoints go."""
    ensure_checkpoint_dir(spark)
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


def delete(spark: SparkSession, folder: str) -> None:
    """Delete a folder wherever Spark's file systems have it."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Let go of shuffle files that nothing needs any more, instead of whenever the driver collects its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def lean(run: Callable) -> Callable:
    """A map over Arrow batches that hands its memory back when the task ends.

    Workers stay for later tasks; what their allocator keeps would count beside the JVM's heap meanwhile.
    """

    def wrapped(batches: Iterator) -> Iterator:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim:
            trim(0)

    return wrapped


def prepare(spark: SparkSession) -> None:
    """Ship the code, and bound Arrow batches: long texts have to fit beside the vectors made from them."""
    ship_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))


def hidden(docs: DataFrame) -> DataFrame:
    """docs with its columns named c0, c1, ..., so that no name of a caller clashes with one made inside."""
    return docs.toDF(*(f"c{k}" for k in range(len(docs.columns))))


def fresh_names(have: list[str], wanted: list[str]) -> list[str]:
    """wanted, each with as many leading underscores as set it apart from the names in have, in any case of letters."""
    taken, out = {n.lower() for n in have}, []
    for name in wanted:
        name = f"_{name}"
        while name.lower() in taken:
            name = f"_{name}"
        out.append(name)
    return out


def ascii_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


__all__ = ["ascii_lower", "cut", "delete", "fresh_names", "hidden", "lean", "prepare", "release", "shared_folder", "table"]
