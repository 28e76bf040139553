"""Files that arrive while a job runs: results as a stream of files, counts as a stream of counts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from tidemark.plans.rollup import rollup


def read_stream(spark: SparkSession, folder: str, schema: str, kind: str = "json", per_trigger: int = 1000) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).format(kind).load(folder)


def run_available(source: DataFrame, process: Callable[[DataFrame], DataFrame], target: str, checkpoint: str) -> StreamingQuery:
    """Process all that is there in batches and stop; a batch's results replace themselves if it is run again."""

    def batch(part: DataFrame, number: int) -> None:
        process(part).write.mode("overwrite").parquet(f"{target}/batch={number}")

    return source.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def running_counts(results: DataFrame, name: str, checkpoint: str) -> StreamingQuery:
    """A job's counts as results come in, for whoever polls them."""
    return rollup(results).writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
