"""Batch roll-ups: what a job has done, from its results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def rollup(results: DataFrame) -> DataFrame:
    """Counts of each job; whatever isn't ok is unmatched, errors too. One partial and one final aggregate."""
    ok = F.coalesce(F.col("status") == "ok", F.lit(False))
    return results.groupBy("job_id").agg(F.count("*").alias("processed_files"), F.count_if(ok).alias("matched_files"), F.count_if(~ok).alias("unmatched_files"))


def durations(jobs: DataFrame) -> DataFrame:
    """jobs with duration_ms: from start, or creation if it never started, to the end; null while it runs."""
    begun = F.coalesce("started_at", "created_at")
    return jobs.withColumn("duration_ms", F.unix_millis("completed_at") - F.unix_millis(begun))


def job_table(jobs: DataFrame, results: DataFrame) -> DataFrame:
    """Jobs with their counts and status: queued, processing, completed, or failed if the job says why."""
    done = jobs.join(rollup(results), "job_id", "left").fillna(0, ["processed_files", "matched_files", "unmatched_files"])
    status = (
        F.when(F.col("error").isNotNull(), "failed").when(F.col("started_at").isNull(), "queued").when(F.col("processed_files") < F.col("total_files"), "processing").otherwise("completed")
    )
    return durations(done).withColumn("status", status).withColumn("zip_ready", F.col("status") == "completed")


def shown(results: DataFrame, which: str = "all") -> DataFrame:
    """Results for display: all, ok, error, or review, which is neither of the two."""
    if which == "all":
        return results
    if which in ("ok", "error"):
        return results.filter(F.col("status") == which)
    return results.filter(~F.coalesce(F.col("status").isin("ok", "error"), F.lit(False)))
