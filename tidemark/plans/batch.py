"""A whole job: sheet and words to results, proposals and the job's row."""

from __future__ import annotations

import argparse
import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import reconcile
from tidemark.plans.rollup import rollup
from tidemark.sources import sheet, sinks


@dataclass
class Job:
    results: DataFrame
    corrections: DataFrame
    counts: DataFrame
    warnings: DataFrame


def reconcile_batch(words: DataFrame, images: DataFrame, rows: DataFrame, job_id: str = "job", rasters: DataFrame | None = None) -> Job:
    """words, images as in ``tidemark.model``; rows: a sheet's (row_number, cells)."""
    mapping, warnings = sheet.mapping(rows)
    done = reconcile.results(words, images, mapping, rasters).withColumn("job_id", F.lit(job_id))
    named = sinks.output_names(done)
    return Job(named, reconcile.proposed_corrections(done), rollup(done), warnings)


def main(args: list[str] | None = None) -> None:
    """``python -m tidemark.plans.batch WORDS IMAGES SHEET OUT``: tables as Parquet, the sheet as xlsx or csv."""
    p = argparse.ArgumentParser(description=main.__doc__)
    for name in ("words", "images", "sheet", "out"):
        p.add_argument(name)
    a = p.parse_args(args)
    spark = SparkSession.builder.getOrCreate()
    rows = sheet.csv_rows(spark, a.sheet) if a.sheet.endswith(".csv") else sheet.workbook_rows(spark, a.sheet)
    job = reconcile_batch(spark.read.parquet(a.words), spark.read.parquet(a.images), rows)
    job.results.write.mode("overwrite").parquet(f"{a.out}/results")
    job.corrections.write.mode("overwrite").parquet(f"{a.out}/corrections")
    print(json.dumps([r.asDict() for r in job.counts.collect()]))


if __name__ == "__main__":
    main()
