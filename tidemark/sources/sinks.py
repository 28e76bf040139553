"""Where results go: job documents as JSON, output names by id, exports of a selection as zip files."""

from __future__ import annotations

import os
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import text
from tidemark.model import RESULTS
from tidemark.operators.ordered import suffix_names
from tidemark.operators.pages import by_page


def write_results(done: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Result rows as JSON lines, one folder for each job."""
    done.write.mode(mode).partitionBy("job_id").json(path)


def read_results(spark: SparkSession, path: str, schema: str = RESULTS) -> DataFrame:
    return spark.read.schema(schema).json(path)


def job(jobs: DataFrame, job_id: str) -> DataFrame:
    return jobs.filter(F.col("job_id") == job_id)


def output_names(done: DataFrame) -> DataFrame:
    """done (job_id, image_id, filename, shipment_id) with output_name: by id where there is one, else its own name.

    Of several images with one id the second is id_2, and so on, in the order of image_id; a name that another
    image has already (as an id may end in _2 itself) is passed over, so no two are equal. Images without an id
    keep their names, made distinct in the same way.
    """
    ending = F.when(text.extension(F.col("filename")) != "", F.concat(F.lit("."), text.extension(F.col("filename")))).otherwise(F.lit(".jpg"))
    plain = F.regexp_replace("filename", r"\.[^.]*$", "")
    stem = F.when(F.col("shipment_id").isNotNull(), text.safe_id_name(F.col("shipment_id"))).otherwise(plain)
    named = done.withColumn("_stem", stem).withColumn("_ending", ending).withColumn("_family", F.regexp_replace("_stem", r"(_[0-9]+)+$", ""))
    # only stems that differ in what a number adds can take each other's names
    family = ["job_id", "_family", "_ending"]
    mixed = named.groupBy(*family).agg(F.min("_stem").alias("_a"), F.max("_stem").alias("_b")).filter("_a != _b").select(*family)
    made = ["_stem", "_ending", "_family"]
    alone = suffix_names(named.join(mixed, family, "left_anti"), ["job_id", "_stem", "_ending"], "image_id", F.col("_stem"), F.col("_ending")).drop(*made)
    several = named.join(mixed, family, "left_semi").withColumn("_group", F.concat_ws("\0", *family))

    def first_free(rows: list[dict]) -> list[tuple]:
        taken: set[str] = set()
        last: dict[str, int] = {}
        out = []
        for r in rows:
            name, n = r["_stem"], last.get(r["_stem"], 1)
            while name in taken:
                n += 1
                name = f"{r['_stem']}_{n}"
            last[r["_stem"]] = n
            taken.add(name)
            out.append((r["job_id"], r["image_id"], name + r["_ending"]))
        return out

    picked = by_page(several.select("_group", "job_id", "image_id", "_stem", "_ending"), first_free, "job_id string, image_id string, output_name string", "_group", "image_id")
    own = several.drop(*made, "_group").join(picked.withColumnsRenamed({"job_id": "_job", "image_id": "_image"}), F.col("job_id").eqNullSafe(F.col("_job")) & (F.col("image_id") == F.col("_image"))).drop("_job", "_image")
    return alone.unionByName(own.select(*alone.columns))


def selected(done: DataFrame, wanted: DataFrame) -> DataFrame:
    """Results that a list of names (output_name) asks for; folders in the names don't count."""
    names = wanted.select(text.file_name(F.col("output_name")).alias("output_name"))
    return done.join(names.distinct(), "output_name", "left_semi")


def copy_files(files: DataFrame, names: DataFrame, folder: str) -> DataFrame:
    """Copy the files (image_id, content) that names (image_id, output_name) lists into a folder; (output_name, length) of each.

    For inputs that failed or wait for review, kept under their names. The folder is any URL that pyarrow's file
    systems know. A task that is run again writes the same bytes to the same place. The copies are made when the
    result is used.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        for batch in batches:
            for name, content in zip(*(c.to_pylist() for c in batch.columns)):
                with store.open_output_stream(f"{root}/{name}") as out:
                    out.write(content)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(c) for c in batch.column(1).to_pylist()], pa.int64())], ["output_name", "length"])

    rows = files.select("image_id", "content").join(names.select("image_id", text.file_name(F.col("output_name")).alias("output_name")), "image_id")
    return rows.select("output_name", "content").mapInArrow(run, "output_name string, length long")


def zip_files(paths: list[str], target: str) -> int:
    """Pack files under their plain names; returns the archive's size. For a job's exports, beside the engine."""
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED, compresslevel=9) as out:
        for path in paths:
            out.write(path, os.path.basename(path))
    return os.path.getsize(target)
