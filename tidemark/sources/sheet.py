"""Reference sheets of id and weight: first sheet of a workbook, or CSV, as rows with warnings.

A workbook is a zip of XML; the reader is a Python data source, so ``spark.read.format("workbook")`` works and
each workbook is one task. A sheet is a form that people fill in, so one file is small; many files are many
partitions.
"""

from __future__ import annotations

import csv
import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.config import INTAKE, IntakeConfig
from tidemark.operators.ordered import keep_first
from tidemark.session import ship_package

ID_WORDS = re.compile(r"\b(id|awb|lr|shipment|reference)\b")
CELLS = "path string, row_number int, cells array<string>"


def _column(ref: str) -> int:
    """0 for A, 1 for B, 26 for AA."""
    n = 0
    for c in re.match("[A-Z]+", ref)[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def _texts(node: ElementTree.Element) -> str:
    return "".join(t.text or "" for t in node.iter() if _local(t.tag) == "t")


def first_sheet(book: zipfile.ZipFile) -> str:
    """Path of the first sheet by the workbook's own order."""
    names = set(book.namelist())
    try:
        sheets = [e for e in ElementTree.fromstring(book.read("xl/workbook.xml")).iter() if _local(e.tag) == "sheet"]
        links = {e.get("Id"): e.get("Target") for e in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels")).iter() if e.get("Id")}
        target = links[next(v for k, v in sheets[0].attrib.items() if _local(k) == "id")]
        path = target.lstrip("/") if target.startswith("/") else f"xl/{target}"
        if path in names:
            return path
    except (KeyError, IndexError, StopIteration):
        pass
    found = sorted(n for n in names if re.fullmatch(r"xl/worksheets/[^/]+\.xml", n))
    if not found:
        raise ValueError("the workbook has no sheets")
    return found[0]


def read_cells(content: bytes) -> Iterator[tuple[int, list[str | None]]]:
    """(row number, cells) of the first sheet, rows without a value left out."""
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        shared = []
        if "xl/sharedStrings.xml" in book.namelist():
            shared = [_texts(e) for e in ElementTree.fromstring(book.read("xl/sharedStrings.xml")) if _local(e.tag) == "si"]
        sheet = ElementTree.fromstring(book.read(first_sheet(book)))
    last = 0
    for row in (e for e in sheet.iter() if _local(e.tag) == "row"):
        last = int(row.get("r") or last + 1)
        cells: dict[int, str | None] = {}
        for k, c in enumerate(e for e in row if _local(e.tag) == "c"):
            value = next((v.text for v in c if _local(v.tag) == "v"), None)
            kind = c.get("t")
            if kind == "s" and value is not None:
                value = shared[int(value)]
            elif kind == "inlineStr":
                value = _texts(c)
            elif kind == "b" and value is not None:
                value = "true" if value == "1" else "false"
            cells[_column(c.get("r")) if c.get("r") else k] = value
        if any(v is not None for v in cells.values()):
            yield last, [cells.get(k) for k in range(max(cells) + 1)]


def workbook_rows(spark: SparkSession, path: str) -> DataFrame:
    """(path, row_number, cells) of workbooks; the files are read by Spark's own binary source, so any store works."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(*(c.to_pylist() for c in batch.columns)):
                rows = list(read_cells(content))
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(rows), pa.string()), pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.list_(pa.string()))], ["path", "row_number", "cells"])

    ship_package(spark)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.xlsx").load(path).select("path", "content")
    return files.mapInArrow(run, CELLS)


def register(spark: SparkSession) -> None:
    """Make ``spark.read.format("workbook").load(path)`` available: one workbook that the driver can open, as (row_number, cells)."""
    from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

    class Reader(DataSourceReader):
        def __init__(self, path: str):
            self.path = path

        def partitions(self):
            # planned where the driver is, which has the file; the task gets its bytes
            with open(self.path.removeprefix("file://"), "rb") as f:
                return [InputPartition(f.read())]

        def read(self, partition):
            yield from read_cells(partition.value)

    class Workbook(DataSource):
        @classmethod
        def name(cls):
            return "workbook"

        def schema(self):
            return "row_number int, cells array<string>"

        def reader(self, schema):
            return Reader(self.options["path"])

    spark.dataSource.register(Workbook)


def csv_rows(spark: SparkSession, path: str) -> DataFrame:
    """(path, row_number, cells) of small CSV files, one task each; quoted cells may hold commas and line ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(*(c.to_pylist() for c in batch.columns)):
                rows = [[c.strip() or None for c in row] for row in csv.reader(io.StringIO(content))]
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(rows), pa.string()), pa.array(range(1, len(rows) + 1), pa.int32()), pa.array(rows, pa.list_(pa.string()))], ["path", "row_number", "cells"])

    ship_package(spark)
    return spark.read.text(path, wholetext=True).select(F.input_file_name(), "value").mapInArrow(run, CELLS)


def header_columns(cells: list[str | None]) -> tuple[int, int]:
    """Places of the id and the weight column; one header may serve as both."""
    names = [(c or "").strip().lower() for c in cells]
    ids = [k for k, n in enumerate(names) if ID_WORDS.search(n)]
    weights = [k for k, n in enumerate(names) if "weight" in n]
    if not ids or not weights:
        raise ValueError('no "ID" and "Weight" columns in the first row of the sheet')
    return ids[0], weights[0]


def mapping(rows: DataFrame, config: IntakeConfig = INTAKE) -> tuple[DataFrame, DataFrame]:
    """(row_number, id, weight) and (row_number, message) of a sheet's rows (row_number, cells).

    Of equal ids the first stays. A weight that isn't a number never claims its id. A blank weight is 0 in the
    compatible reading and a warning in the strict one. Numbers may be written in hexadecimal, octal or binary
    with a prefix, and true and false count as 1 and 0. Rows of several files are refused: row numbers and the
    first of equal ids would mean nothing across them.
    """
    if "path" in rows.columns and rows.select("path").distinct().limit(2).count() > 1:
        raise ValueError("rows of more than one sheet; filter by path")
    head = rows.filter("row_number = 1").select("cells").first()
    at_id, at_weight = header_columns(list(head["cells"]) if head else [])
    raw = F.trim(F.coalesce(F.get("cells", F.lit(at_weight)), F.lit("")))
    radix = F.lower(F.substring(raw, 1, 2))
    number = (
        F.when(raw == "", F.lit(0.0) if config.blank_weight_is_zero else F.lit(None).cast("double"))
        .when(raw == "true", 1.0)
        .when(raw == "false", 0.0)
        .when(raw.rlike("^0[xX][0-9a-fA-F]+$"), F.conv(F.substring(raw, F.lit(3), F.length(raw)), 16, 10).try_cast("double"))
        .when(raw.rlike("^0[oO][0-7]+$"), F.conv(F.substring(raw, F.lit(3), F.length(raw)), 8, 10).try_cast("double"))
        .when((radix == "0b") & raw.rlike("^0[bB][01]+$"), F.conv(F.substring(raw, F.lit(3), F.length(raw)), 2, 10).try_cast("double"))
        .when(raw.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"), raw.try_cast("double"))
    )
    body = rows.filter("row_number > 1").select("row_number", F.trim(F.get("cells", F.lit(at_id))).alias("id"), raw.alias("_raw"), number.alias("weight")).filter("id is not null and id != ''")
    good = body.filter("weight is not null")
    kept = keep_first(good.select("id", "row_number", "weight"), "id", "row_number").select("row_number", "id", "weight")
    again = good.withColumn("_n", F.row_number().over(Window.partitionBy("id").orderBy("row_number"))).filter("_n > 1")
    bad = body.filter("weight is null").select("row_number", F.format_string('Row %d: weight "%s" is not numeric, skipped', "row_number", "_raw").alias("message"))
    twice = again.select("row_number", F.format_string('Row %d: duplicate ID "%s", keeping first occurrence', "row_number", "id").alias("message"))
    return kept, bad.unionByName(twice)
