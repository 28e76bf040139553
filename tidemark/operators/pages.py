"""Tasks that see one page at a time, without a grouped map's cost for each page.

Rows are dealt and sorted by page, so a page's rows follow each other; a task cuts its stream where the page
changes and holds one page and one Arrow batch.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame

from tidemark.session import ship_package


def by_page(df: DataFrame, rule: Callable[[list[dict]], list[tuple]], schema: str, page: str = "image_id", order: str | list[str] = "word_ord") -> DataFrame:
    """Apply rule to each page's rows (as dicts, in order); it returns rows of the schema.

    Rows with a null page form a page of their own.
    """
    ship_package(df.sparkSession)
    target = df.sparkSession.createDataFrame([], schema).schema
    names = target.names

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            for values in zip(*columns):
                yield dict(zip(batch.schema.names, values))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        kinds = to_arrow_schema(target)
        out: list[tuple] = []
        for _, own in groupby(rows(batches), key=lambda r: r[page]):
            out += rule(list(own))
            if len(out) >= 1000:
                yield made(out, kinds)
                out = []
        if out:
            yield made(out, kinds)

    def made(out: list[tuple], kinds: pa.Schema) -> pa.RecordBatch:
        columns = list(zip(*out))
        return pa.RecordBatch.from_arrays([pa.array(c, kinds.field(n).type) for c, n in zip(columns, names)], names)

    # a number of tasks that adaptive execution leaves alone: pages are few bytes and much work
    tasks = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), df.sparkSession.sparkContext.defaultParallelism)
    return df.repartition(tasks, page).sortWithinPartitions(page, *([order] if isinstance(order, str) else order)).mapInArrow(run, schema)
