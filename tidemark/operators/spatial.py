"""Joins of boxes and intervals: nearest below, containment, pairs, bands.

Range conditions are joined by cell: the axis is cut into cells as wide as the condition reaches, both sides
meet by equality of cells, and the condition is tested within. No pair outside neighbouring cells is made.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.ordered import top_k


def nearest_after(left: DataFrame, right: DataFrame, by: list[str], at: str, then: str, reach: float, tie: str, key: list[str] | None = None) -> DataFrame:
    """Each left row, told apart by key (all its columns, if none is given), with the nearest right row of its group at ``then`` in [at, at + reach]; ties by ``tie``.

    Columns of right other than ``by`` keep their names, so they have to differ from left's.
    """
    cell = F.floor(F.col(at) / reach)
    starts = left.withColumn("_cell", F.explode(F.array(cell, cell + 1)))
    ends = right.withColumn("_cell", F.floor(F.col(then) / reach))
    gap = F.col(then) - F.col(at)
    hits = starts.join(ends, [*by, "_cell"]).withColumn("gap", gap).filter(F.col("gap").between(0, reach))
    return top_k(hits, key or left.columns, [F.asc("gap"), F.asc(tie)]).drop("_cell")


def within(points: DataFrame, bands: DataFrame, by: list[str], at: str, low: str, high: str, width: float) -> DataFrame:
    """Points with every band of their group that holds them; ``width`` is the cells' width."""
    spread = bands.withColumn("_cell", F.explode(F.sequence(F.floor(F.col(low) / width), F.floor(F.col(high) / width))))
    placed = points.withColumn("_cell", F.floor(F.col(at) / width))
    return placed.join(spread, [*by, "_cell"]).filter(F.col(at).between(F.col(low), F.col(high))).drop("_cell")


def band_join(left: DataFrame, right: DataFrame, a: str, b: str, near: float) -> DataFrame:
    """Pairs with \\|a - b\\| < near."""
    spread = right.withColumn("_cell", F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda d: F.floor(F.col(b) / near) + d)))
    return left.withColumn("_cell", F.floor(F.col(a) / near)).join(spread, "_cell").filter(F.abs(F.col(a) - F.col(b)) < near).drop("_cell")


def best_pair(df: DataFrame, by: str, order: str, ok: Column, rank: list[Column]) -> DataFrame:
    """Of each group the best pair of rows a before b, both as structs; ok and rank are Columns of a and b."""
    whole = F.struct(*df.columns)
    a = df.select(F.col(by).alias(by), whole.alias("a"))
    b = df.select(F.col(by).alias("_by"), whole.alias("b"))
    pairs = a.join(b, (F.col(by) == F.col("_by")) & (F.col(f"a.{order}") < F.col(f"b.{order}"))).drop("_by").filter(ok)
    return top_k(pairs, by, [*rank, F.asc(f"a.{order}"), F.asc(f"b.{order}")])


def closest_pair(df: DataFrame, by: str, order: str, value: str) -> DataFrame:
    """Of each group the two rows whose values are nearest, both as structs with their gap; ties to the smaller orders.

    The nearest two stand side by side in the order of values, so no pairs are made: rows of a value that stands
    several times are next to each other, and with a gap above 0 no value does.
    """
    w = Window.partitionBy(by).orderBy(value, order)
    row = F.struct(*df.columns)
    near = df.select(F.col(by), row.alias("_b"), F.lag(row).over(w).alias("_a")).filter("_a is not null")
    first = F.col(f"_a.{order}") < F.col(f"_b.{order}")
    near = near.select(by, F.when(first, F.col("_a")).otherwise(F.col("_b")).alias("a"), F.when(first, F.col("_b")).otherwise(F.col("_a")).alias("b"))
    near = near.withColumn("gap", F.abs(F.col(f"a.{value}") - F.col(f"b.{value}")))
    return top_k(near, by, [F.asc("gap"), F.asc(f"a.{order}"), F.asc(f"b.{order}")])


def overlap_share(ax0: Column, ay0: Column, ax1: Column, ay1: Column, b: Column) -> Column:
    """Share of box a's area that box b covers."""
    w = F.greatest(F.lit(0.0), F.least(ax1, b["x1"]) - F.greatest(ax0, b["x0"]))
    h = F.greatest(F.lit(0.0), F.least(ay1, b["y1"]) - F.greatest(ay0, b["y0"]))
    area = (ax1 - ax0) * (ay1 - ay0)
    return F.when(area > 0, w * h / area).otherwise(0.0)


def not_covered(regions: DataFrame, anchors: DataFrame, by: str, share: float = 0.75) -> DataFrame:
    """Regions of which no anchor of the same page covers ``share`` or more."""
    r, a = regions.alias("r"), anchors.select(F.col(by).alias("_by"), F.col("bbox").alias("_box"))
    box = F.col("bbox")
    hit = overlap_share(box["x0"], box["y0"], box["x1"], box["y1"], F.col("_box")) >= share
    return r.join(a, (F.col(by) == F.col("_by")) & hit, "left_anti")
