"""Order-dependent relational operators. Order is always a column; ties go on to a column that is unique."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F



def _names(keys: Sequence[str] | str) -> list[str]:
    return [keys] if isinstance(keys, str) else list(keys)


def top_k(df: DataFrame, by: Sequence[str] | str, order: Sequence[Column], k: int = 1) -> DataFrame:
    """The first k rows of each group; the window's limit reaches below the shuffle."""
    w = Window.partitionBy(*_names(by)).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(w)).filter(F.col("_rank") <= k).drop("_rank")


def keep_first(df: DataFrame, by: Sequence[str] | str, order: str) -> DataFrame:
    """The first row of each key, as a minimum over whole rows: combined before the shuffle, no sort."""
    keys = _names(by)
    rest = [c for c in df.columns if c not in keys and c != order]
    best = df.groupBy(*keys).agg(F.min(F.struct(order, *rest)).alias("_row"))
    return best.select(*[F.col(c) if c in keys else F.col(f"_row.{c}").alias(c) for c in df.columns])


def keep_last(df: DataFrame, by: Sequence[str] | str, order: str) -> DataFrame:
    """The last row of each key, with first_<order>, the place where the key first stood."""
    keys = _names(by)
    rest = [c for c in df.columns if c not in keys and c != order]
    best = df.groupBy(*keys).agg(F.max(F.struct(order, *rest)).alias("_row"), F.min(order).alias(f"first_{order}"))
    return best.select(*[F.col(c) if c in keys else F.col(f"_row.{c}").alias(c) for c in df.columns], f"first_{order}")


def duplicates(df: DataFrame, by: str, order: str) -> DataFrame:
    """Rows that keep_first leaves out."""
    w = Window.partitionBy(by).orderBy(order)
    return df.withColumn("_rank", F.row_number().over(w)).filter("_rank > 1").drop("_rank")


def ranked_value(df: DataFrame, by: Sequence[str] | str, value: str, place: Column, name: str) -> DataFrame:
    """Per group the value at a place of its sorted values, from counts of equal values.

    Values are counted before they are shuffled and the running count finds the place, so a group is never
    collected into an array. place: a Column of _n, the group's number of values.
    """
    keys = _names(by)
    counted = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_c"))
    w = Window.partitionBy(*keys)
    run = counted.withColumn("_run", F.sum("_c").over(w.orderBy(value).rowsBetween(Window.unboundedPreceding, 0)))
    run = run.withColumn("_n", F.sum("_c").over(w))
    return run.filter(F.col("_run") > place).groupBy(*keys).agg(F.min(value).alias(name))


def upper_median(df: DataFrame, by: Sequence[str] | str, value: str, name: str = "upper_median") -> DataFrame:
    return ranked_value(df, by, value, F.floor(F.col("_n") / 2), name)


def floor_percentile(df: DataFrame, by: Sequence[str] | str, value: str, ratio: float, name: str = "percentile") -> DataFrame:
    return ranked_value(df, by, value, F.least(F.col("_n") - 1, F.floor(F.col("_n") * F.lit(ratio))), name)


def true_median(df: DataFrame, by: Sequence[str] | str, value: str, name: str = "median") -> DataFrame:
    """The mean of the middle two; 0 for a group without values."""
    return df.groupBy(*_names(by)).agg(F.coalesce(F.median(value), F.lit(0.0)).alias(name))


def first_mode(df: DataFrame, by: Sequence[str] | str, value: str, order: str, name: str = "mode") -> DataFrame:
    """The most frequent value; of several, the one that stood first. Null, empty and 0 don't count."""
    keys = _names(by)
    text = F.col(value).cast("string")
    counted = df.filter(F.col(value).isNotNull() & ~text.isin("", "0", "0.0", "false")).groupBy(*keys, value).agg(F.count("*").alias("_c"), F.min(order).alias("_o"))
    return counted.groupBy(*keys).agg(F.min_by(value, F.struct(-F.col("_c"), F.col("_o"))).alias(name))


def islands(df: DataFrame, by: Sequence[str] | str, position: str, gap: float, tie: str | None = None, name: str = "island") -> DataFrame:
    """Number the runs of rows whose positions follow each other by at most gap."""
    w = Window.partitionBy(*_names(by)).orderBy(position, *([tie] if tie else []))
    jump = F.coalesce((F.col(position) - F.lag(position).over(w) > gap).cast("int"), F.lit(0))
    marked = df.withColumn("_jump", jump)
    return marked.withColumn(name, F.sum("_jump").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_jump")


def best_of_islands(df: DataFrame, by: Sequence[str] | str, position: str, gap: float, score: str) -> DataFrame:
    """One row of each island, the one with the best score, first on ties."""
    keys = _names(by)
    return top_k(islands(df, keys, position, gap), [*keys, "island"], [F.desc(score), F.asc(position)])


def overlap_dedupe(df: DataFrame, by: str, order: str, low: str, high: str, share: float = 0.55, near: float = 0.6) -> DataFrame:
    """Drop a row that any earlier row of its group, kept or not, overlaps by ``share`` of the narrower one, or whose
    centre is nearer than ``near`` of the wider one.
    """
    a, b = df.alias("a"), df.select(F.col(by).alias("_by"), F.col(order).alias("_order"), F.col(low).alias("_low"), F.col(high).alias("_high")).alias("b")
    wa, wb = F.col(high) - F.col(low), F.col("_high") - F.col("_low")
    overlap = F.greatest(F.lit(0.0), F.least(F.col(high), F.col("_high")) - F.greatest(F.col(low), F.col("_low")))
    apart = F.abs((F.col(high) + F.col(low)) / 2 - (F.col("_high") + F.col("_low")) / 2)
    hit = (overlap >= F.least(wa, wb) * F.lit(share)) | (apart < F.greatest(wa, wb) * F.lit(near))
    return a.join(b, (F.col(by) == F.col("_by")) & (F.col("_order") < F.col(order)) & hit, "left_anti")


def suffix_names(df: DataFrame, by: Sequence[str], order: str, stem: Column, ending: Column, name: str = "output_name") -> DataFrame:
    """stem.ending for a key's first row, stem_2.ending for its second, and so on."""
    w = Window.partitionBy(*by).orderBy(order)
    n = F.row_number().over(w)
    return df.withColumn(name, F.concat(stem, F.when(n > 1, F.concat(F.lit("_"), n.cast("string"))).otherwise(F.lit("")), ending))


def union_first(frames: Sequence[DataFrame], keys: Sequence[Column], order: str) -> DataFrame:
    """Rows of several passes, one for each key: of the earliest pass, then the earliest row in it."""
    tagged = None
    for k, frame in enumerate(frames):
        part = frame.withColumn("_pass", F.lit(k))
        tagged = part if tagged is None else tagged.unionByName(part)
    named = tagged.withColumns({f"_k{k}": c for k, c in enumerate(keys)})
    first = top_k(named, [f"_k{k}" for k in range(len(keys))], [F.asc("_pass"), F.asc(order)])
    return first.drop("_pass", *[f"_k{k}" for k in range(len(keys))])


def half_up(c: Column) -> Column:
    """Rounded to whole numbers, halves up on both sides of zero."""
    return F.floor(c + 0.5)


def except_seen(df: DataFrame, seen: DataFrame, on: Sequence[str] | str) -> DataFrame:
    return df.join(seen.select(*_names(on)).distinct(), _names(on), "left_anti")


def spread_out(df: DataFrame, by: str, order: str, x: str, y: str, near: float = 2.0) -> DataFrame:
    """Drop rows that an earlier row of the group is within ``near`` of, in both directions.

    Rows meet by cells of x, so those of a large group that are far apart are never compared.
    """
    cell = F.floor(F.col(x) / near)
    b = df.select(F.col(by).alias("_by"), F.col(order).alias("_order"), F.col(x).alias("_x"), F.col(y).alias("_y"), F.explode(F.array(cell - 1, cell, cell + 1)).alias("_cell"))
    close = (F.abs(F.col(x) - F.col("_x")) < near) & (F.abs(F.col(y) - F.col("_y")) < near)
    return df.join(b, (F.col(by) == F.col("_by")) & (cell == F.col("_cell")) & (F.col("_order") < F.col(order)) & close, "left_anti")
