"""Numeric functions: position scores, quantile definitions, output formatting."""

from __future__ import annotations

from decimal import ROUND_HALF_UP, Decimal

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tidemark.config import RASTER


def upper_median(values: Column) -> Column:
    """Of n sorted values the one at place floor(n / 2), from 0; null if there is none."""
    ordered = F.sort_array(values)
    return F.get(ordered, F.floor(F.size(ordered) / 2).cast("int"))


def floor_percentile(values: Column, ratio: float) -> Column:
    """Of n sorted values the one at place floor(n * ratio), at most the last; 0 if there is none."""
    ordered = F.sort_array(values)
    place = F.least(F.size(ordered) - 1, F.floor(F.size(ordered) * F.lit(ratio)).cast("int"))
    return F.coalesce(F.when(F.size(ordered) > 0, F.get(ordered, F.greatest(place, F.lit(0)))), F.lit(0))


def position_score(x0: Column, y0: Column, x1: Column, y1: Column, width: Column, height: Column, median_height: Column) -> Column:
    """What a candidate's place on the page adds to its confidence: ids stand large, in the upper right."""
    mid_x, mid_y = (x0 + x1) / 2, (y0 + y1) / 2
    known = (F.coalesce(width, F.lit(0)) > 0) & (F.coalesce(height, F.lit(0)) > 0)
    band = F.when(mid_y <= height * 0.22, 30.0).when(mid_y <= height * 0.34, 12.0).otherwise(0.0)
    right = F.when(mid_x >= width * 0.38, 12.0).otherwise(0.0)
    tall = F.when(y1 - y0 >= median_height * 1.35, 8.0).otherwise(0.0)
    return F.when(known, band + right + tall).otherwise(0.0)


def header_score(confidence: Column, mid_x: Column, mid_y: Column, height_of: Column, length: Column, width: Column, height: Column) -> Column:
    """Score of a number in the page's header as the image's own id."""
    return (
        F.coalesce(confidence, F.lit(0.0))
        + F.when(mid_x >= width * 0.38, 35.0).otherwise(0.0)
        + F.when(mid_y <= height * 0.16, 20.0).otherwise(0.0)
        + F.when(length.between(8, 10), 18.0).otherwise(0.0)
        + F.least(F.lit(15.0), height_of)
    )


def ocr_scale(width: Column, height: Column, wanted: Column, limits=RASTER) -> Column:
    """The wanted enlargement, held below the raster limits, 1 at least."""
    w, h = F.greatest(width, F.lit(1)), F.greatest(height, F.lit(1))
    return F.greatest(F.lit(1.0), F.least(wanted, F.lit(float(limits.max_side)) / F.greatest(w, h), F.sqrt(F.lit(float(limits.max_pixels)) / (w * h))))


def to_page(bbox: Column, scale: Column, left: Column | None = None, top: Column | None = None) -> Column:
    """A box of an enlarged part, in the page's coordinates."""
    left, top = F.lit(0.0) if left is None else left, F.lit(0.0) if top is None else top
    return F.struct(*[(bbox[n] / scale + (left if n[0] == "x" else top)).alias(n) for n in ("x0", "y0", "x1", "y1")])


def try_quarter_turns(width: Column, height: Column, limits=RASTER) -> Column:
    """Whether a page is portrait enough that it may be a landscape one on its side."""
    return F.coalesce((width > 0) & (height > width * F.lit(limits.portrait_ratio)), F.lit(False))


def fixed(value: float, places: int) -> str:
    """A number with so many decimals; the binary value is rounded, ties away from zero."""
    return format(Decimal(value).quantize(Decimal(1).scaleb(-places), rounding=ROUND_HALF_UP), "f")


def shortest(value: float) -> str:
    """A number rounded to two decimals (halves up), printed as short as it goes."""
    scaled = Decimal(value * 100 + 0.5).to_integral_value(rounding="ROUND_FLOOR") / 100
    text = format(scaled, "f")
    return text.rstrip("0").rstrip(".") if "." in text else text


@F.pandas_udf(StringType())
def format_weight(value: pd.Series, places: pd.Series) -> pd.Series:
    """Weights with the given decimals, or as short as two decimals go if that is 0; null stays null."""
    return pd.Series([None if pd.isna(v) else fixed(v, int(p)) if p and p > 0 else shortest(v) for v, p in zip(value, places)], dtype=object)


def own_decimals(value: Column) -> Column:
    """Decimals that a number is printed with; 3.0 has none."""
    text = F.regexp_replace(value.cast("decimal(38, 12)").cast("string"), r"\.?0+$", "")
    return F.when(F.instr(text, ".") > 0, F.length(text) - F.instr(text, ".")).otherwise(0)


def duration_text(ms: Column) -> Column:
    """Milliseconds for display: 850 ms, 4.1 s, 2m 05s."""
    seconds = ms / 1000
    minutes = F.floor(seconds / 60)
    return (
        F.when(ms.isNull(), F.lit(None).cast("string"))
        .when(ms < 1000, F.format_string("%d ms", ms.cast("long")))
        .when(seconds < 60, F.format_string("%.1f s", seconds))
        .otherwise(F.format_string("%dm %02ds", minutes.cast("long"), F.floor(seconds - minutes * 60).cast("long")))
    )


def bytes_text(n: Column) -> Column:
    return F.when(n < 1024, F.format_string("%d B", n.cast("long"))).when(n < 1024 * 1024, F.format_string("%.1f KB", n / 1024)).otherwise(F.format_string("%.1f MB", n / 1048576))


def status_text(status: Column) -> Column:
    return F.initcap(F.replace(status, F.lit("_"), F.lit(" ")))
