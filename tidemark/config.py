"""Tuned limits, in one place. Ratios are shares of the page's width or height."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class MatchConfig:
    """How ids and value fields are looked for. All values are fixed values of the label family."""

    min_confidence: float = 40.0
    fuzzy_distance: int = 1
    min_id_length: int = 4
    distance_penalty: float = 35.0
    vertical_window: float = 0.18
    horizontal_tolerance: float = 120.0
    max_chain_length: int = 20


@dataclass(frozen=True)
class IntakeConfig:
    """Limits of a batch and the file types it may hold."""

    max_files: int = 1000
    max_file_mb: int = 25
    timeout_ms: int = 180_000
    image_types: tuple[str, ...] = ("jpg", "jpeg", "png")
    sheet_types: tuple[str, ...] = ("xlsx", "xls")
    #: A blank weight is 0 in the compatible reading, a warning in the strict one.
    blank_weight_is_zero: bool = True


@dataclass(frozen=True)
class RasterConfig:
    """How print is told from paper. Fixed values of the label family: limits of scans, and of a table's proportions."""

    max_side: int = 4800
    max_pixels: int = 16_000_000
    portrait_ratio: float = 1.1
    #: Paper is this quantile of a row or column; ink is darker by this share of it, and by so many levels.
    paper_quantile: float = 0.8
    ink_share: float = 0.04
    ink_levels: float = 6.0
    #: A line of print has some ink this much darker than paper; ink over most of its width is a rule.
    print_share: float = 0.11
    print_levels: float = 14.0
    rule_share: float = 0.72
    #: Insets of a cell's usable width, and how far below a header its value may stand.
    inset_left: float = 0.035
    inset_right: float = 0.15
    reach_below: float = 0.09
    reach_least: int = 26
    #: A weight column's width, as a share of the page's and at least so many pixels.
    column_low: float = 0.032
    column_high: float = 0.19
    column_low_px: int = 24
    column_high_px: int = 180
    #: Two weight columns are alike; the goods column after them is narrower, the one before wider.
    alike_low: float = 0.65
    alike_high: float = 1.35
    narrower: float = 0.85
    wider: float = 1.35
    #: Where a single weight column begins, and its neighbour's width beside its own.
    single_from: float = 0.16
    single_to: float = 0.32
    beside_low: float = 0.55
    beside_high: float = 1.25
    #: A rule with this share of the strongest one's ink is part of the table.
    strong: float = 0.45


@dataclass(frozen=True)
class PageConfig:
    """Distances of the label family's table that the page rules go by, as shares of the page. Fixed values."""

    #: A column's step from ACTUAL to CHARGED, by headers, by values, by the goods column.
    step_low: float = 0.06
    step_high: float = 0.17
    step_drift: float = 0.025
    pair_low: float = 0.07
    pair_high: float = 0.16
    goods_step_low: float = 0.055
    goods_step_high: float = 0.18
    #: Where the ACTUAL value of a pair without headers stands.
    pair_from: float = 0.15
    pair_to: float = 0.42
    #: The table's part of the page.
    table_right: float = 0.62
    header_right: float = 0.68
    #: How far a value may stand from its header's left edge, and how wide it may be.
    off_header: float = 0.035
    before_header: float = 0.01
    value_width: float = 0.09
    safe_width: float = 0.055
    cell_width: float = 0.06
    least_cell: float = 0.045
    #: Level values, and the height of a line of print.
    level: float = 0.025
    level_px: float = 12.0
    line: float = 0.022
    line_px: float = 12.0


PAGE = PageConfig()
MATCH, INTAKE, RASTER = MatchConfig(), IntakeConfig(), RasterConfig()
