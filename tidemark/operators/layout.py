"""Column headers and value cells of a page, from its words.

These rules go by order and claim as they go, so they can't be grouped relationally; a page has a few hundred
words, so a task sees one page at a time and memory is bounded by the largest page.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.config import MATCH, MatchConfig
from tidemark.functions import words as W
from tidemark.model import ANCHORS, REGIONS
from tidemark.operators.boxes import Anchor, Box, Region, Word, hull
from tidemark.operators.pages import by_page


#: The characters of a number's pieces.
NUMBER_MARKS = re.compile(r"[0-9.,:;|_-]+")


def header_halves(words: list[Word]) -> set[int]:
    """Places of neighbours on a line that together spell the header."""
    short = [(w, W.header_text(w.text)) for w in words]
    short = sorted(((w, t) for w, t in short if 1 <= len(t) <= 7), key=lambda p: p[0].box.x0)
    out: set[int] = set()
    for i, (a, left) in enumerate(short):
        for b, right in short[i + 1 :]:
            tall = max(a.box.height, b.box.height)
            same_line = abs(a.box.mid_y - b.box.mid_y) <= 0.7 * tall
            if same_line and -0.5 * tall <= b.box.x0 - a.box.x1 <= 1.2 * tall and 5 <= len(left + right) <= 7 and W.edits(left + right, "weight") <= 1:
                out |= {a.ord, b.ord}
    return out


def _belongs(group: Box, box: Box) -> bool:
    """Whether a word stands under or beside a group of header words."""
    tall = max(group.height, box.height)
    stacked = group.overlap_x(box) >= 0.25 * min(group.width, box.width) and -group.overlap_y(box) <= 1.5 * tall
    beside = abs(group.mid_y - box.mid_y) <= 0.8 * tall and max(0.0, -group.overlap_x(box)) <= 1.5 * tall
    return stacked or beside


def cluster(words: list[Word]) -> list[list[Word]]:
    """Greedy groups in reading order: a word joins the first group, as grown so far, that it belongs to."""
    groups: list[tuple[Box, list[Word]]] = []
    for word in sorted(words, key=lambda w: (w.box.y0, w.box.x0)):
        for k, (box, members) in enumerate(groups):
            if _belongs(box, word.box):
                groups[k] = hull([box, word.box]), [*members, word]
                break
        else:
            groups.append((word.box, [word]))
    return [members for _, members in groups]


def _is_header(w: Word) -> bool:
    return W.is_weight_header(w.text) or W.is_qualifier(w.text)


def split_at_gap(group: list[Word], others: list[list[Word]]) -> list[list[Word]]:
    """Two columns if the widest gap is pronounced and both sides head one; one wide ACTUAL cell stays whole."""
    line = sorted(group, key=lambda w: w.box.mid_x)
    gaps = [b.box.mid_x - a.box.mid_x for a, b in zip(line, line[1:])]
    heights = sorted(w.box.height for w in line if w.box.height > 0)
    usual = heights[len(heights) // 2] if heights else hull(w.box for w in group).height
    if not gaps or max(gaps) <= 0 or max(gaps) < max(18, 2.2 * usual):
        return [group]
    at = gaps.index(max(gaps)) + 1
    left, right = line[:at], line[at:]
    if not any(map(_is_header, left)) or not any(map(_is_header, right)):
        return [group]
    right_box = hull(w.box for w in right)
    charged_near = any(hull(w.box for w in o).overlap_x(right_box) > 0 and any("charg" in W.qualifier_text(w.text) for w in o) for o in others)
    texts = ["".join(W.qualifier_text(w.text) for w in side) for side in (left, right)]
    if "ctual" in texts[0] and "charg" not in texts[1] and not charged_near:
        return [group]
    return [left, right]


def anchor_of(words: list[Word]) -> Anchor:
    """The anchor of some words; where ACTUAL WEIGHT ran on into the goods column, only its left part heads values."""
    box = hull(w.box for w in words)
    text = " ".join(w.text for w in words)
    plain = W.qualifier_text(text)
    spills = "weigh" in W.header_text(text) and ("said" in plain or "contain" in plain)
    if spills and "ctual" in plain and "charg" not in plain and box.width > 0:
        box = box._replace(x1=box.x0 + max(0.32 * box.width, min(0.52 * box.width, 3.4 * box.height)))
    return Anchor(box, tuple(words))


def find_anchors(words: list[Word]) -> list[Anchor]:
    """Column headers from left to right."""
    halves = header_halves(words)
    groups = cluster([w for w in words if w.ord in halves or _is_header(w)])
    parts = [side for g in groups for side in (split_at_gap(g, [o for o in groups if o is not g]) if len(g) > 1 else [g])]
    merged: list[Anchor] = []
    for anchor in sorted(map(anchor_of, parts), key=lambda a: (a.box.x0, a.box.y0)):
        for k, other in enumerate(merged):
            tall, narrow = max(anchor.box.height, other.box.height), min(anchor.box.width, other.box.width)
            if anchor.box.overlap_x(other.box) >= 0.45 * narrow and max(0.0, -anchor.box.overlap_y(other.box)) <= 1.5 * tall:
                merged[k] = anchor_of([*other.words, *(w for w in anchor.words if w not in other.words)])
                break
        else:
            merged.append(anchor)
    return merged


def find_values(words: list[Word], anchors: list[Anchor], page_height: float, config: MatchConfig = MATCH) -> list[Region]:
    """The number under each header: nearest below within its column, each number claimed once, then one row of them."""
    numbers = [(w, W.is_number(w.text)) for w in words if W.is_number(w.text) or W.is_damaged_number(w.text)]
    claimed: set[int] = set()
    found: list[Region] = []
    for k, anchor in enumerate(anchors):
        box, reach = anchor.box, min(config.horizontal_tolerance, max(12.0, 0.35 * anchor.box.width))
        options = []
        for place, (w, plain) in enumerate(numbers):
            gap = w.box.y0 - box.y1
            below = gap >= 0 or w.box.mid_y > box.mid_y
            if w.ord not in claimed and below and box.x0 - reach <= w.box.mid_x <= box.x1 + reach and -max(3.0, 0.45 * box.height) <= gap <= page_height * config.vertical_window:
                options.append((gap, not plain, place, w))
        if options:
            w = min(options)[3]
            claimed.add(w.ord)
            kind = W.column_kind(anchor.text) or ("charged" if len(anchors) >= 2 and k else "actual")
            found.append(Region(w.box, w.text.strip(), anchor.text, kind))
    return largest_row(found, page_height)


def largest_row(regions: list[Region], page_height: float) -> list[Region]:
    """Of several rows of values the fullest, topmost on ties; a row is what its first value is level with."""
    if len(regions) <= 1:
        return regions
    rows: list[list[Region]] = []
    for r in sorted(regions, key=lambda r: r.box.y0):
        home = next((row for row in rows if abs(row[0].box.y0 - r.box.y0) <= max(20.0, 0.04 * page_height)), None)
        if home is None:
            rows.append([r])
        else:
            home.append(r)
    return min(rows, key=lambda row: (-len(row), row[0].box.y0))


def value_fragments(words: list[Word], value: Region) -> tuple[list[Word], list[Word]]:
    """What stands on a value's row and belongs to it: pieces of the number, and signs read before it.

    Pieces have digits and number marks only. Signs are up to four characters without digits, no words, right
    before the first piece. Both stay within the value's cell.
    """
    box = value.box
    cell = value.cell or (box.x0 - box.height, box.x1 + 5 * box.height)
    pad = max(8.0, 1.35 * box.height, 0.55 * box.width)
    texts = [(w, w.text.strip(), abs(w.box.mid_y - box.mid_y)) for w in words]
    low, high = max(cell[0], box.x0 - pad), min(cell[1], box.x1 + pad)
    pieces = [w for w, t, off in texts if NUMBER_MARKS.fullmatch(t) and any("0" <= c <= "9" for c in t) and low < w.box.mid_x < high and off <= max(5.0, 0.8 * box.height)]
    left = min([box.x0, *(w.box.x0 for w in pieces)])
    reach = max(1.8 * box.height, 0.9 * box.width, 20.0)
    is_sign = lambda t: 1 <= len(t) <= 4 and not re.search("[A-Za-z]{2}|[0-9]", t)
    signs = [w for w, t, off in texts if is_sign(t) and off <= max(5.0, 0.85 * box.height) and max(cell[0], left - reach) <= w.box.x0 and w.box.x1 <= left + max(8.0, 0.7 * box.height)]
    return pieces, signs


def fragments(words: DataFrame, images: DataFrame, config: MatchConfig = MATCH) -> DataFrame:
    """Of each value cell the words that make up its number, and the signs before it."""
    def rule(page: list[dict]) -> list[tuple]:
        own = page_words(page)
        found = find_values(own, find_anchors(own), float(page[0]["height"]), config)
        return [(page[0]["image_id"], k, *([w.text for w in part] for part in value_fragments(own, r))) for k, r in enumerate(found)]

    return by_page(flat_words(words, images), rule, "image_id string, region_ord int, pieces array<string>, signs array<string>")


def page_words(page: list[dict]) -> list[Word]:
    """Words of one page's rows."""
    return [Word(r["word_ord"], r["text"] or "", float(r["confidence"] or 0), Box(r["x0"], r["y0"], r["x1"], r["y1"])) for r in page]


def flat_words(words: DataFrame, images: DataFrame) -> DataFrame:
    """Words with their box's sides and their page's size, the columns that a page's task needs."""
    flat = words.select("image_id", "word_ord", "text", "confidence", "bbox.x0", "bbox.y0", "bbox.x1", "bbox.y1")
    return flat.join(images.select("image_id", "width", "height", "filename"), "image_id")


#: Order of a page's rows in page_rows().
PARTS = ["_part", "word_ord"]


def page_rows(words: DataFrame, images: DataFrame, rasters: DataFrame | None = None) -> DataFrame:
    """All that is known of pages as one stream, so that one shuffle brings it together: of each page its images (_part 0), its raster (1), its words (2)."""
    flat = words.filter("image_id is not null").select("image_id", F.lit(2).alias("_part"), "word_ord", "text", F.col("confidence").cast("double").alias("confidence"), "bbox.x0", "bbox.y0", "bbox.x1", "bbox.y1")
    sizes = images.select("image_id", F.lit(0).alias("_part"), "filename", F.col("width").cast("double").alias("width"), F.col("height").cast("double").alias("height"))
    rows = flat.unionByName(sizes, allowMissingColumns=True)
    return rows if rasters is None else rows.unionByName(rasters.select("image_id", F.lit(1).alias("_part"), "grey", "raster_width"), allowMissingColumns=True)


def parts_of(rows: list[dict]) -> tuple[list[dict], dict | None, list[dict]]:
    """A page's images, raster and words, from its rows of page_rows()."""
    return [r for r in rows if r["_part"] == 0], next((r for r in rows if r["_part"] == 1), None), [r for r in rows if r["_part"] == 2]


def anchors(words: DataFrame, images: DataFrame) -> DataFrame:
    def rule(page: list[dict]) -> list[tuple]:
        return [(page[0]["image_id"], k, {**a.box._asdict(), "height": a.box.height}, [w.text for w in a.words]) for k, a in enumerate(find_anchors(page_words(page)))]

    return by_page(flat_words(words, images), rule, ANCHORS)


def regions(words: DataFrame, images: DataFrame, config: MatchConfig = MATCH) -> DataFrame:
    def rule(page: list[dict]) -> list[tuple]:
        own = page_words(page)
        found = find_values(own, find_anchors(own), float(page[0]["height"]), config)
        return [(page[0]["image_id"], k, r.box._asdict(), r.text, r.anchor_text, r.kind, {"x0": r.cell[0], "x1": r.cell[1]} if r.cell else None) for k, r in enumerate(found)]

    return by_page(flat_words(words, images), rule, REGIONS)
