"""From words to proposed corrections: the ordered rules that settle a page's value cells, and its status.

The result is a table of proposals with their evidence. Pages are never changed.

Order is meaning: every rule sees what the one before left. A rule is a function of the page's state; RULES
lists them, so each can be tested alone. Pixel rules run where a page's grey raster is given.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field, replace

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.config import MATCH, PAGE, MatchConfig
from tidemark.functions import numbers, text
from tidemark.functions import words as W
from tidemark.operators import identify, layout, raster
from tidemark.operators.boxes import Anchor, Box, Region, Word
from tidemark.operators.pages import by_page
from tidemark.session import keep, ship_package

_WEIGHTY = re.compile("weight|weigh|ctual|charg|structural|inferred")


@dataclass
class Page:
    """What is known of a page while its rules run."""

    width: float
    height: float
    words: list[Word]
    anchors: list[Anchor]
    regions: list[Region]
    grey: np.ndarray | None = None
    expected: int = 1
    trail: list[str] = field(default_factory=list)

    def in_table(self, box: Box, low: float = 0.2, high: float = 0.72) -> bool:
        return box.mid_x < 0.62 * self.width and low * self.height < box.mid_y < high * self.height

    def has_header(self, token: Callable[[str], bool]) -> bool:
        """Whether a header word stands among the anchors, or where the table is."""
        return any(token(w.text) for a in self.anchors for w in a.words) or any(token(w.text) and self.in_table(w.box) for w in self.words)

    @property
    def row_slack(self) -> float:
        return max(8.0, 0.018 * self.height)

    def header_bottom(self, box: Box) -> float:
        """Lower edge of the nearest header above a box; 0 without one."""
        return max((a.box.y1 for a in self.anchors if a.box.y1 < box.y0), default=0.0)

    def level(self, y: float, other: float) -> bool:
        return abs(y - other) <= max(PAGE.level_px, PAGE.level * self.height)

    def qualifier(self, kind: str | None) -> Word | None:
        """The surest word that names a column."""
        token = W.is_charged_token if kind == "charged" else W.is_actual_token
        return max((w for w in self.words if token(w.text) and w.box.x0 < PAGE.header_right * self.width), key=lambda w: w.confidence, default=None)

    def goods_to_the_right(self, region: Region) -> bool:
        """Whether SAID TO CONTAIN stands right after a value."""
        near = [w for w in self.words if W.qualifier_text(w.text) in ("said", "contain", "to") and 0 < w.box.x0 - region.box.x0 <= 0.22 * self.width and abs(w.box.mid_y - region.box.mid_y) <= 0.13 * self.height]
        return any(W.qualifier_text(w.text) != "to" for w in sorted(near, key=lambda w: w.box.x0)[:4])

    def goods_left(self) -> float | None:
        """Left edge of the goods column."""
        seen = [w.box.x0 for w in self.words if re.search("said|contain", W.qualifier_text(w.text)) and 0.28 * self.width < w.box.mid_x < 0.72 * self.width and 0.22 * self.height < w.box.mid_y < 0.72 * self.height]
        return min(seen, default=None)


def distinct_cells(p: Page) -> None:
    """One region for each place: of readings that overlap, the leftmost."""
    line = sorted(p.regions, key=lambda r: r.box.x0)
    p.regions = [r for k, r in enumerate(line) if not any(max(0, r.box.overlap_x(q.box)) >= 0.55 * max(1, min(r.box.width, q.box.width)) or abs(r.box.mid_x - q.box.mid_x) < 0.6 * max(1, min(r.box.width, q.box.width)) for q in line[:k])]


def count_columns(p: Page) -> None:
    """Two values are expected only where both headers are there by name."""
    p.expected = 2 if p.has_header(W.is_actual_token) and p.has_header(W.is_charged_token) else 1


def ruled_partner(p: Page) -> None:
    """A lone CHARGED value with an equal ruled cell to its left has an ACTUAL partner."""
    if p.grey is not None and len(p.regions) == 1 and "charg" in p.regions[0].anchor_text.lower() and p.has_header(W.is_charged_token):
        partner = raster.sibling_cell(p.grey, p.regions[0]._replace(kind="charged"))
        if partner:
            p.regions, p.expected = [partner, *p.regions], 2


def best_pair(p: Page) -> None:
    """Of several regions the two farthest apart on one row, else the largest one."""
    if len(p.regions) < 2:
        return
    apart, drift = 0.045 * p.width, max(7.0, 0.018 * p.height)
    pairs = [(a, b) for k, a in enumerate(p.regions) for b in p.regions[k + 1 :] if abs(a.box.mid_x - b.box.mid_x) >= apart and abs(a.box.mid_y - b.box.mid_y) <= drift]
    p.regions = list(max(pairs, key=lambda ab: abs(ab[0].box.mid_x - ab[1].box.mid_x))) if pairs else [max(p.regions, key=lambda r: r.box.area)]


def off_headers(p: Page) -> None:
    """Regions that lie on a header, or have nothing to do with weights, go."""
    p.regions = [r for r in p.regions if not any(r.box.covered_by(a.box) >= 0.75 for a in p.anchors) and _WEIGHTY.search(r.anchor_text.lower())]


def structural_cells(p: Page) -> None:
    """Cells proven by the print under the headers replace what reading alone made of them."""
    if p.grey is None:
        return
    found = raster.cells_under_headers(p.grey, p.anchors, p.words)
    level = len(p.regions) == 2 and all(W.is_printed_number(r.text) for r in p.regions) and abs(p.regions[0].box.mid_y - p.regions[1].box.mid_y) <= p.row_slack and abs(p.regions[0].box.mid_x - p.regions[1].box.mid_x) >= 0.045 * p.width
    tall = any(r.box.height > max(16, 0.03 * p.height) for r in p.regions)
    if len(found) != p.expected or (p.expected == 2 and level) or not (p.expected == 2 or len(p.regions) < p.expected or tall):
        return
    p.regions = assign_values(found, [*p.regions, *(Region(w.box, w.text.strip().replace(",", "."), "", None) for w in p.words if W.is_printed_number(w.text))], p)


def assign_values(cells: list[Region], values: list[Region], p: Page) -> list[Region]:
    """Give each cell the value printed in it: numbers with decimals first, then the nearest; each side once."""
    options = []
    for c, cell in enumerate(cells):
        middle = cell.cell[0] + 0.22 * (cell.cell[1] - cell.cell[0]) if cell.cell else cell.box.mid_x
        for v, value in enumerate(values):
            inside = not cell.cell or cell.cell[0] <= value.box.mid_x <= cell.cell[1]
            if inside and abs(value.box.mid_y - cell.box.mid_y) <= max(14, 0.03 * p.height) and value.box.height <= max(16, 0.03 * p.height):
                options.append(("." not in value.text, abs(value.box.mid_x - middle) + abs(value.box.mid_y - cell.box.mid_y), c, v))
    taken: dict[int, int] = {}
    for _, _, c, v in sorted(options):
        if c not in taken and v not in taken.values():
            taken[c] = v
    return [cell._replace(box=values[taken[c]].box, text=values[taken[c]].text) if c in taken else cell for c, cell in enumerate(cells)]


def table_cells(p: Page) -> None:
    """Cells by the table's rules where there are too few."""
    if p.grey is not None and len(p.regions) < p.expected:
        found = raster.cells_of_table(p.grey, p.anchors)
        if len(found) == p.expected:
            p.regions = found


def table_pair(p: Page) -> None:
    """A lone value beside a CHARGED header: the table's two cells, if they stand on the value's row."""
    if p.grey is None or len(p.regions) != 1 or not p.has_header(W.is_charged_token):
        return
    own, found = p.regions[0], raster.cells_of_table(p.grey, p.anchors)
    if len(found) == 2 and p.level(own.box.mid_y, sum(r.box.mid_y for r in found) / 2):
        p.regions, p.expected = [r._replace(text=own.text) for r in found], 2


def equal_sibling(p: Page) -> None:
    """The same number again, one column to the right of a lone value, is the CHARGED one."""
    if len(p.regions) != 1 or not p.has_header(W.is_charged_token) or len(p.regions[0].digits) < 3:
        return
    own = p.regions[0]
    twins = [w for w in p.words if W.is_printed_number(w.text) and 0.07 * p.width <= w.box.mid_x - own.box.mid_x <= 0.16 * p.width and abs(w.box.mid_y - own.box.mid_y) <= p.row_slack and re.sub(r"\D", "", w.text) == own.digits]
    if twins:
        twin = min(twins, key=lambda w: w.box.x0)
        p.regions, p.expected = [own._replace(kind="actual"), Region(twin.box, twin.text.strip().replace(",", "."), "aligned OCR CHARGED WEIGHT sibling", "charged")], 2


def single_cell(p: Page) -> None:
    if p.grey is not None and not p.regions and p.expected == 1:
        p.regions = raster.cell_under_one_header(p.grey, p.anchors, p.words)


def line_height(p: Page) -> None:
    """A value is one line of print; taller boxes are merged readings, unless they stand clear of the header."""
    def fine(r: Region) -> bool:
        clear = r.box.y0 - p.header_bottom(r.box) >= max(5, 0.006 * p.height)
        return r.box.height <= max(16, 0.03 * p.height) or (clear and r.box.height <= 0.05 * p.height)

    p.regions = [r for r in p.regions if fine(r)]


def enough_digits(p: Page) -> None:
    """A lone digit is no evidence, unless it stands in a proven wide cell."""
    def fine(r: Region) -> bool:
        n = len(r.digits)
        return n >= 2 or (r.cell is not None and (n == 0 or r.box.width >= max(18, 2.2 * r.box.height)))

    p.regions = [r for r in p.regions if fine(r)]


def missing_partner(p: Page) -> None:
    """The expected second value: by an equal ruled cell, else by the distance of the headers."""
    if len(p.regions) != 1 or p.expected != 2:
        return
    own = p.regions[0]
    options = [raster.sibling_cell(p.grey, own) if p.grey is not None else None, by_header_distance(p, own)]
    partner = next((r for r in options if r and is_headed(p, own, r)), None)
    if partner:
        p.regions = sorted([own, partner], key=lambda r: r.box.x0)


def is_headed(p: Page, own: Region, partner: Region) -> bool:
    """Whether something heads a partner's column, and not the goods: a weight header, or any word of three letters."""
    if not p.words:
        return True
    apart = abs(partner.box.mid_x - own.box.mid_x)
    if apart < 0.035 * p.width:
        return False
    head = min(p.anchors, key=lambda a: abs(a.box.mid_x - own.box.mid_x), default=None)
    top = (head.box.y0 if head else own.box.y0 - 0.08 * p.height) - 0.025 * p.height
    bottom = own.box.y0 + max(3, 0.008 * p.height)
    over = lambda b: abs(b.mid_x - partner.box.mid_x) <= 0.48 * apart and top <= b.mid_y <= bottom
    above = [W.qualifier_text(w.text) for w in p.words if over(w.box)]
    if any(re.search("said|contain|product|description|item", t) for t in above):
        return False
    return any(over(a.box) for a in p.anchors) or any(len(t) >= 3 for t in above)


def by_header_distance(p: Page, own: Region) -> Region | None:
    """Shift a value as its header is apart from the other one on the same line."""
    above = [a for a in p.anchors if a.box.y1 <= own.box.y0 + 2 and a.box.overlap_x(own.box) > 0]
    if not above:
        return None
    head = max(above, key=lambda a: a.box.y1)
    others = [a for a in p.anchors if a is not head and abs(a.box.mid_y - head.box.mid_y) <= max(a.box.height, head.box.height) and abs(a.box.mid_x - head.box.mid_x) >= 0.075 * p.width]
    if not others:
        return None
    target = min(others, key=lambda a: abs(a.box.mid_x - head.box.mid_x))
    shift = raster.header_left(target) - raster.header_left(head)
    if not max(1.05 * own.box.width, 0.025 * p.width) <= abs(shift) <= 0.3 * p.width:
        return None
    kind = W.column_kind(target.text) or ("charged" if shift > 0 else "actual")
    cell = (own.cell[0] + shift, own.cell[1] + shift) if own.cell else (own.box.x0 + shift - 2, own.box.x0 + shift + abs(shift) * 0.9)
    return Region(own.box.shift(shift), "", f"inferred {kind.upper()} WEIGHT by header distance", kind, cell)


def one_column_before_goods(p: Page) -> None:
    """An ACTUAL value with the goods column right after it has no CHARGED partner."""
    if p.expected == 2 and len(p.regions) == 1 and p.regions[0].kind == "actual" and not p.has_header(W.is_charged_token) and p.goods_to_the_right(p.regions[0]):
        p.expected = 1


def halfway_to_goods(p: Page) -> None:
    """A named CHARGED column that wasn't read stands halfway between ACTUAL and the goods."""
    if p.expected != 2 or len(p.regions) != 1 or p.regions[0].kind != "actual" or not p.has_header(W.is_charged_token):
        return
    own = p.regions[0]
    goods = [w for w in p.words if "contain" in W.qualifier_text(w.text) and w.box.mid_x > own.box.x1]
    if goods:
        shift = (min(goods, key=lambda w: w.box.x0).box.mid_x - own.box.mid_x) / 2
        if 0.06 * p.width <= shift <= 0.15 * p.width:
            cell = own.cell or (max(0.0, own.box.x0 - 0.08 * shift), own.box.x0 + shift)
            p.regions = [own._replace(cell=cell), Region(own.box.shift(shift), "", "inferred CHARGED WEIGHT before goods", "charged", (cell[0] + shift, cell[1] + shift))]


def whole_number(p: Page) -> None:
    """A reading of the same digits that spans more of the cell takes the place of a clipped one."""
    def wider(r: Region) -> Region:
        same = [w for w in p.words if W.is_printed_number(w.text) and re.sub(r"\D", "", w.text) == r.digits and w.box.overlap_x(r.box) > 0 and abs(w.box.mid_y - r.box.mid_y) <= p.row_slack and w.box.width > r.box.width and w.box.height <= max(16, 0.03 * p.height)]
        return r._replace(box=max(same, key=lambda w: w.box.width).box) if same and r.digits else r

    p.regions = [wider(r) for r in p.regions]


def one_line_high(p: Page) -> None:
    """A number's box is no higher than a line of print, about its middle."""
    def cut_to(r: Region) -> Region:
        safe = max(PAGE.line_px, PAGE.line * p.height)
        if len(r.digits) < 2 or r.box.height <= safe:
            return r
        return r._replace(box=r.box._replace(y0=max(0, r.box.mid_y - safe / 2), y1=min(p.height, r.box.mid_y + safe / 2)))

    p.regions = [cut_to(r) for r in p.regions]


def spaced_like_headers(p: Page) -> None:
    """Of two values the right one is CHARGED, and as far from the left one as the two header words are apart."""
    if len(p.regions) != 2:
        return
    heads = sorted((w for w in p.words if W.is_actual_token(w.text) and w.box.mid_x < PAGE.table_right * p.width), key=lambda w: (w.box.y0, w.box.x0))
    others = [w for w in p.words if "charg" in W.qualifier_text(w.text) and heads and w.box.x0 - heads[0].box.x0 >= PAGE.pair_low * p.width]
    if not others:
        return
    # a column is about a tenth of the page
    step = min((w.box.x0 - heads[0].box.x0 for w in others), key=lambda d: abs(d - 0.105 * p.width))
    left, right = sorted(p.regions, key=lambda r: r.box.x0)
    if PAGE.step_low * p.width <= step <= PAGE.step_high * p.width and abs(right.box.x0 - left.box.x0 - step) > PAGE.step_drift * p.width:
        right = right._replace(box=left.box.shift(step), cell=None)
    p.regions = [left._replace(kind="actual"), right._replace(kind="charged")]


def inherit_cells(p: Page) -> None:
    """Values take the bounds of the printed cell they stand in; a single one ends where the goods begin."""
    proven = [r.cell for r in (raster.cells_under_headers(p.grey, p.anchors, p.words) if p.grey is not None else []) if r.cell]
    p.regions = [r if r.cell else r._replace(cell=next((c for c in proven if c[0] < r.box.mid_x < c[1]), None)) for r in p.regions]
    if p.expected == 1 and len(p.regions) == 1:
        own = p.regions[0]
        after = [w.box.x0 for w in p.words if "contain" in W.qualifier_text(w.text) and w.box.x0 > own.box.x1]
        if after:
            left, right = own.cell[0] if own.cell else max(0, own.box.x0 - 0.25 * own.box.width), min(after) - max(2, 0.003 * p.width)
            if right - left >= PAGE.pair_low * p.width and right <= PAGE.table_right * p.width:
                p.regions = [own._replace(cell=(left, right))]


def actual_before_charged(p: Page) -> None:
    """CHARGED never stands alone: ACTUAL is one column to the left, as wide as the one from CHARGED to the goods."""
    if len(p.regions) != 1 or p.regions[0].kind != "charged":
        return
    own = p.regions[0]
    goods = [w.box.x0 for w in p.words if W.qualifier_text(w.text) in ("said", "contain") and w.box.x0 > own.box.x0]
    step = min(goods, default=own.box.x0) - own.box.x0
    if PAGE.goods_step_low * p.width <= step <= PAGE.goods_step_high * p.width:
        p.regions, p.expected = [Region(own.box.shift(-step), "", "inferred ACTUAL WEIGHT from CHARGED cell width", "actual"), own], 2


def aligned_decimals(p: Page) -> None:
    """Two equal decimals a column apart on the value's row are the pair, without any header.

    A rule read as a leading 1 is forgiven where the word that has it was read badly.
    """
    if len(p.regions) != 1 or any("aligned" in r.anchor_text for r in p.regions):
        return
    own = p.regions[0]
    read = [(w, m[0].replace(",", ".")) for w in p.words if (m := re.search(r"[0-9]{1,6}[.,][0-9]{1,3}", w.text))]
    near = [x for x in read if abs(x[0].box.mid_x - own.box.mid_x) <= 0.05 * p.width and p.level(x[0].box.mid_y, own.box.mid_y)]
    if not near:
        return
    source = min(near, key=lambda x: abs(x[0].box.mid_x - own.box.mid_x))
    number = lambda x: re.sub(r"\D", "", x[1])
    smudged = lambda x, y: number(x) == "1" + number(y) and x[0].confidence < MATCH.min_confidence

    def is_twin(x: tuple[Word, str]) -> bool:
        same = number(x) == number(source) or smudged(x, source) or smudged(source, x)
        apart = abs(x[0].box.mid_x - source[0].box.mid_x)
        return x is not source and same and PAGE.pair_low * p.width <= apart <= PAGE.pair_high * p.width and p.level(x[0].box.mid_y, source[0].box.mid_y)

    twin = next((x for x in read if is_twin(x)), None)
    if twin is None or len(number(source)) < 3 or not PAGE.pair_from * p.width <= source[0].box.mid_x <= PAGE.pair_to * p.width:
        return
    left, right = sorted((source, twin), key=lambda x: x[0].box.x0)
    step = right[0].box.mid_x - left[0].box.mid_x
    edge = max(0, left[0].box.x0 - max(3, 0.4 * max(6, min(left[0].box.height, right[0].box.height))))
    p.regions = [Region(x[0].box, x[1], f"aligned {k.upper()} WEIGHT value", k, (edge + n * step, edge + (n + 1) * step)) for n, (x, k) in enumerate(((left, "actual"), (right, "charged")))]
    p.expected = 2


def before_goods(p: Page) -> None:
    """Nothing right of the goods column's edge is a weight."""
    edge = p.goods_left()
    if edge is not None:
        p.regions = [r for r in p.regions if r.box.x0 < edge - 2]


def evidence(r: Region) -> float:
    """How well a region is attested: a plain number, decimals, digits, a proven cell, a header by name."""
    return 40 * W.is_printed_number(r.text) + 10 * ("." in r.text) + 4 * min(5, len(r.digits)) + 12 * (r.cell is not None) + 8 * (W.column_kind(r.anchor_text) is not None) - 10 * ("inferred" in r.anchor_text)


def one_of_each_kind(p: Page) -> None:
    """At most one ACTUAL and one CHARGED region, the best attested of each, from left to right."""
    best: dict[str | None, Region] = {}
    for r in sorted(p.regions, key=lambda r: r.box.x0):
        if r.kind not in best or evidence(r) > evidence(best[r.kind]):
            best[r.kind] = r
    p.regions = sorted(best.values(), key=lambda r: r.box.x0)[: max(1, p.expected)]


def not_in_one_cell(p: Page) -> None:
    """Two values that share a cell are one: the better attested stays."""
    if len(p.regions) == 2 and abs(p.regions[0].box.mid_x - p.regions[1].box.mid_x) < 0.03 * p.width:
        p.regions = [max(p.regions, key=evidence)]


def under_own_header(p: Page) -> None:
    """A box that begins before its header, or far from it, goes back under it; what was read before it is not its text."""
    def snapped(r: Region) -> Region:
        head = p.qualifier(r.kind)
        if head is None:
            return r
        due = head.box.x0 + 0.02 * head.box.width
        before = r.box.x0 < head.box.x0 - max(3, PAGE.before_header * p.width)
        if not before and abs(r.box.x0 - due) <= PAGE.off_header * p.width and r.box.width <= PAGE.value_width * p.width:
            return r
        box = r.box._replace(x0=due, x1=due + min(max(8, r.box.width), PAGE.safe_width * p.width))
        return r._replace(box=box, text="" if before else r.text, anchor_text=f"{r.anchor_text} corrected under header" if before else r.anchor_text)

    p.regions = [snapped(r) for r in p.regions]


def own_cell(p: Page) -> None:
    """Values stay within their column: from the left of its header to the next header, or to the goods."""
    goods = p.goods_left()

    def held(r: Region) -> Region:
        head, after = p.qualifier(r.kind), p.qualifier("charged") if r.kind == "actual" else None
        cell = r.cell
        if head is not None:
            inset = max(max(2, min(6, 0.08 * head.box.width)), 0.28 * head.box.width)
            left = cell[0] if cell and cell[0] < head.box.mid_x < cell[1] else max(0, head.box.x0 - inset)
            ends = [x for x in (after.box.x0 - 3 if after else None, goods - max(2, 0.003 * p.width) if goods else None, cell[1] if cell else None) if x and x > left]
            if ends and ends[0] - left >= PAGE.least_cell * p.width:
                cell = (left, ends[0])
        if cell is None:
            return r
        guard = max(3, min(6, 0.22 * max(8, r.box.height)))
        low, high = cell[0] + guard, cell[1] - guard
        if high <= low + 4:
            return r._replace(cell=cell)
        wide = min(max(10, r.box.width), max(10, high - low), PAGE.cell_width * p.width)
        x0 = max(low, min(r.box.x0, high - wide))
        return r._replace(box=r.box._replace(x0=x0, x1=min(high, x0 + wide)), cell=cell)

    p.regions = [held(r) for r in p.regions]


def sibling_geometry(p: Page) -> None:
    """Beside a value that was read, one that wasn't takes its row and width, a header step away."""
    heads = p.qualifier("actual"), p.qualifier("charged")
    if len(p.regions) != 2 or None in heads:
        return
    step = heads[1].box.x0 - heads[0].box.x0
    by = {r.kind: r for r in p.regions}
    sure = lambda r: bool(re.fullmatch(r"[0-9]{2,6}([.,][0-9]{1,3})?", r.text.strip()))
    if set(by) != {"actual", "charged"} or not PAGE.goods_step_low * p.width <= abs(step) <= PAGE.goods_step_high * p.width or sure(by["actual"]) == sure(by["charged"]):
        return
    known, other, shift = (by["actual"], by["charged"], step) if sure(by["actual"]) else (by["charged"], by["actual"], -step)
    x0 = known.box.x0 + shift
    if other.cell:
        x0 = max(other.cell[0] + 1, min(x0, other.cell[1] - known.box.width - 2))
    moved = other._replace(box=known.box._replace(x0=x0, x1=x0 + known.box.width))
    p.regions = [moved if r is other else r for r in p.regions]


def value_before_goods(p: Page) -> None:
    """The single value of a form without CHARGED is the decimal that stands last before the goods on its row."""
    edge = p.goods_left()
    if len(p.regions) != 1 or edge is None or p.has_header(W.is_charged_token):
        return
    own = p.regions[0]
    fits = lambda b: edge - 0.2 * p.width <= b.x0 and b.x1 < edge - 2 and 0.28 * p.height < b.mid_y < 0.68 * p.height and abs(b.mid_y - own.box.mid_y) <= 0.085 * p.height and 3 <= b.height <= max(32, 0.05 * p.height)
    seen = [(abs(w.box.mid_y - own.box.mid_y), -w.box.x0, w, m[0].replace(",", ".")) for w in p.words if (m := re.search(r"[0-9]{1,6}[.,][0-9]{1,3}", w.text)) and fits(w.box)]
    if seen:
        *_, w, shown = min(seen, key=lambda x: x[:2])
        inside = own.cell and own.cell[0] < w.box.x0 and w.box.x1 < own.cell[1]
        left = own.cell[0] if inside else max(0, w.box.x0 - max(3, min(7, 0.45 * w.box.height)))
        p.regions = [own._replace(box=w.box, text=shown, cell=(left, edge - max(2, 0.003 * p.width)))]


def last_resort(p: Page) -> None:
    """By the form's known proportions, if an ACTUAL header is there or the form has one column."""
    if p.grey is None or p.regions:
        return
    kind = raster.template_kind(p.grey)
    if kind and (kind == "single" or p.has_header(W.is_actual_token)):
        found = raster.cells_of_table(p.grey, p.anchors)
        if len(found) == p.expected:
            p.regions = found


def to_ink(p: Page) -> None:
    if p.grey is not None and p.regions and all(r.cell for r in p.regions):
        bottoms = [p.header_bottom(r.box) or max(0, r.box.y0 - max(8, 0.035 * p.height)) for r in p.regions]
        p.regions = raster.localise(p.grey, p.regions, bottoms)


RULES: list[Callable[[Page], None]] = [
    distinct_cells, count_columns, ruled_partner, best_pair, off_headers, structural_cells, table_cells, table_pair, equal_sibling, single_cell, line_height, enough_digits, single_cell, missing_partner,
    off_headers, line_height, one_column_before_goods, halfway_to_goods, enough_digits, one_line_high, whole_number, spaced_like_headers, inherit_cells, actual_before_charged, aligned_decimals, last_resort,
    aligned_decimals, before_goods, one_of_each_kind, not_in_one_cell, under_own_header, own_cell, sibling_geometry, value_before_goods, to_ink,
]


def settle(page: Page, rules: list[Callable[[Page], None]] = RULES) -> Page:
    """Run the rules in order; the trail names those that changed something."""
    page = replace(page, trail=list(page.trail))
    for rule in rules:
        before = page.regions, page.expected
        rule(page)
        if (page.regions, page.expected) != before:
            page.trail.append(rule.__name__)
    return page


def geometry_is_safe(p: Page) -> bool:
    """Values are lines of print, level with each other, below their headers."""
    tall = any(r.box.height > max(18, 0.045 * p.height) for r in p.regions)
    uneven = len(p.regions) == 2 and abs(p.regions[0].box.mid_y - p.regions[1].box.mid_y) > max(10, 0.025 * p.height)
    return not tall and not uneven


UNMATCHED = "unmatched", "no known id on the page"


def status_of(p: Page, matched: bool) -> tuple[str, str | None]:
    """Status and reason, in order of precedence."""
    if not matched:
        return UNMATCHED
    if p.regions and not geometry_is_safe(p):
        return "unsafe_weight_geometry", "value boxes are not single level lines"
    if len(p.regions) < p.expected and p.expected == 2:
        return "partial_weight_detection", f"{len(p.regions)} of 2 values found"
    if not p.regions:
        return "id_matched_no_weight_region", "id known, no value found"
    return "ok", None


SETTLED = "status string, reason string, expected int, trail array<string>, regions array<struct<bbox:struct<x0:double,y0:double,x1:double,y1:double>,original_text:string,kind:string,anchor_text:string,cell_x0:double,cell_x1:double>>"


def settled(rows: list[dict], size: dict, raster_row: dict | None, config: MatchConfig = MATCH) -> tuple:
    """Status, reason, number expected, trail and value cells of a page whose id is known; one that fails has status error."""
    try:
        own = layout.page_words(rows)
        width, height = float(size["width"]), float(size["height"])
        raw = raster_row["grey"] if raster_row else None
        grey = np.frombuffer(raw, np.uint8).reshape(-1, raster_row["raster_width"]) if raw is not None else None
        heads = layout.find_anchors(own)
        page = settle(Page(width, height, own, heads, layout.find_values(own, heads, height, config), grey))
        status, reason = status_of(page, True)
        found = [{"bbox": {k: float(v) for k, v in r.box._asdict().items()}, "original_text": r.text, "kind": r.kind, "anchor_text": r.anchor_text, "cell_x0": float(r.cell[0]) if r.cell else None, "cell_x1": float(r.cell[1]) if r.cell else None} for r in page.regions]
        return status, reason, page.expected, page.trail, found
    except Exception as e:  # noqa: BLE001  one bad page never fails the batch
        return "error", f"{type(e).__name__}: {e}", None, [], []


def read_pages(words: DataFrame, images: DataFrame, lengths: tuple[int, int], rasters: DataFrame | None = None, config: MatchConfig = MATCH) -> DataFrame:
    """Of every image the readings that may be its id, the number in its header, value cells and status, as if it were matched.

    One task sees a page once. rasters: (image_id, grey binary, raster_width int), row by row, where pixels are at hand.
    """
    def rule(rows: list[dict]) -> list[tuple]:
        sizes, raster_row, own = layout.parts_of(rows)
        if not sizes:
            return []
        width, height = sizes[0]["width"], sizes[0]["height"]
        chained = identify.chains(identify.fragments_of(own), config.max_chain_length)
        ids = identify.readings(own, chained, width, height, lengths, config), *identify.header_id(own, chained, width, height)
        done = settled(own, sizes[0], raster_row, config) if own else (None, None, None, None, None)
        return [(r["image_id"], r["filename"], *ids, *done) for r in sizes]

    return by_page(layout.page_rows(words, images, rasters), rule, f"image_id string, filename string, readings {identify.READINGS}, own string, own_source string, {SETTLED}", order=layout.PARTS)


def status_with(match: Column) -> tuple[Column, Column]:
    """Status and reason of read pages beside their match; images without words have none of their own."""
    unknown = match.isNull() & ~F.coalesce(F.col("status") == "error", F.lit(False))
    status = F.when(unknown, UNMATCHED[0]).otherwise(F.coalesce("status", F.lit("id_matched_no_weight_region")))
    reason = F.when(unknown & F.col("status").isNotNull(), UNMATCHED[1]).otherwise(F.col("reason"))
    return status.alias("status"), reason.alias("reason")


def settle_pages(words: DataFrame, images: DataFrame, matches: DataFrame, rasters: DataFrame | None = None, config: MatchConfig = MATCH) -> DataFrame:
    """Value cells and status of every page with words, by matches (image_id) that are there already."""
    pages = read_pages(words, images, identify.NO_LENGTHS, rasters, config).filter("status is not null")
    out = pages.join(matches.select("image_id", F.lit(True).alias("_matched")), "image_id", "left")
    return out.select("image_id", *status_with(F.col("_matched")), "expected", "trail", "regions")


def results(words: DataFrame, images: DataFrame, mapping: DataFrame, rasters: DataFrame | None = None, config: MatchConfig = MATCH) -> DataFrame:
    """One row for each image: status, id and its source, new weight, regions. Images without words are unmatched."""
    lengths = identify.id_lengths(mapping)
    pages = keep(read_pages(words, images, lengths, rasters, config))
    weights = mapping.select(F.col("id").alias("_id"), F.col("weight").alias("new_weight"))
    matches = identify.matched(pages, images, mapping, lengths, config).select("image_id", "id", "distance", F.col("source").alias("_source"))
    # weights join before the pages' many columns do
    out = pages.join(matches.join(weights, F.col("id") == F.col("_id"), "left"), "image_id", "left")
    status, reason = status_with(F.col("id"))
    return out.select(
        "image_id", "filename", status, reason, F.coalesce("id", "own").alias("shipment_id"), F.coalesce("_source", "own_source", F.lit("unavailable")).alias("shipment_id_source"),
        F.col("id").alias("matched_id"), "distance", "new_weight", "expected", F.coalesce("regions", F.array()).alias("regions"), "trail",
    )


def proposed_corrections(done: DataFrame) -> DataFrame:
    """One row for each value of an ok page: what is printed, what the sheet says, in one precision for the page."""
    ship_package(done.sparkSession)
    ok = done.filter("status = 'ok' and new_weight is not null")
    places = F.greatest(F.array_max(F.transform("regions", lambda r: text.decimals(r["original_text"]))), numbers.own_decimals(F.col("new_weight")))
    rows = ok.withColumn("new_text", numbers.format_weight(F.col("new_weight"), places)).select("image_id", "shipment_id", "new_weight", "new_text", F.posexplode("regions").alias("region_ord", "r"))
    return rows.select("image_id", "shipment_id", "region_ord", "r.kind", "r.bbox", "r.original_text", "new_text", "new_weight", (F.col("r.original_text") != F.col("new_text")).alias("differs"), F.col("r.anchor_text").alias("evidence"))
