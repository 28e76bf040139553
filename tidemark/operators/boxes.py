"""Boxes of a page and the relations between them that the layout rules use. Origin top left."""

from __future__ import annotations

from collections.abc import Iterable
from typing import NamedTuple


class Box(NamedTuple):
    x0: float
    y0: float
    x1: float
    y1: float

    @property
    def width(self) -> float:
        return self.x1 - self.x0

    @property
    def height(self) -> float:
        return self.y1 - self.y0

    @property
    def mid_x(self) -> float:
        return (self.x0 + self.x1) / 2

    @property
    def mid_y(self) -> float:
        return (self.y0 + self.y1) / 2

    @property
    def area(self) -> float:
        return self.width * self.height

    def shift(self, dx: float) -> "Box":
        return self._replace(x0=self.x0 + dx, x1=self.x1 + dx)

    def overlap_x(self, other: "Box") -> float:
        """Shared width; negative is the gap between the two."""
        return min(self.x1, other.x1) - max(self.x0, other.x0)

    def overlap_y(self, other: "Box") -> float:
        return min(self.y1, other.y1) - max(self.y0, other.y0)

    def covered_by(self, other: "Box") -> float:
        """Share of the own area that the other box covers."""
        return max(0.0, self.overlap_x(other)) * max(0.0, self.overlap_y(other)) / self.area if self.area > 0 else 0.0


def hull(boxes: Iterable[Box]) -> Box:
    boxes = list(boxes)
    return Box(min(b.x0 for b in boxes), min(b.y0 for b in boxes), max(b.x1 for b in boxes), max(b.y1 for b in boxes))


class Word(NamedTuple):
    ord: int
    text: str
    confidence: float
    box: Box


class Anchor(NamedTuple):
    """A column header: its words, and the box in which they head a column."""

    box: Box
    words: tuple[Word, ...]

    @property
    def text(self) -> str:
        return " ".join(w.text for w in self.words)


class Region(NamedTuple):
    """A value cell: where the number stands or should stand, what was read there, and why it is taken for one."""

    box: Box
    text: str
    anchor_text: str
    kind: str | None
    cell: tuple[float, float] | None = None

    @property
    def digits(self) -> str:
        return "".join(c for c in self.text if c in "0123456789")
