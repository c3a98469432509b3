"""Boxes as four columns x1, y1, x2, y2, held in a Box; everything is column arithmetic."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F


class Box(NamedTuple):
    x1: Column
    y1: Column
    x2: Column
    y2: Column

    @staticmethod
    def of(prefix: str = "") -> Box:
        return Box(*[F.col(f"{prefix}{c}") for c in ("x1", "y1", "x2", "y2")])

    @property
    def width(self) -> Column:
        return self.x2 - self.x1

    @property
    def height(self) -> Column:
        return self.y2 - self.y1

    @property
    def area(self) -> Column:
        return self.width * self.height

    @property
    def center_x(self) -> Column:
        return (self.x1 + self.x2) / 2

    @property
    def center_y(self) -> Column:
        return (self.y1 + self.y2) / 2

    @property
    def valid(self) -> Column:
        """A box has positive width and height; rows that fail belong in a rejects table."""
        return (self.x2 > self.x1) & (self.y2 > self.y1)

    def scaled(self, factor: float | Column) -> Box:
        return Box(*[c * factor for c in self])


def contains(outer: Box, inner: Box) -> Column:
    """Inclusive containment."""
    return (outer.x1 <= inner.x1) & (outer.y1 <= inner.y1) & (outer.x2 >= inner.x2) & (outer.y2 >= inner.y2)


def intersection(a: Box, b: Box) -> Column:
    """Area in common, 0 for boxes that touch or lie apart."""
    wide = F.least(a.x2, b.x2) - F.greatest(a.x1, b.x1)
    high = F.least(a.y2, b.y2) - F.greatest(a.y1, b.y1)
    return F.when((wide > 0) & (high > 0), wide * high).otherwise(F.lit(0.0))


def iou(a: Box, b: Box) -> Column:
    both = intersection(a, b)
    return F.coalesce(both / F.nullif(a.area + b.area - both, F.lit(0)), F.lit(0.0))


def overlap_of_smaller(a: Box, b: Box) -> Column:
    """Common area as a share of the smaller box."""
    return F.coalesce(intersection(a, b) / F.nullif(F.least(a.area, b.area), F.lit(0)), F.lit(0.0))


def center_inside(char: Box, cell: Box) -> Column:
    """Is the middle of a character inside a cell? Left and top edges belong to the cell, right and bottom do not."""
    return (char.center_x >= cell.x1) & (char.center_x < cell.x2) & (char.center_y >= cell.y1) & (char.center_y < cell.y2)


def associated(box: Box, span: Box) -> Column:
    """Does a text span belong to a detected box: by IoU, by share of the smaller one, or by containment?"""
    return (iou(box, span) >= 0.01) | (overlap_of_smaller(box, span) >= 0.1) | contains(box, span)
