"""Boxes of lines on a page: ``struct<x1, y1, x2, y2>`` of whole pixels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_box(text: Column) -> Column:
    """A box from ``"x1,y1,x2,y2"``, with or without brackets; null unless it is just four numbers."""
    bare = F.regexp_replace(text, r"[()\[\] ]", "")
    n = F.split(bare, ",")
    whole = bare.rlike(r"^-?[0-9]+,-?[0-9]+,-?[0-9]+,-?[0-9]+$")
    return F.when(whole, F.struct(*[n[i].try_cast("int").alias(c) for i, c in enumerate(("x1", "y1", "x2", "y2"))]))


def y_center(box: Column) -> Column:
    return (box["y1"] + box["y2"]) / 2


def height(box: Column) -> Column:
    return F.greatest(F.lit(1), box["y2"] - box["y1"])


def area(box: Column) -> Column:
    return F.greatest(F.lit(1), (box["x2"] - box["x1"]) * (box["y2"] - box["y1"]))


def overlap(a: Column, b: Column) -> Column:
    w = F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"])
    h = F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"])
    return F.greatest(F.lit(0), w) * F.greatest(F.lit(0), h)


def iou(a: Column, b: Column) -> Column:
    common = overlap(a, b)
    return common / (area(a) + area(b) - common)


def union(a: Column, b: Column) -> Column:
    return F.struct(*[(F.least if c.endswith("1") else F.greatest)(a[c], b[c]).alias(c) for c in ("x1", "y1", "x2", "y2")])


def same_row_right(label: Column, value: Column) -> Column:
    """The value stands to the right of the label, in its row."""
    h = height(label)
    return (F.abs(y_center(value) - y_center(label)) <= 0.6 * h) & (value["x1"] >= label["x2"] - 0.25 * h)


def below(label: Column, value: Column) -> Column:
    """The value stands under the label."""
    dy = y_center(value) - y_center(label)
    return (dy > 0) & (dy <= 2.2 * height(label)) & (F.least(label["x2"], value["x2"]) > F.greatest(label["x1"], value["x1"]))


def in_value_column(anchor: Column, other: Column, rows: float = 2.2) -> Column:
    """Beside or over the anchor within a few row heights."""
    near = F.abs(y_center(other) - y_center(anchor)) <= rows * F.greatest(height(anchor), height(other))
    return near & ((other["x1"] >= anchor["x2"] - 2) | (F.least(anchor["x2"], other["x2"]) > F.greatest(anchor["x1"], other["x1"])))
