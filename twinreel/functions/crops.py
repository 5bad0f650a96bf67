"""Crops as structs of (w, h, left, right, top, bottom), as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FIELDS = ("w", "h", "left", "right", "top", "bottom")


def crop(w: Column, h: Column, left: Column, right: Column, top: Column, bottom: Column) -> Column:
    """A crop by its offsets from the edges; null where nothing would be left."""
    made = F.struct(*(c.cast("int").alias(f) for c, f in zip((w, h, left, right, top, bottom), FIELDS, strict=True)))
    return F.when((left + right < w) & (top + bottom < h), made)


def from_corner(w: Column, h: Column, x: Column, y: Column, width: Column, height: Column) -> Column:
    return crop(w, h, x, w - x - width, y, h - y - height)


def union(a: Column, b: Column) -> Column:
    """The smallest crop that leaves what either leaves."""
    return F.struct(a["w"].alias("w"), a["h"].alias("h"), *(F.least(a[f], b[f]).alias(f) for f in FIELDS[2:]))


def biggest(a: Column, b: Column) -> Column:
    """The one whose offsets span more, as |right - left| by |bottom - top|; the
    first of equals."""
    span = lambda c: F.abs(c["right"] - c["left"]) * F.abs(c["bottom"] - c["top"])
    return F.when(span(b) > span(a), b).otherwise(a)


def width(c: Column) -> Column:
    return c["w"] - c["left"] - c["right"]


def height(c: Column) -> Column:
    return c["h"] - c["top"] - c["bottom"]


def view(c: Column) -> Column:
    """(x, y, width, height) of what is left."""
    return F.struct(c["left"].alias("x"), c["top"].alias("y"), width(c).alias("width"), height(c).alias("height"))


def area(c: Column) -> Column:
    return width(c) * height(c)


def aspect_ratio(c: Column) -> Column:
    return width(c) / height(c)


def is_uncropped(c: Column) -> Column:
    return (c["left"] == 0) & (c["right"] == 0) & (c["top"] == 0) & (c["bottom"] == 0)


def erode(c: Column) -> Column:
    """One more from each side; null where nothing would be left."""
    return crop(c["w"], c["h"], c["left"] + 1, c["right"] + 1, c["top"] + 1, c["bottom"] + 1)


def coordinates(c: Column, inside: bool = True) -> Column:
    """All pixels that are left, or that go, as an array of (x, y)."""
    both = F.flatten(
        F.transform(
            F.sequence(F.lit(0), c["h"] - 1),
            lambda y: F.transform(F.sequence(F.lit(0), c["w"] - 1), lambda x: F.struct(x.alias("x"), y.alias("y"))),
        )
    )

    def held(p: Column) -> Column:
        return (p["x"] >= c["left"]) & (p["x"] < c["w"] - c["right"]) & (p["y"] >= c["top"]) & (p["y"] < c["h"] - c["bottom"])

    return F.filter(both, held if inside else lambda p: ~held(p))
