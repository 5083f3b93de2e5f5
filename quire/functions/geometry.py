"""Sizes and places of pages, stamps, thumbnails and ink, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Longest edge of a page, widest stamp, stamp's share of a page, padding of ink.
LONG_EDGE = 1600
STAMP_WIDTH = 220.0
STAMP_SHARE = 0.4
INK_PAD = 10.0


def _scale(w: Column, h: Column, edge: int) -> Column:
    return F.least(F.lit(1.0), F.lit(float(edge)) / F.greatest(w, h))


def resized(w: Column, h: Column, edge: int = LONG_EDGE) -> tuple[Column, Column]:
    """Width and height under a long edge; never enlarged, at least 1, halves to even."""
    scale = _scale(w, h, edge)
    side = lambda x: F.greatest(F.lit(1), F.bround(x * scale, 0).cast("int"))
    return side(w), side(h)


def turned(w: Column, h: Column, orientation: Column) -> tuple[Column, Column]:
    """Width and height after an EXIF orientation; 5 to 8 swap them, anything but 2 to 8 changes nothing."""
    swap = F.coalesce(orientation.between(5, 8), F.lit(False))
    return F.when(swap, h).otherwise(w), F.when(swap, w).otherwise(h)


def safe_aspect(w: Column, h: Column) -> Column:
    return F.when(h <= 0, F.lit(1.0)).otherwise(w / h)


def stamp_size(page_width: Column, aspect: Column, width: Column | None = None) -> tuple[Column, Column]:
    w = F.least(F.lit(STAMP_WIDTH), F.lit(STAMP_SHARE) * page_width)
    w = w if width is None else F.coalesce(width, w)
    return w, w / F.greatest(F.lit(0.01), aspect)


def centred(page_w: Column, page_h: Column, w: Column, h: Column) -> tuple[Column, Column]:
    return (page_w - w) / 2, (page_h - h) / 2


def stamp_resized(x: Column, y: Column, w: Column, h: Column, new_w: Column) -> tuple[Column, Column, Column, Column]:
    """A stamp of a new width, between 14 and 600, about the same centre."""
    width = F.least(F.greatest(new_w, F.lit(14.0)), F.lit(600.0))
    height = width / F.greatest(F.lit(0.01), safe_aspect(w, h))
    return x + (w - width) / 2, y + (h - height) / 2, width, height


def fitted(w: Column, h: Column, box_w: float, box_h: float) -> tuple[Column, Column, Column, Column]:
    """A picture scaled down into a box and centred: x, y, width, height."""
    at_least_one = lambda v: F.greatest(v, F.lit(1.0))
    s = F.least(F.lit(box_w) / at_least_one(w), F.lit(box_h) / at_least_one(h), F.lit(1.0))
    return (F.lit(box_w) - w * s) / 2, (F.lit(box_h) - h * s) / 2, w * s, h * s


def grid_cell(i: Column, columns: int = 3, cell_w: int = 170, cell_h: int = 80, gap: int = 12) -> tuple[Column, Column, Column, Column]:
    """Row, column, x and y of the i-th cell, from 0."""
    row, col = F.floor(i / columns).cast("long"), (i % columns).cast("long")
    return row, col, F.lit(gap) + col * (cell_w + gap), F.lit(gap) + row * (cell_h + gap)


def grid_y(i: Column, n: Column, columns: int = 3, cell_h: int = 80, gap: int = 12) -> Column:
    """Lower edge of the i-th of n cells, measured from the bottom of the whole grid, whose first row is at the top."""
    row = F.floor(i / columns).cast("long")
    return grid_height(n, columns, cell_h, gap) - (row + 1) * (cell_h + gap)


def grid_height(n: Column, columns: int = 3, cell_h: int = 80, gap: int = 12, least: int = 250) -> Column:
    return F.greatest(F.lit(least), F.ceil(n / columns) * (cell_h + gap) + gap)


def contains(px: Column, py: Column, x: Column, y: Column, w: Column, h: Column) -> Column:
    """Least edges belong to a rectangle, greatest do not."""
    return (px >= x) & (px < x + w) & (py >= y) & (py < y + h)


def padded_extent(least: Column, greatest: Column, pad: float = INK_PAD) -> Column:
    return F.greatest(F.lit(1.0), greatest - least + 2 * pad)


def ink_box(strokes: Column, pad: float = INK_PAD) -> Column:
    """Box (x, y, w, h) around strokes, an array of arrays of points; null without points."""
    points = F.flatten(strokes)
    xs, ys = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
    box = F.struct(
        (F.array_min(xs) - pad).alias("x"), (F.array_min(ys) - pad).alias("y"),
        padded_extent(F.array_min(xs), F.array_max(xs), pad).alias("w"), padded_extent(F.array_min(ys), F.array_max(ys), pad).alias("h"),
    )
    return F.when(F.size(points) > 0, box)


def moved(strokes: Column, dx: Column, dy: Column) -> Column:
    """Strokes less an offset."""
    return F.transform(strokes, lambda s: F.transform(s, lambda p: F.struct((p["x"] - dx).alias("x"), (p["y"] - dy).alias("y"))))


def drawable(strokes: Column) -> Column:
    """Strokes of more than one point."""
    return F.filter(strokes, lambda s: F.size(s) > 1)


def on_canvas(nx: Column, ny: Column, w: Column, h: Column) -> tuple[Column, Column]:
    """A touch, from 0 to 1 either way, on a canvas."""
    return nx * w, ny * h


def text_raster(width: Column, height: Column, pad: int) -> tuple[Column, Column]:
    """Raster size around measured text."""
    return F.ceil(width) + 2 * pad, F.ceil(height) + 2 * pad
