"""Box geometry as Column expressions.  A box is a struct of doubles x0, y0, x1, y1 in points."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EDGE = 2.0


def box(x0: Column, y0: Column, x1: Column, y1: Column, digits: int | None = None) -> Column:
    """A box with ordered corners, rounded half-even to ``digits`` if given."""
    corners = [F.least(x0, x1), F.least(y0, y1), F.greatest(x0, x1), F.greatest(y0, y1)]
    if digits is not None:
        corners = [F.bround(c, digits) for c in corners]
    return F.struct(*(c.cast("double").alias(n) for c, n in zip(corners, ("x0", "y0", "x1", "y1"), strict=True)))


def width(b: Column) -> Column:
    return b.x1 - b.x0


def height(b: Column) -> Column:
    return b.y1 - b.y0


def cx(b: Column) -> Column:
    return (b.x0 + b.x1) / 2


def cy(b: Column) -> Column:
    return (b.y0 + b.y1) / 2


def area(b: Column) -> Column:
    return width(b) * height(b)


def _shared(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(a1, b1) - F.greatest(a0, b0))


def _overlap(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    short = F.least(a1 - a0, b1 - b0)
    return F.when(short > 0, _shared(a0, a1, b0, b1) / short).otherwise(F.lit(0.0))


def v_overlap(a: Column, b: Column) -> Column:
    """Shared height over the shorter height."""
    return _overlap(a.y0, a.y1, b.y0, b.y1)


def h_overlap(a: Column, b: Column) -> Column:
    """Shared width over the shorter width."""
    return _overlap(a.x0, a.x1, b.x0, b.x1)


def inside(a: Column, b: Column) -> Column:
    """Fraction of ``a``'s area that lies in ``b``; 0 for an empty ``a``."""
    return F.when(area(a) > 0, _shared(a.x0, a.x1, b.x0, b.x1) * _shared(a.y0, a.y1, b.y0, b.y1) / area(a)).otherwise(F.lit(0.0))


def in_band(b: Column, x0: Column, x1: Column, share: float = 0.5) -> Column:
    """Whether at least ``share`` of the box's width lies between two edges; boxes without width do."""
    return F.when(width(b) <= 0, F.lit(True)).otherwise(_shared(b.x0, b.x1, x0, x1) / width(b) >= share)


def near(a: Column, b: Column, reach: float) -> Column:
    """Whether the horizontal gap between two boxes is at most ``reach``."""
    return F.greatest(b.x0 - a.x1, a.x0 - b.x1) <= reach


def relative(b: Column, page_width: Column, page_height: Column) -> Column:
    """Centre and size as fractions of the page, to 4 digits."""
    w = F.when(page_width > 0, page_width).otherwise(F.lit(1.0))
    h = F.when(page_height > 0, page_height).otherwise(F.lit(1.0))
    return F.struct(F.bround(cx(b) / w, 4).alias("rel_x_pct"), F.bround(cy(b) / h, 4).alias("rel_y_pct"),
                    F.bround(width(b) / w, 4).alias("rel_w_pct"), F.bround(height(b) / h, 4).alias("rel_h_pct"))


def relative_label(markup: Column, field: Column) -> Column:
    """Where a markup sits relative to its field, in words."""
    beside = F.when(markup.x0 >= field.x1, "right_of_field").when(markup.x1 <= field.x0, "left_of_field").otherwise("overlapping_field")
    return F.when(v_overlap(markup, field) > 0, beside).when(cy(markup) > cy(field), "below_field").otherwise("above_field")


def clamp(b: Column, page_width: Column, page_height: Column) -> Column:
    """Struct of ``rect`` (the box pulled back onto the page, 2 digits) and ``notes``."""
    right, low = page_width - EDGE, page_height - EDGE
    left_by = F.greatest(F.lit(0.0), b.x1 - right)
    x0, x1 = b.x0 - left_by, b.x1 - left_by
    cut = x0 < EDGE
    up_by = F.greatest(F.lit(0.0), b.y1 - low)
    y0, y1 = b.y0 - up_by, b.y1 - up_by
    high = y0 < EDGE
    rect = F.struct(F.bround(F.when(cut, F.lit(EDGE)).otherwise(x0), 2).alias("x0"), F.bround(F.when(high, F.lit(EDGE)).otherwise(y0), 2).alias("y0"),
                    F.bround(F.when(cut, F.greatest(F.lit(EDGE + 1), F.least(x1 + (EDGE - x0), right))).otherwise(x1), 2).alias("x1"),
                    F.bround(F.when(high, y1 + EDGE - y0).otherwise(y1), 2).alias("y1"))
    notes = F.array_compact(F.array(
        F.when(left_by > 0, F.format_string("%.0f points further left, to fit the page", left_by)), F.when(cut, F.lit("cut at the page's width")),
        F.when(up_by > 0, F.format_string("%.0f points higher, to fit the page", up_by)), F.when(high, F.lit("lowered to the upper edge"))))
    return F.struct(rect.alias("rect"), notes.alias("notes"))
