"""Column functions over boxes, image sizes and feature grids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def box_to_pixels(x1: Column, y1: Column, x2: Column, y2: Column, width: Column, height: Column) -> Column:
    """struct(x1, y1, x2, y2) of a box on the 0-1000 grid: ordered, rounded half to even, inside the image, never empty."""

    def side(a: Column, b: Column, size: Column) -> tuple[Column, Column]:
        p, q = a / 1000.0 * size, b / 1000.0 * size
        low, high = F.rint(F.least(p, q)).cast("long"), F.rint(F.greatest(p, q)).cast("long")
        edge = F.when(size > 0, size - 1).otherwise(F.lit(0))
        start = F.greatest(F.lit(0), F.least(low, edge))
        return start, F.greatest(start + 1, F.least(high, size))

    left, right = side(x1, x2, width)
    top, bottom = side(y1, y2, height)
    return F.struct(*(c.cast("int").alias(n) for c, n in ((left, "x1"), (top, "y1"), (right, "x2"), (bottom, "y2"))))


def clamp_box(box: Column, width: Column, height: Column) -> Column:
    """The second clamp, when a block is cut out; boxes of ``box_to_pixels`` pass unchanged."""
    x1, y1 = F.greatest(F.lit(0), F.least(box["x1"], width - 1)), F.greatest(F.lit(0), F.least(box["y1"], height - 1))
    return F.struct(x1.alias("x1"), y1.alias("y1"), F.greatest(x1 + 1, F.least(box["x2"], width)).alias("x2"), F.greatest(y1 + 1, F.least(box["y2"], height)).alias("y2"))


def resized(width: Column, height: Column, least_pixels: Column, most_pixels: Column) -> Column:
    """struct(width, height) scaled into a range of pixel counts, fractions cut off."""
    area = width * height
    scale = F.when(area < least_pixels, F.sqrt(least_pixels / area)).when(area > most_pixels, F.sqrt(most_pixels / area)).otherwise(F.lit(1.0))
    return F.struct((width * scale).cast("int").alias("width"), (height * scale).cast("int").alias("height"))


def display_to_natural(offset: Column, shown: Column, natural: Column) -> Column:
    """A position in a shown image in natural pixels, halves up."""
    return F.floor(offset / shown * natural + 0.5)


def grid_position(index: Column, w: int, m1: int, m2: int, channels: int) -> Column:
    """struct(row, col, channel) of a flat entry of a (h w m1 m2) c feature map laid out as (h m1)(w m2) c."""
    cell = F.floor(index / channels)
    b, a = cell % m2, F.floor(cell / m2) % m1
    x, y = F.floor(cell / (m1 * m2)) % w, F.floor(cell / (m1 * m2 * w))
    return F.struct((y * m1 + a).cast("int").alias("row"), (x * m2 + b).cast("int").alias("col"), (index % channels).cast("int").alias("channel"))


def cropped_size(width: Column, height: Column, shown_width: Column, shown_height: Column, natural_width: Column, natural_height: Column) -> Column:
    """struct(width, height) of a crop drawn on a shown image, in natural pixels: halves up, one at least."""

    def side(drawn: Column, shown: Column, natural: Column) -> Column:
        return F.greatest(F.lit(1), F.floor(drawn * (natural / shown) + 0.5)).cast("int")

    return F.struct(side(width, shown_width, natural_width).alias("width"), side(height, shown_height, natural_height).alias("height"))
