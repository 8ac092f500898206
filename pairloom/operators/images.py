"""Sizes of images that are cut into a grid of patches; pixels themselves stay with the scorer."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pairloom.functions.text import bound


def best_resolution(width: Column, height: Column, sizes: list[tuple[int, int]]) -> Column:
    """(width, height) of the size that keeps most pixels of an image scaled into it; of equal ones that which wastes least, then the first.

    Null for null or non-positive sizes.
    """

    def rated(k: int, w: int, h: int) -> Column:
        scale = F.least(F.lit(float(w)) / width, F.lit(float(h)) / height)
        kept = F.least(F.floor(width * scale) * F.floor(height * scale), width.cast("bigint") * height)
        return F.struct((-kept).alias("lost"), (F.lit(w * h) - kept).alias("wasted"), F.lit(k).alias("k"), F.lit(w).alias("width"), F.lit(h).alias("height"))

    best = F.array_min(F.array(*[rated(k, w, h) for k, (w, h) in enumerate(sizes)]))
    return F.when((width > 0) & (height > 0), bound(best, lambda b: F.struct(b["width"].alias("width"), b["height"].alias("height"))))


def grid_shape(width: Column, height: Column, sizes: list[tuple[int, int]], patch: int) -> Column:
    """(columns, rows) of the patches of the best size."""
    return bound(best_resolution(width, height, sizes), lambda b: F.struct(F.floor(b["width"] / patch).cast("int").alias("columns"), F.floor(b["height"] / patch).cast("int").alias("rows")))


def fitted(width: Column, height: Column, to_width: Column, to_height: Column) -> Column:
    """(width, height, x, y): the size of an image scaled into another one, and where it is pasted to stand in the middle."""
    by_width, by_height = to_width / width, to_height / height
    w = F.when(by_width < by_height, to_width).otherwise(F.least(F.ceil(width * by_height), to_width))
    h = F.when(by_width < by_height, F.least(F.ceil(height * by_width), to_height)).otherwise(to_height)
    return F.struct(w.cast("int").alias("width"), h.cast("int").alias("height"), F.floor((to_width - w) / 2).cast("int").alias("x"), F.floor((to_height - h) / 2).cast("int").alias("y"))


def without_padding(width: Column, height: Column, grid_width: Column, grid_height: Column) -> Column:
    """(width, height) of what is left of a padded grid of features when the padding about an image of the given size is cut off."""
    wide = width / height > grid_width / grid_height
    pad_h = F.floor((grid_height - F.floor(height * (grid_width / width))) / 2)
    pad_w = F.floor((grid_width - F.floor(width * (grid_height / height))) / 2)
    return F.struct(F.when(wide, grid_width).otherwise(grid_width - 2 * pad_w).cast("int").alias("width"), F.when(wide, grid_height - 2 * pad_h).otherwise(grid_height).cast("int").alias("height"))
