"""Neighbourhood operators on pixel tables (image, y, x, v) by window frames over mirrored rows and columns.

Frames are partitioned by image row, then by image column, so a large raster spreads over its rows and columns; only ``radius`` mirrored pixels
per row end are added. An image has pixels at 0..height-1 and 0..width-1.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

ROW, COLUMN = ("y", "x"), ("x", "y")


def extents(px: DataFrame) -> DataFrame:
    return px.groupBy("image").agg((F.max("y") + 1).alias("height"), (F.max("x") + 1).alias("width"))


def with_extents(px: DataFrame) -> DataFrame:
    return px.join(extents(px), "image")


def mirror(px: DataFrame, along: str, size: str, radius: int) -> DataFrame:
    """px (with a column ``size``) and up to ``radius`` copies beyond either end of ``along``; the edge pixel is not repeated."""
    at, n = F.col(along), F.col(size)
    places = F.filter(F.array(at, F.when((at >= 1) & (at <= radius), -at), F.when((at <= n - 2) & (at >= n - 1 - radius), 2 * (n - 1) - at)), lambda p: p.isNotNull())
    return px.withColumn(along, F.explode(places))


def _frame(axis: tuple[str, str]) -> Window:
    return Window.partitionBy("image", axis[0]).orderBy(axis[1])


def shifted(col: Column, k: int, w) -> Column:
    return col if k == 0 else F.lead(col, k).over(w) if k > 0 else F.lag(col, -k).over(w)


def weighted(px: DataFrame, columns: Sequence[str], weights: Sequence[float], axis: tuple[str, str]) -> DataFrame:
    """Correlates each column with the odd kernel along one axis (borders mirrored)."""
    radius, size = len(weights) // 2, "width" if axis[1] == "x" else "height"
    w = _frame(axis)
    sums = {c: sum((shifted(F.col(c), k - radius, w) * float(g) for k, g in enumerate(weights) if g and k), shifted(F.col(c), -radius, w) * float(weights[0])) for c in columns}
    out = mirror(px, axis[1], size, radius).withColumns({f"_{c}": s for c, s in sums.items()}).where((F.col(axis[1]) >= 0) & (F.col(axis[1]) < F.col(size)))
    return out.withColumns({c: F.col(f"_{c}") for c in columns}).drop(*[f"_{c}" for c in columns])


def separable(px: DataFrame, columns: Sequence[str], weights: Sequence[float]) -> DataFrame:
    return weighted(weighted(px, columns, weights, ROW), columns, weights, COLUMN)


def box(px: DataFrame, columns: Sequence[str], size: int) -> DataFrame:
    """Means over size x size, borders mirrored, by running frames: the cost doesn't depend on the size."""
    radius = size // 2
    for axis, extent in ((ROW, "width"), (COLUMN, "height")):
        w = _frame(axis).rowsBetween(-radius, radius)
        px = mirror(px, axis[1], extent, radius).withColumns({f"_{c}": F.sum(c).over(w) / float(size) for c in columns})
        px = px.where((F.col(axis[1]) >= 0) & (F.col(axis[1]) < F.col(extent))).withColumns({c: F.col(f"_{c}") for c in columns}).drop(*[f"_{c}" for c in columns])
    return px


def gaussian(size: int, sigma: float) -> list[float]:
    raw = [math.exp(-((k - size // 2) ** 2) / (2 * sigma * sigma)) for k in range(size)]
    return [g / sum(raw) for g in raw]


def local_normal(px: DataFrame, size: int = 31) -> DataFrame:
    """(v - local mean) / (local deviation + 1e-4) over an odd box; even sizes grow by one."""
    size += 1 - size % 2
    sums = box(with_extents(px).withColumns({"m": F.col("v"), "s": F.col("v") * F.col("v")}), ["m", "s"], size)
    return sums.select("image", "y", "x", ((F.col("v") - F.col("m")) / (F.sqrt(F.greatest(F.col("s") - F.col("m") * F.col("m"), F.lit(0.0))) + 1e-4)).alias("v"))


def sobel(px: DataFrame) -> DataFrame:
    """3x3 derivatives gx and gy."""
    px = with_extents(px).withColumns({"gx": F.col("v"), "gy": F.col("v")})
    px = weighted(weighted(px, ["gx"], [-1, 0, 1], ROW), ["gx"], [1, 2, 1], COLUMN)
    px = weighted(weighted(px, ["gy"], [1, 2, 1], ROW), ["gy"], [-1, 0, 1], COLUMN)
    return px.select("image", "y", "x", "v", "gx", "gy")


def orientation(px: DataFrame) -> DataFrame:
    """Gradient direction in [0, 2 pi)."""
    a = F.atan2("gy", "gx")
    return sobel(px).select("image", "y", "x", F.when(a < 0, a + 2 * math.pi).otherwise(a).alias("v"))


def local_peaks(px: DataFrame, radius: int = 4, least: float = 0.005) -> DataFrame:
    """Pixels that are the largest of their square neighbourhood and at least ``least``."""
    across = Window.partitionBy("image", "y").orderBy("x").rowsBetween(-radius, radius)
    down = Window.partitionBy("image", "x").orderBy("y").rowsBetween(-radius, radius)
    top = px.withColumn("top", F.max("v").over(across)).withColumn("top", F.max("top").over(down))
    return top.where((F.col("v") == F.col("top")) & (F.col("v") >= least)).select("image", "y", "x", "v")


def top_peaks(peaks: DataFrame, most: int) -> DataFrame:
    """The ``most`` strongest of each image; ties by row, then column. Counts by ranges of values say which can be among them; of those, each task hands on ``most`` of an image at most."""
    v = F.col("v").cast("double")
    # Grows with v as it is sorted: null first, what isn't a number last.
    place = F.when(F.isnan(v), float("inf")).otherwise(F.signum(v) * F.floor(F.log2(1 + F.abs(v)) * 1024))
    place = F.coalesce(place, F.lit(float("-inf")))
    counts = peaks.groupBy("image", place.alias("place")).agg(F.count("*").alias("n"))
    above = F.coalesce(F.sum("n").over(Window.partitionBy("image").orderBy(F.desc("place")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    lowest = counts.withColumn("above", above).where(F.col("above") < most).groupBy("image").agg(F.min("place").alias("lowest"))
    # One row an image is broadcast: a shuffle by image would bring a large one to one task.
    own = F.broadcast(lowest.select(F.col("image").alias("_image"), "lowest"))
    kept = peaks.join(own, F.col("image").eqNullSafe(F.col("_image")) & (place >= F.col("lowest"))).select(peaks.columns)
    w = Window.partitionBy("image").orderBy(F.desc("v"), "y", "x")
    # The number itself is compared, so that the limit holds before the shuffle, too.
    return kept.withColumn("kp_idx", F.row_number().over(w)).where(F.col("kp_idx") <= most).withColumn("kp_idx", F.col("kp_idx") - 1)


def half(px: DataFrame) -> DataFrame:
    """One pyramid step of factor one half: a blur of sigma 1 over 7 taps, then means of 2 x 2 pixels; a last odd row or column is left out."""
    blurred = separable(with_extents(px), ["v"], gaussian(7, 1.0)).where("y < 2 * floor(height / 2) and x < 2 * floor(width / 2)")
    return blurred.groupBy("image", F.floor(F.col("y") / 2).alias("y"), F.floor(F.col("x") / 2).alias("x")).agg(F.avg("v").alias("v"))


def shrink(px: DataFrame, factor: float) -> DataFrame:
    """One pyramid step of any factor below 1: a blur of sigma 1 / (2 factor), then means over each output pixel's area. A pixel lies in one or two output rows and columns; its shares
    are exact fractions of the sizes."""
    sigma = 1 / (2 * factor)
    px = separable(with_extents(px), ["v"], gaussian(2 * max(1, math.ceil(3.5 * sigma)) + 1, sigma))

    def shares(at: str, size: str) -> Column:
        n, size = F.greatest(F.rint(F.col(size) * factor).cast("long"), F.lit(1)), F.col(size)
        first = F.floor(F.col(at) * n / size)
        inside = lambda k: (F.least((F.col(at) + 1) * n, (first + k + 1) * size) - F.greatest(F.col(at) * n, (first + k) * size)) / size
        return F.explode(F.filter(F.array(*[F.struct((first + k).alias("at"), inside(k).alias("w")) for k in (0, 1)]), lambda p: p["w"] > 0))

    parts = px.withColumn("a", shares("y", "height")).withColumn("b", shares("x", "width"))
    return parts.groupBy("image", F.col("a.at").alias("y"), F.col("b.at").alias("x")).agg(F.sum(F.col("a.w") * F.col("b.w") * F.col("v")).alias("v"))


def pyramid(px: DataFrame, levels: int = 4, factor: float = 0.5) -> DataFrame:
    """(level, scale, image, y, x, v); values are cut to whole numbers at each level, as in an integer raster (after rounding to 1e-6, so that the order of sums decides nothing)."""
    at, out = px, px.select(F.lit(0).alias("level"), F.lit(1.0).alias("scale"), "image", "y", "x", "v")
    for k in range(1, levels):
        at = (half(at) if factor == 0.5 else shrink(at, factor)).withColumn("v", F.floor(F.round("v", 6)).cast("double"))
        out = out.unionByName(at.select(F.lit(k).alias("level"), F.lit(factor**k).alias("scale"), "image", "y", "x", "v"))
    return out
