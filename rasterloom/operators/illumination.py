"""Illumination normalisation: stretches, histogram methods, and phase congruency by a numpy kernel."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from . import stencil

METHODS = ("phase_congruency", "clahe", "gradient", "lnms")


def stretch(px: DataFrame, eps: float = 0.0) -> DataFrame:
    """Minimum to 0 and maximum to 1 for each image; a flat image becomes 0."""
    ends = px.groupBy("image").agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    unit = F.when(F.col("hi") > F.col("lo"), (F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo") + eps)).otherwise(0.0)
    return px.join(ends, "image").withColumn("v", unit).drop("lo", "hi")


def contrast_to_u8(px: DataFrame) -> DataFrame:
    return stretch(px).withColumn("v", F.floor(F.col("v") * 255.0).cast("double"))


def equalize(px: DataFrame) -> DataFrame:
    """Histogram equalisation of whole values 0..255: the table of cumulative counts maps the smallest value to 0 and the largest to 255."""
    counts = px.groupBy("image", "v").agg(F.count("*").alias("c"))
    running = counts.withColumn("cdf", F.sum("c").over(Window.partitionBy("image").orderBy("v")))
    first = running.groupBy("image").agg(F.min("cdf").alias("base"), F.max("cdf").alias("n"))
    table = running.join(first, "image").select("image", "v", F.when(F.col("n") > F.col("base"), F.rint((F.col("cdf") - F.col("base")) * 255.0 / (F.col("n") - F.col("base")))).otherwise(F.col("v")).alias("mapped"))
    return px.join(table, ["image", "v"]).select("image", "y", "x", F.col("mapped").alias("v"))


def clahe_tables(px: DataFrame, clip: float = 2.0, grid: tuple[int, int] = (8, 8)) -> DataFrame:
    """(image, ty, tx, v, mapped) for whole values 0..255: each grid cell's clipped, redistributed and accumulated histogram."""
    cells = stencil.with_extents(px).withColumns({"ty": F.floor(F.col("y") * grid[0] / F.col("height")), "tx": F.floor(F.col("x") * grid[1] / F.col("width"))})
    counts = cells.groupBy("image", "ty", "tx", "v").agg(F.count("*").alias("c"))
    area = counts.groupBy("image", "ty", "tx").agg(F.sum("c").alias("n")).withColumn("most", F.greatest(F.floor(F.lit(clip) * F.col("n") / 256), F.lit(1)))
    spill = counts.join(area, ["image", "ty", "tx"]).groupBy("image", "ty", "tx").agg(F.max("n").alias("n"), F.max("most").alias("most"), F.sum(F.greatest(F.col("c") - F.col("most"), F.lit(0))).alias("spill"))
    every = spill.withColumn("v", F.explode(F.sequence(F.lit(0), F.lit(255)))).withColumn("v", F.col("v").cast("double")).join(counts, ["image", "ty", "tx", "v"], "left")
    share = F.floor(F.col("spill") / 256)
    left = F.col("spill") - 256 * share  # goes to every so many-th value
    stride = F.greatest(F.floor(256 / F.greatest(left, F.lit(1))), F.lit(1))
    rest = F.when((F.col("v") % stride == 0) & (F.col("v") / stride < left), 1).otherwise(0)
    level = F.least(F.coalesce("c", F.lit(0)), F.col("most")) + share + rest
    w = Window.partitionBy("image", "ty", "tx").orderBy("v")
    return every.withColumn("cdf", F.sum(level).over(w)).select("image", "ty", "tx", "v", F.least(F.rint(F.col("cdf") * 255.0 / F.col("n")), F.lit(255.0)).alias("mapped"))


def clahe(px: DataFrame, clip: float = 2.0, grid: tuple[int, int] = (8, 8)) -> DataFrame:
    """Contrast-limited equalisation: pixels are stretched to 0..255, and blended between the tables of the four nearest cells. Pixels meet their four tables in one join by the
    square between the cells' middles, of which an image has (rows + 1) x (columns + 1). Blends are rounded to 1e-6 first, so that the order of the sum decides nothing."""
    px = contrast_to_u8(px)
    luts = clahe_tables(px, clip, grid).groupBy("image", "ty", "tx").agg(F.transform(F.array_sort(F.collect_list(F.struct("v", "mapped"))), lambda p: p["mapped"]).alias("lut"))

    def squares(at: str, n: int) -> Column:
        # Square k lies between cells k and k + 1, cut to the grid; a cell is the first or the second of a square's two.
        ends = [F.when(F.col(at) == 0, F.struct(F.lit(-1).cast("long").alias("q"), F.lit(0).alias("end"))), F.struct((F.col(at) - 1).alias("q"), F.lit(1).alias("end")), F.struct(F.col(at).alias("q"), F.lit(0).alias("end")), F.when(F.col(at) == n - 1, F.struct(F.col(at).alias("q"), F.lit(1).alias("end")))]
        return F.explode(F.array_compact(F.array(*ends)))

    near = luts.withColumn("a", squares("ty", grid[0])).withColumn("b", squares("tx", grid[1]))
    corner = lambda i, j: F.max(F.when((F.col("a.end") == i) & (F.col("b.end") == j), F.col("lut"))).alias(f"l{i}{j}")
    near = near.groupBy("image", F.col("a.q").alias("qy"), F.col("b.q").alias("qx")).agg(*[corner(i, j) for i in (0, 1) for j in (0, 1)])
    place = lambda at, size, n: F.col(at) * n / F.col(size) - 0.5
    fy, fx = place("y", "height", grid[0]), place("x", "width", grid[1])
    parts = stencil.with_extents(px).select("image", "y", "x", F.col("v").cast("int").alias("k"), F.floor(fy).alias("qy"), F.floor(fx).alias("qx"), (fy - F.floor(fy)).alias("wy"), (fx - F.floor(fx)).alias("wx"))
    wy, wx, value = F.col("wy"), F.col("wx"), lambda i, j: F.get(f"l{i}{j}", F.col("k"))
    blend = (1 - wy) * (1 - wx) * value(0, 0) + (1 - wy) * wx * value(0, 1) + wy * (1 - wx) * value(1, 0) + wy * wx * value(1, 1)
    return parts.join(near, ["image", "qy", "qx"]).select("image", "y", "x", F.rint(F.round(blend, 6)).alias("v"))


def sun_ramp(px: DataFrame, degrees: float, axis: str = "x") -> DataFrame:
    """A simulated change of sun angle: a linear ramp along the axis, a gamma, and for 40 degrees or more a shadow on the dim side."""
    strength = min(max(degrees / 90.0, 0.0), 0.9)
    at, n = F.col(axis), F.col("width" if axis == "x" else "height")
    place = F.when(n > 1, at / (n - 1)).otherwise(0.0)
    unit = lambda c: F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0))
    lit = F.pow(unit(F.col("v") / 255.0 * (1.0 - strength + 2.0 * strength * place)), F.lit(1.0 + 0.4 * strength))
    if degrees >= 40.0:
        lit = unit(lit + (-0.12 + 0.12 * place))
    return stencil.with_extents(px).select("image", "y", "x", F.floor(lit * 255.0).cast("double").alias("v"))


def phase_congruency_array(img: np.ndarray, scales: int = 4, orientations: int = 6) -> np.ndarray:
    """Energy over amplitude of log-Gabor responses, summed over orientations; 0 to 1, in single precision. Depends on the array's size."""
    rows, cols = img.shape
    spectrum = np.fft.fft2(img.astype(np.float32))
    u = np.fft.ifftshift(-0.5 + np.arange(cols) * ((1.0 - 1.0 / cols) / max(1, cols - 1)))[None, :]
    v = np.fft.ifftshift(-0.5 + np.arange(rows) * ((1.0 - 1.0 / rows) / max(1, rows - 1)))[:, None]
    radius = np.hypot(u, v)
    radius[0, 0] = 1.0
    angle = np.arctan2(-v, u)
    angle = np.where(angle < 0, angle + np.pi, angle).astype(np.float32)
    octaves, radial = np.log(radius * 3.0).astype(np.float32), []
    for s in range(scales):
        g = np.exp(-((octaves + np.float32(s * math.log(2.1))) ** 2) / np.float32(2 * math.log(0.55) ** 2))
        g[0, 0] = 0.0
        radial.append(g * spectrum)
    energy, amplitude = np.zeros(img.shape, np.float32), np.zeros(img.shape, np.float32)
    for o in range(orientations):
        apart = np.abs(angle - np.float32(o * np.pi / orientations))
        spread = np.exp(-(np.minimum(apart, np.float32(np.pi) - apart) ** 2) / np.float32(2 * (0.6 * np.pi / orientations) ** 2))
        total, noise = np.zeros(img.shape, np.complex64), np.float32(0)
        for s, part in enumerate(radial):
            response = np.fft.ifft2(part * spread)
            size = np.abs(response)
            total += response
            amplitude += size
            if s == 0:
                noise = 2 * np.median(size)
        energy += np.maximum(np.abs(total) - noise, 0)
    return np.clip(energy / (amplitude + 1e-4), 0, 1)


def phase_congruency(px: DataFrame, tile: int = 2048, overlap: int = 128, scales: int = 4, orientations: int = 6) -> DataFrame:
    """Phase congruency by tiles: cores of tile - 2 overlap pixels, each computed with up to ``overlap`` pixels around it. A raster within one tile is computed whole.
    A task holds one tile with its halo, whatever the raster's size."""
    step = tile - 2 * overlap
    px = stencil.with_extents(px)
    whole = (F.col("height") <= tile) & (F.col("width") <= tile)

    def cover(at: str, size: str) -> Column:
        low = F.greatest(F.floor((F.col(at) - overlap) / step), F.lit(0))
        high = F.least(F.floor((F.col(at) + overlap) / step), F.floor((F.col(size) - 1) / step))
        return F.when(whole, F.array(F.lit(0).cast("long"))).otherwise(F.sequence(low, high))

    cells = px.withColumn("whole", whole).withColumn("ty", F.explode(cover("y", "height"))).withColumn("tx", F.explode(cover("x", "width")))

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        y0, x0 = pdf["y"].min(), pdf["x"].min()
        img = np.zeros((pdf["y"].max() - y0 + 1, pdf["x"].max() - x0 + 1), np.float32)
        img[pdf["y"] - y0, pdf["x"] - x0] = pdf["v"]
        out = pdf.assign(v=phase_congruency_array(img, scales, orientations)[pdf["y"] - y0, pdf["x"] - x0])
        core = out["whole"] | ((out["y"] // step == key[1]) & (out["x"] // step == key[2]))
        return out.loc[core, ["image", "y", "x", "v"]]

    return cells.select("image", "ty", "tx", "y", "x", "v", "whole").groupBy("image", "ty", "tx").applyInPandas(run, "image string, y long, x long, v double")


def normalize(px: DataFrame, method: str) -> DataFrame:
    """The named method; a value outside METHODS is an error."""
    if method == "phase_congruency":
        return phase_congruency(px)
    if method == "clahe":
        return clahe(px)
    if method == "gradient":
        return stencil.orientation(px)
    if method == "lnms":
        return stencil.local_normal(px)
    raise ValueError(f"unknown illumination method {method!r}; one of {', '.join(METHODS)}")
