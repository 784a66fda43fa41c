"""Scale-space keypoints with gradient-histogram descriptors, of whole arrays and of tables of tiles; and decoding of learned heat maps."""

from __future__ import annotations

import functools
import itertools
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from ..sources.shared import Folder
from . import tiles
from .stencil import gaussian
from .tiles import BLOCK, put_together

#: Grid of a descriptor and directions per cell.
GRID, BINS = 4, 8
#: Octaves end before an image's shorter side gets smaller than this, or after so many.
LEAST_SIDE, OCTAVES = 16, 8


def blur(img: np.ndarray, sigma: float) -> np.ndarray:
    k = np.array(gaussian(2 * max(1, math.ceil(3.5 * sigma)) + 1, sigma))
    r = len(k) // 2
    if min(img.shape) <= r:
        r = min(img.shape) - 1
        k = k[len(k) // 2 - r: len(k) // 2 + r + 1] / k[len(k) // 2 - r: len(k) // 2 + r + 1].sum()
    k = k.astype(img.dtype if img.dtype.kind == "f" else float)
    p = np.pad(img, ((r, r), (r, r)), mode="reflect") if r else img
    for cut in (lambda a, i, n: a[:, i: i + n], lambda a, i, n: a[i: i + n]):
        # The kernel is symmetric: two neighbours share a product; blocks of rows stay in the cache.
        n = (img.shape[1], img.shape[0])[cut(p, 0, 1).shape[0] == 1]
        out = k[r] * cut(p, r, n)
        for i in range(r):
            part = cut(p, i, n) + cut(p, 2 * r - i, n)
            part *= k[i]
            out += part
        p = out
    return p


def _scaled(img: np.ndarray, lo: float, hi: float, dtype: type = np.float32) -> np.ndarray:
    """Values from 0 to 1. Single precision will do, as 255 levels in 1024 or more sums need no more; points are refined in double."""
    return ((img.astype(np.float64) - lo) / (hi - lo)).astype(dtype) if hi > lo else np.zeros(img.shape, dtype)


def first_base(img: np.ndarray, sigma: float) -> np.ndarray:
    return blur(img, math.sqrt(max(sigma**2 - 0.25, 0.01)))


def scale_levels(base: np.ndarray, scales: int, sigma: float) -> list[np.ndarray]:
    """An octave's blurred images, from sigma to beyond twice that."""
    levels = [base]
    for s in range(1, scales + 3):
        before, now = sigma * 2 ** ((s - 1) / scales), sigma * 2 ** (s / scales)
        levels.append(blur(levels[-1], math.sqrt(now**2 - before**2)))
    return levels


def reach(scales: int = 3, sigma: float = 1.6) -> int:
    """Pixels around an extremum on which it, its directions and its descriptor depend; even, so that every second pixel keeps its place."""
    radius = lambda s: max(1, math.ceil(3.5 * s))
    steps = [radius(math.sqrt((sigma * 2 ** (s / scales)) ** 2 - (sigma * 2 ** ((s - 1) / scales)) ** 2)) for s in range(1, scales + 3)]
    largest = sigma * 2 ** ((scales + 1.5) / scales)
    window = max(math.ceil(4.5 * largest), math.ceil(3 * largest * GRID / 2 * math.sqrt(2))) + 5
    need = radius(math.sqrt(sigma**2 - 0.25)) + max(sum(steps) + 3, sum(steps[:scales]) + window)
    return need + need % 2


def extrema(dog: np.ndarray, least: float) -> np.ndarray:
    """Places (in the flattened stack) of values above ``least`` in size that lead all 26 neighbours."""
    core = dog[1:-1, 1:-1, 1:-1]
    # Only strong values are looked at, and of them only those that still lead go on to the next neighbour.
    strong = np.zeros(dog.shape, bool)
    np.greater(np.abs(core), least, out=strong[1:-1, 1:-1, 1:-1])
    flat, place = dog.ravel(), np.flatnonzero(strong)
    value = flat[place]
    for ds, dy, dx in sorted(itertools.product((-1, 0, 1), repeat=3), key=lambda v: sum(map(abs, v))):
        if (ds, dy, dx) != (0, 0, 0):
            near = flat[place + (ds * dog.shape[1] + dy) * dog.shape[2] + dx]
            lead = np.where(value > 0, value > near, value < near)
            place, value = place[lead], value[lead]
    return place


def octave_points(levels: list[np.ndarray], scales: int, contrast: float, edge: float, sigma: float, owned: tuple[int, int, int, int] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(pixels (row, column) of extrema; rows of row and column offset, scale, orientation, response; descriptors) of an octave, refined by a quadratic fit, without weak or edge-like ones. owned: the rows y0:y1 and columns x0:x1 in which
    extrema count. Nothing depends on where the image's first pixel is, so a tile gives what the whole image gives."""
    dog = np.stack([b - a for a, b in zip(levels, levels[1:])])
    s, y, x = np.unravel_index(extrema(dog, 0.5 * contrast / scales), dog.shape)
    if owned is not None:
        mine = (y >= owned[0]) & (y < owned[1]) & (x >= owned[2]) & (x < owned[3])
        s, y, x = s[mine], y[mine], x[mine]
    at = lambda ds, dy, dx: dog[s + ds, y + dy, x + dx].astype(np.float64)
    g = np.stack([at(1, 0, 0) - at(-1, 0, 0), at(0, 1, 0) - at(0, -1, 0), at(0, 0, 1) - at(0, 0, -1)], 1) / 2
    c = at(0, 0, 0)
    h = np.zeros((len(s), 3, 3))
    for i in range(3):
        e = [0, 0, 0]
        e[i] = 1
        h[:, i, i] = at(*e) + at(*(-v for v in e)) - 2 * c
        for j in range(i):
            f = [0, 0, 0]
            f[j] = 1
            p, q = [m + n for m, n in zip(e, f)], [m - n for m, n in zip(e, f)]
            h[:, i, j] = h[:, j, i] = (at(*p) - at(*q) - at(*(-v for v in q)) + at(*(-v for v in p))) / 4
    det, trace = h[:, 1, 1] * h[:, 2, 2] - h[:, 1, 2] ** 2, h[:, 1, 1] + h[:, 2, 2]
    ok = (det > 0) & (trace**2 * edge < (edge + 1) ** 2 * det) & (np.abs(np.linalg.det(h)) >= 1e-18)
    s, y, x, g, c, h = s[ok], y[ok], x[ok], g[ok], c[ok], h[ok]
    step = -np.linalg.solve(h, g[..., None])[..., 0]
    value = c + 0.5 * (g * step).sum(1)
    ok = (np.abs(step).max(1, initial=0) <= 1.5) & (np.abs(value) * scales >= contrast)
    s, y, x, step, value = s[ok], y[ok], x[ok], step[ok], value[ok]
    level, size = np.clip(np.rint(s + step[:, 0]), 1, scales).astype(int), sigma * 2 ** ((s + step[:, 0]) / scales)
    pixels, rows, descriptors = [np.zeros((0, 2), int)], [np.zeros((0, 5))], [np.zeros((0, GRID * GRID * BINS))]
    # The pixel next to a point, and what is left.
    whole = np.rint(step[:, 1:]).astype(int)
    py, px, rest = y + whole[:, 0], x + whole[:, 1], step[:, 1:] - whole
    for k in np.unique(level):
        mine = np.flatnonzero(level == k)
        gy, gx = np.gradient(levels[k])
        bins = np.rint(np.arctan2(gy, gx) * np.float32(36 / (2 * np.pi))).astype(np.int8)
        bins[bins < 0] += 36
        who, angle = _directions(gx, gy, np.hypot(gx, gy), bins, py[mine], px[mine], rest[mine], size[mine])
        who = mine[who]
        pixels.append(np.column_stack([y[who], x[who]]))
        rows.append(np.column_stack([step[who, 1], step[who, 2], size[who], angle, np.abs(value[who])]))
        descriptors.append(_describe(gx, gy, py[who], px[who], rest[who], size[who], angle))
    return np.concatenate(pixels), np.concatenate(rows), np.concatenate(descriptors)


def keypoints(img: np.ndarray, most: int = 8192, scales: int = 3, contrast: float = 0.04, edge: float = 10.0, sigma: float = 1.6) -> tuple[np.ndarray, np.ndarray]:
    """(rows of x, y, scale, orientation, response; descriptors of 128 values) of a whole image: extrema of differences of Gaussians over octaves."""
    base = first_base(_scaled(img, float(img.min()), float(img.max())), sigma)
    points, descriptors, octave = [np.zeros((0, 5))], [np.zeros((0, GRID * GRID * BINS))], 0
    while min(base.shape) >= LEAST_SIDE and octave < OCTAVES:
        levels = scale_levels(base, scales, sigma)
        at, rows, found = octave_points(levels, scales, contrast, edge, sigma)
        points.append(np.column_stack([(at[:, 1] + rows[:, 1]) * 2**octave, (at[:, 0] + rows[:, 0]) * 2**octave, rows[:, 2] * 2**octave, rows[:, 3], rows[:, 4]]))
        descriptors.append(found)
        base = levels[scales][::2, ::2]
        octave += 1
    points, descriptors = np.concatenate(points), np.concatenate(descriptors)
    order = np.lexsort((points[:, 3], points[:, 0], points[:, 1], -points[:, 4]))[:most]
    return points[order], descriptors[order]


def _directions(gx: np.ndarray, gy: np.ndarray, size_of: np.ndarray, bin_of: np.ndarray, y: np.ndarray, x: np.ndarray, rest: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(point, angle) of each dominant gradient direction around the points: peaks of a smoothed histogram of 36 bins, within 80 % of the highest.
    size_of and bin_of: length of each pixel's gradient, and its bin; rest: offsets of the points from their pixels (y, x)."""
    who, angles = [], []
    order = np.argsort(size, kind="stable")  # windows of a slice are as large as its largest scale
    for k in range(0, len(y), 256):
        mine = order[k: k + 256]
        yy, xx, scale = (v[mine, None, None].astype(np.float32) for v in (rest[:, 0], rest[:, 1], size))
        r = int(np.rint(4.5 * scale.max(initial=1)))
        span = np.arange(-r, r + 1)
        py, px = y[mine, None, None] + span[None, :, None], x[mine, None, None] + span[None, None, :]
        reach = np.rint(4.5 * scale)
        down = np.where((py > 0) & (py < gx.shape[0] - 1) & (np.abs(span[:, None]) <= reach), np.exp(-((span[None, :, None] - yy) ** 2) / (2 * (1.5 * scale) ** 2)), 0)
        across = np.where((px > 0) & (px < gx.shape[1] - 1) & (np.abs(span[None, :]) <= reach), np.exp(-((span[None, None, :] - xx) ** 2) / (2 * (1.5 * scale) ** 2)), 0)
        at = np.clip(py, 0, gx.shape[0] - 1) * gx.shape[1] + np.clip(px, 0, gx.shape[1] - 1)
        weight = size_of.ravel()[at] * (down * across)
        bins = bin_of.ravel()[at]
        n = len(yy)
        hist = np.bincount((np.arange(n)[:, None, None] * 36 + bins).ravel(), weight.ravel(), n * 36).reshape(n, 36)
        turn = lambda h, by: np.roll(h, by, axis=1)
        hist = (turn(hist, 2) + turn(hist, -2) + 4 * (turn(hist, 1) + turn(hist, -1)) + 6 * hist) / 16
        left, right = turn(hist, 1), turn(hist, -1)
        p, b = np.nonzero((hist > left) & (hist > right) & (hist >= 0.8 * hist.max(1, keepdims=True)))
        l, m, h = left[p, b], hist[p, b], right[p, b]
        who.append(mine[p])
        angles.append((b + 0.5 * (l - h) / (l - 2 * m + h)) * 2 * np.pi / 36 % (2 * np.pi))
    if not who:
        return np.zeros(0, int), np.zeros(0)
    who, angles = np.concatenate(who), np.concatenate(angles)
    order = np.argsort(who, kind="stable")
    return who[order], angles[order]


def _describe(gx: np.ndarray, gy: np.ndarray, y: np.ndarray, x: np.ndarray, rest: np.ndarray, size: np.ndarray, turn: np.ndarray) -> np.ndarray:
    """Histograms of gradient directions over 4 x 4 cells of a grid turned to the point's direction: four samples a cell and axis, shared between neighbouring cells and bins."""
    t = ((np.arange(4 * GRID) + 0.5) / 4 - GRID / 2).astype(np.float32)
    v, u = (w.ravel()[None, :] for w in np.meshgrid(t, t, indexing="ij"))
    soft = np.exp(-(u * u + v * v) / (GRID * GRID / 2))
    row, col = v[0] + GRID / 2 - 0.5, u[0] + GRID / 2 - 0.5
    near = lambda c: np.maximum(0, 1 - np.abs(c[None, :] - np.arange(GRID)[:, None]))
    shares = (near(row)[:, None] * near(col)[None, :]).reshape(GRID * GRID, -1).astype(np.float64)
    out = np.zeros((len(y), GRID * GRID * BINS))
    ry, rx, size, turn = (w.astype(np.float32) for w in (rest[:, 0], rest[:, 1], size, turn))
    for k in range(0, len(y), 512):
        part = slice(k, k + 512)
        cell, angle = 3 * size[part, None], turn[part, None]
        cos, sin = np.cos(angle), np.sin(angle)
        # Places from the point's pixel on, so that rounding doesn't depend on where that is.
        fy, fx = ry[part, None] + cell * (sin * u + cos * v), rx[part, None] + cell * (cos * u - sin * v)
        down, across = np.floor(fy), np.floor(fx)
        fy, fx = fy - down, fx - across
        y0, x0 = y[part, None] + down.astype(int), x[part, None] + across.astype(int)
        inside = (y0 >= 0) & (x0 >= 0) & (y0 + (fy > 0) < gx.shape[0]) & (x0 + (fx > 0) < gx.shape[1])
        top, left = np.clip(y0, 0, gx.shape[0] - 2), np.clip(x0, 0, gx.shape[1] - 2)
        fy, fx, at, w = fy + (y0 - top).astype(np.float32), fx + (x0 - left).astype(np.float32), top * gx.shape[1] + left, gx.shape[1]
        a, b = ((1 - fy) * ((1 - fx) * g[at] + fx * g[at + 1]) + fy * ((1 - fx) * g[at + w] + fx * g[at + w + 1]) for g in (gx.ravel(), gy.ravel()))
        weight = np.where(inside, np.hypot(a, b) * soft, 0)
        way = (np.arctan2(b, a) - angle) * np.float32(BINS / (2 * np.pi)) % BINS
        low = np.floor(way).astype(int)
        n = len(cell)
        # Two sums by the sample's place and bin (the share of the lower and of the upper bin), then one product with the places' fixed shares of the cells.
        spread = np.arange(n * len(row)).reshape(n, -1) * BINS
        upper = weight * (way - low)
        samples = np.bincount((spread + low % BINS).ravel(), (weight - upper).ravel(), n * len(row) * BINS) + np.bincount((spread + (low + 1) % BINS).ravel(), upper.ravel(), n * len(row) * BINS)
        d = np.matmul(shares, samples.reshape(n, len(row), BINS)).reshape(n, -1)
        d = np.minimum(d / (np.linalg.norm(d, axis=1, keepdims=True) + 1e-12), 0.2)
        out[part] = d / (np.linalg.norm(d, axis=1, keepdims=True) + 1e-12)
    return out


KEYPOINT = "x double, y double, scale double, orientation double, response double, descriptor array<double>"


def _octave_of_tile(pdf: pd.DataFrame, octave: int, side: int, scales: int, contrast: float, edge: float, sigma: float, dtype: str, given: str) -> pd.DataFrame:
    """A tile's keypoints of one octave, and its part of the next octave's first image."""
    img, top, left = put_together(pdf, given)
    head = pdf.iloc[0]
    base = first_base(_scaled(img, head["lo"], head["hi"], np.dtype(dtype).type), sigma) if octave == 0 else img
    levels = scale_levels(base, scales, sigma)
    y0, x0 = int(head["ty"]) * side - top, int(head["tx"]) * side - left
    y1, x1 = min(y0 + side, img.shape[0]), min(x0 + side, img.shape[1])
    at, rows, found = octave_points(levels, scales, contrast, edge, sigma, (y0, y1, x0, x1))
    out = pd.DataFrame({
        "image": head["image"], "x": (at[:, 1] + left + rows[:, 1]) * 2**octave, "y": (at[:, 0] + top + rows[:, 0]) * 2**octave, "scale": rows[:, 2] * 2**octave, "orientation": rows[:, 3], "response": rows[:, 4], "descriptor": list(found),
    })
    ahead = np.ascontiguousarray(levels[scales][y0:y1:2, x0:x1:2])
    block = pd.DataFrame([[head["image"], (top + y0) // 2, (left + x0) // 2, *ahead.shape, ahead.tobytes(), None]], columns=["image", "y0", "x0", "h", "w", "data", "descriptor"])
    out["data"] = None
    return pd.concat([out, block]).reindex(columns=_TILE_COLUMNS).astype({"y0": "Int64", "x0": "Int64", "h": "Int32", "w": "Int32"})


_TILE_SCHEMA = f"{BLOCK}, {KEYPOINT}"
_TILE_COLUMNS = [c.split()[0] for c in _TILE_SCHEMA.split(", ")]


def strongest(points: DataFrame, most: int, bins: int = 4096) -> DataFrame:
    """The ``most`` keypoints of the largest response of each image as kp_idx 0, 1, ...; ties by y, x, orientation. Counts by response say which can be among them, so that no more than those and one bin of others are put in order."""
    of = F.least(F.floor(F.col("response") * bins), F.lit(bins)).cast("int")
    counts = points.groupBy("image", of.alias("bin")).agg(F.count("*").alias("n"))
    above = F.coalesce(F.sum("n").over(Window.partitionBy("image").orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    lowest = counts.withColumn("above", above).where(F.col("above") < most).groupBy("image").agg(F.min("bin").alias("lowest"))
    kept = points.join(lowest, "image").where(of >= F.col("lowest")).drop("lowest")
    order = Window.partitionBy("image").orderBy(F.desc("response"), "y", "x", "orientation")
    return kept.withColumn("kp_idx", (F.row_number().over(order) - 1).cast("long")).where(F.col("kp_idx") < most)


def detect(px: DataFrame, most: int = 8192, side: int = 512, scales: int = 3, contrast: float = 0.04, edge: float = 10.0, sigma: float = 1.6, dtype: str = "float32") -> DataFrame:
    """(image, kp_idx, x, y, scale, orientation, response, descriptor) of a pixel table (image, y, x, v), as keypoints() gives them for each image.

    An octave is one pass over tiles of ``side`` pixels with a halo of reach() pixels: a tile owns the extrema on its own pixels and hands every second pixel on to the next octave's tiles, which are stored. So a task holds one tile, and the
    passes are at most OCTAVES, whatever the images' sizes. Images too small for an octave have no keypoints; missing pixels count as 0. The rows are stored.
    """
    def run_of(octave: int, given: str):
        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            return _octave_of_tile(pdf, octave, side, scales, contrast, edge, sigma, dtype, given)

        return run

    folder = Folder(px.sparkSession, "keypoints")
    sizes = folder.save(tiles.ends(px), "ends")
    shorter = sizes.agg(F.max(F.least("height", "width"))).first()[0] or 0
    halo, octave, found = reach(scales, sigma), 0, []
    parts, given = tiles.blocks(px, side), "float64"
    while shorter >= LEAST_SIDE and octave < OCTAVES:
        now = sizes.where(F.least("height", "width") >= LEAST_SIDE)

        made = folder.save(tiles.on_tiles(parts.join(now, "image"), run_of(octave, given), _TILE_SCHEMA, side, halo, given), f"octave{octave}")
        found.append(made.where("data IS NULL"))
        parts, given = made.where("data IS NOT NULL").select("image", "y0", "x0", "h", "w", "data"), dtype
        half = lambda c: F.ceil(F.col(c) / 2).cast("long").alias(c)
        sizes = sizes.select("image", half("height"), half("width"), "lo", "hi")
        shorter, octave = -(-shorter // 2), octave + 1
    names = [c.split()[0] for c in KEYPOINT.split(", ")]
    if not found:
        return px.sparkSession.createDataFrame([], f"image string, kp_idx long, {KEYPOINT}")
    points = functools.reduce(DataFrame.unionByName, found).select("image", *names)
    return strongest(points, most).select("image", "kp_idx", *names)


def scale_space_extrema(px: DataFrame, least: float, side: int = 512, scales: int = 3, sigma: float = 1.6) -> DataFrame:
    """(image, level, y, x, v): the first octave's extrema of differences of Gaussians in double precision, before they are refined."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        img, top, left = put_together(pdf)
        head = pdf.iloc[0]
        levels = scale_levels(first_base(_scaled(img, head["lo"], head["hi"], np.float64), sigma), scales, sigma)
        dog = np.stack([b - a for a, b in zip(levels, levels[1:])])
        place = extrema(dog, least)
        s, y, x = np.unravel_index(place, dog.shape)
        y, x = y + top, x + left
        mine = (y // side == head["ty"]) & (x // side == head["tx"])
        return pd.DataFrame({"image": head["image"], "level": s[mine], "y": y[mine], "x": x[mine], "v": dog.ravel()[place][mine]})

    parts = tiles.blocks(px, side).join(tiles.ends(px), "image")
    return tiles.on_tiles(parts, run, "image string, level long, y long, x long, v double", side, reach(scales, sigma))


def decode_heatmap(scores: np.ndarray) -> np.ndarray:
    """(65, h, w) cell scores to an (8 h, 8 w) map: softmax, the last channel dropped, cells unfolded."""
    e = np.exp(scores - scores.max(axis=0, keepdims=True))
    p = (e / e.sum(axis=0, keepdims=True))[:-1]
    return p.reshape(8, 8, *p.shape[1:]).transpose(2, 0, 3, 1).reshape(8 * p.shape[1], 8 * p.shape[2])


def decode_detections(scores: np.ndarray, descriptors: np.ndarray, most: int = 8192, radius: int = 4, least: float = 0.005, mask: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Keypoints of a network's outputs, as ``keypoints`` gives them: (65, h, w) cell scores and (d, h, w) descriptors. Peaks of the map within ``radius``, the strongest ``most``; descriptors are sampled
    bilinearly (corners aligned, zero outside) and scaled to length one."""
    heat = decode_heatmap(scores)
    if mask is not None:
        heat = np.where(mask[: heat.shape[0], : heat.shape[1]] > 0, heat, 0)
    padded = np.pad(heat, radius, constant_values=-np.inf)
    top = np.lib.stride_tricks.sliding_window_view(padded, (2 * radius + 1, 2 * radius + 1)).max((2, 3))
    y, x = np.nonzero((heat == top) & (heat >= least))
    order = np.lexsort((x, y, -heat[y, x]))[:most]
    y, x = y[order], x[order]
    _, h, w = descriptors.shape
    fy, fx = y * (h - 1) / max(1, heat.shape[0] - 1), x * (w - 1) / max(1, heat.shape[1] - 1)
    y0, x0 = np.floor(fy).astype(int), np.floor(fx).astype(int)
    out = np.zeros((len(y), descriptors.shape[0]))
    for j in (0, 1):
        for i in (0, 1):
            weight = np.where(j, fy - y0, 1 - fy + y0) * np.where(i, fx - x0, 1 - fx + x0)
            inside = (y0 + j < h) & (x0 + i < w)
            out[inside] += weight[inside, None] * descriptors[:, y0[inside] + j, x0[inside] + i].T
    out /= np.linalg.norm(out, axis=1, keepdims=True) + 1e-8
    return np.column_stack([x, y, np.full(len(y), 8.0), np.zeros(len(y)), heat[y, x]]), out


#: Detectors by the name that the settings use: (image, most) to (rows of x, y, scale, orientation, response; descriptors). Networks are added by whoever has their weights.
DETECTORS = {"sift": keypoints}


def detector(name: str):
    if name not in DETECTORS:
        raise NotImplementedError(f"detector {name!r} needs weights: add it to DETECTORS")
    return DETECTORS[name]
