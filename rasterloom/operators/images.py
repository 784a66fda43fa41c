"""Operators on pairs of aligned pixel tables: warping, blending, quality scores, correlation refinement, previews."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.scalars import clip
from . import stencil
from .tiles import blocks, put_together, seen

BICUBIC = -0.75
#: First and last neighbour, from the floor (nearest: from the rounded place), that a method reads along an axis.
REACH = {"nearest": (0, 0), "bilinear": (0, 1), "bicubic": (-1, 2), "lanczos": (-3, 4)}
BLOCK = 256


def _weights(f: np.ndarray, method: str) -> list[np.ndarray]:
    """Weights of the neighbours along one axis for fractional parts f; their sum is 1."""
    if method == "nearest":
        return [np.ones_like(f)]
    if method == "bilinear":
        return [1 - f, f]
    if method == "bicubic":
        a = BICUBIC
        near = lambda t: ((a + 2) * t - (a + 3)) * t * t + 1
        far = lambda t: ((a * t - 5 * a) * t + 8 * a) * t - 4 * a
        return [far(f + 1), near(f), near(1 - f), far(2 - f)]
    t = [f - k for k in range(-3, 5)]
    w = [np.where(np.abs(x) < 4, np.sinc(x) * np.sinc(x / 4), 0) for x in t]
    return [x / sum(w) for x in w]


def sources_of(inverse: np.ndarray, y: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(column, row) in the source of output pixels, rounded to 1e-9 of a pixel, so that exact places stay exact; places without one lie far outside."""
    with np.errstate(divide="ignore", invalid="ignore"):
        w = inverse[2, 0] * x + inverse[2, 1] * y + inverse[2, 2]
        out = [np.round((inverse[k, 0] * x + inverse[k, 1] * y + inverse[k, 2]) / w, 9) for k in (0, 1)]
    return tuple(np.clip(np.nan_to_num(c, nan=-1e15), -1e15, 1e15) for c in out)


def bases(u: np.ndarray, v: np.ndarray, method: str) -> tuple[np.ndarray, np.ndarray]:
    whole = np.rint if method == "nearest" else np.floor
    return whole(u).astype(np.int64), whole(v).astype(np.int64)


def resample(img: np.ndarray, u: np.ndarray, v: np.ndarray, method: str = "bilinear", border: float = 0.0) -> np.ndarray:
    """Values of img at columns u and rows v; neighbours outside are ``border``."""
    low, high = REACH[method]
    room = high - low + 1
    padded = np.pad(img.astype(np.float64), room, constant_values=border)
    bx, by = bases(u, v, method)
    across = [(wx, np.clip(bx + low + i + room, 0, padded.shape[1] - 1)) for i, wx in enumerate(_weights(u - bx, method))]
    total, flat = np.zeros(u.shape), padded.ravel()
    for j, wy in enumerate(_weights(v - by, method)):
        row = np.clip(by + low + j + room, 0, padded.shape[0] - 1) * padded.shape[1]
        part = sum(wx * flat[row + at] for wx, at in across)
        total += wy * part
    return total


def warp(px: DataFrame, m: Sequence[float], height: int, width: int, method: str = "bilinear", border: float = 0.0) -> DataFrame:
    """px resampled on a height x width grid by the matrix m (9 numbers, source to output). Neighbours outside the image have the value ``border``."""
    models = px.select("image").distinct().withColumns({"m": F.array(*[F.lit(float(v)) for v in m]), "height": F.lit(height), "width": F.lit(width)})
    return warp_each(px, models, method, border)


def warp_each(px: DataFrame, models: DataFrame, method: str = "bilinear", border: float = 0.0) -> DataFrame:
    """(image, y, x, v): each image of px resampled by its own model (image, m array<double> of 9 from source to output, height, width); images without a model, or with one that has no inverse, have no rows.

    Output tiles list the source blocks that their pixels touch, whatever the matrix; a block goes to the tiles that need it as one row, and each tile is resampled in one task. Tiles are smaller where the source is denser, so that a tile's source
    stays near one block in size."""
    if method not in REACH:
        raise ValueError(f"unknown interpolation {method!r}")
    low, high = REACH[method]
    kind = dict(px.dtypes)["image"]

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for image, m, height, width in pdf.itertuples(index=False):
                m = np.array(m, float).reshape(3, 3)
                if not np.isfinite(m).all() or abs(np.linalg.det(m)) < 1e-300:
                    continue
                inverse = np.linalg.inv(m)
                side = int(np.clip(BLOCK / max(1.0, np.sqrt(abs(np.linalg.det(inverse[:2, :2]))) / abs(inverse[2, 2])), 16, BLOCK))
                rows += [(image, ty, tx, side, height, width, inverse.ravel().tolist()) for ty in range(-(-height // side)) for tx in range(-(-width // side))]
                if len(rows) > 10_000:
                    yield pd.DataFrame(rows, columns=names)
                    rows = []
            yield pd.DataFrame(rows, columns=names)

    names = ["image", "ty", "tx", "side", "height", "width", "inverse"]
    tile_kind = f"image {kind}, ty long, tx long, side int, height int, width int, inverse array<double>"
    out = models.select("image", "m", F.col("height").cast("int"), F.col("width").cast("int")).mapInPandas(cut, tile_kind)

    def grid(t) -> tuple[np.ndarray, np.ndarray]:
        return np.mgrid[int(t.ty) * int(t.side): min((int(t.ty) + 1) * int(t.side), int(t.height)), int(t.tx) * int(t.side): min((int(t.tx) + 1) * int(t.side), int(t.width))]

    def touched(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for t in pdf.itertuples(index=False):
                bx, by = bases(*sources_of(np.array(t.inverse).reshape(3, 3), *grid(t)), method)
                at = np.unique(np.concatenate([np.column_stack([(by + j).ravel() // BLOCK, (bx + i).ravel() // BLOCK]) for j in (low, high) for i in (low, high)]), axis=0)
                yield pd.DataFrame({"image": t.image, "ty": t.ty, "tx": t.tx, "sy": at[:, 0], "sx": at[:, 1]})

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        t = pdf[pdf["y0"].isna()].iloc[0]
        y, x = grid(t)
        found = pdf.dropna(subset=["y0"]).astype({c: np.int64 for c in ("y0", "x0", "h", "w")})
        if found.empty:
            v = np.full(y.shape, float(border))
        else:
            img, top, left = put_together(found, fill=float(border))
            u, w = sources_of(np.array(t.inverse).reshape(3, 3), y, x)
            v = resample(img, u - left, w - top, method, border)
        return pd.DataFrame({"image": t.image, "y": y.ravel(), "x": x.ravel(), "v": v.ravel()})

    needed = out.mapInPandas(touched, f"image {kind}, ty long, tx long, sy long, sx long")
    parts = blocks(px, BLOCK, border).withColumns({"sy": F.floor(F.col("y0") / BLOCK), "sx": F.floor(F.col("x0") / BLOCK)})
    sent = parts.join(needed, ["image", "sy", "sx"]).select("image", "ty", "tx", "y0", "x0", "h", "w", "data", *[F.lit(None).cast(k).alias(c) for c, k in (("side", "int"), ("height", "int"), ("width", "int"), ("inverse", "array<double>"))])
    own = out.select("image", "ty", "tx", *[F.lit(None).cast(k).alias(c) for c, k in (("y0", "long"), ("x0", "long"), ("h", "int"), ("w", "int"), ("data", "binary"))], "side", "height", "width", "inverse")
    return sent.unionByName(own).groupBy("image", "ty", "tx").applyInPandas(run, f"image {kind}, y long, x long, v double")


def aligned(a: DataFrame, b: DataFrame) -> DataFrame:
    """(image, y, x, a, b) of pixels that both have."""
    return a.select("image", "y", "x", F.col("v").alias("a")).join(b.select("image", "y", "x", F.col("v").alias("b")), ["image", "y", "x"])


def blend(warped: DataFrame, reference: DataFrame, mode: str) -> DataFrame:
    """overlay, average or difference; 0 means no data. Shapes must be equal: a pixel of one that the other lacks is an error when the rows are read."""
    both = warped.select("image", "y", "x", F.col("v").alias("a")).join(reference.select("image", "y", "x", F.col("v").alias("b")), ["image", "y", "x"], "full_outer")
    both = both.withColumn("a", F.when(F.col("a").isNull() | F.col("b").isNull(), F.raise_error("images of different shapes").cast("double")).otherwise(F.col("a")))
    a, b = F.col("a"), F.col("b")
    two = (a > 0) & (b > 0)
    if mode == "overlay":
        v = F.when(a > 0, a).otherwise(b)
    elif mode == "average":
        v = F.when(two, (a + b) / 2).when(a > 0, a).otherwise(b)
    elif mode == "difference":
        v = F.when(two, F.abs(a - b)).otherwise(0.0)
    else:
        raise ValueError(f"unknown blend mode {mode!r}; one of overlay, average, difference")
    return both.select("image", "y", "x", v.alias("v"))


LEAST_OVERLAP = 100


def psnr(both: DataFrame) -> DataFrame:
    """(image, overlap, psnr): over pixels where both exceed 0; equal images give infinity, small overlaps 0."""
    seen = both.groupBy("image").agg(F.count_if((F.col("a") > 0) & (F.col("b") > 0)).alias("overlap"), F.avg(F.when((F.col("a") > 0) & (F.col("b") > 0), (F.col("a") - F.col("b")) ** 2)).alias("mse"))
    value = F.when(F.col("overlap") < LEAST_OVERLAP, 0.0).when(F.col("mse") < 1e-10, float("inf")).otherwise(20 * F.log10(255.0 / F.sqrt("mse")))
    return seen.select("image", "overlap", value.alias("psnr"))


def ssim(both: DataFrame) -> DataFrame:
    """Mean structural similarity over pixels where both exceed 0: 11-tap Gaussian moments of sigma 1.5, constants for a range of 255."""
    c1, c2 = (0.01 * 255) ** 2, (0.03 * 255) ** 2
    px = stencil.with_extents(both).withColumns({"ma": F.col("a"), "mb": F.col("b"), "saa": F.col("a") * F.col("a"), "sbb": F.col("b") * F.col("b"), "sab": F.col("a") * F.col("b")})
    px = stencil.separable(px, ["ma", "mb", "saa", "sbb", "sab"], stencil.gaussian(11, 1.5))
    va, vb = F.greatest(F.col("saa") - F.col("ma") ** 2, F.lit(0.0)), F.greatest(F.col("sbb") - F.col("mb") ** 2, F.lit(0.0))
    cov = F.col("sab") - F.col("ma") * F.col("mb")
    value = ((2 * F.col("ma") * F.col("mb") + c1) * (2 * cov + c2)) / ((F.col("ma") ** 2 + F.col("mb") ** 2 + c1) * (va + vb + c2))
    seen = (F.col("a") > 0) & (F.col("b") > 0)
    out = px.groupBy("image").agg(F.count_if(seen).alias("overlap"), F.avg(F.when(seen, value)).alias("s"))
    return out.select("image", F.when(F.col("overlap") < LEAST_OVERLAP, 0.0).otherwise(clip(F.col("s"), 0.0, 1.0)).alias("ssim"))


def nmi(values: DataFrame, bins: int = 32) -> DataFrame:
    """Normalised mutual information (image, nmi) of columns a and b by a joint histogram over each side's own range; marginals come from grouping sets."""
    ends = values.groupBy("image").agg(*[f(c).alias(f"{n}{c}") for c in ("a", "b") for n, f in (("lo", F.min), ("hi", F.max))])
    bin_of = lambda c: F.when(F.col(f"hi{c}") > F.col(f"lo{c}"), F.least(F.lit(bins - 1), F.floor((F.col(c) - F.col(f"lo{c}")) / (F.col(f"hi{c}") - F.col(f"lo{c}")) * bins))).otherwise(bins // 2)
    cells = values.join(ends, "image").select("image", bin_of("a").alias("ba"), bin_of("b").alias("bb")).groupBy("image", "ba", "bb").agg(F.count("*").alias("c"))
    sets = cells.groupingSets([["image", "ba", "bb"], ["image", "ba"], ["image", "bb"]], "image", "ba", "bb").agg(F.sum("c").alias("c"), F.grouping_id().alias("g"))
    n = cells.groupBy("image").agg(F.sum("c").alias("n"))
    p = F.col("c") / F.col("n")
    parts = sets.join(n, "image").groupBy("image").agg(*[(-F.sum(F.when(F.col("g") == g, p * F.log2(p + 1e-12)).otherwise(0.0))).alias(name) for name, g in (("hab", 0), ("ha", 1), ("hb", 2))])
    mutual = F.col("ha") + F.col("hb") - F.col("hab")
    return parts.select("image", clip(2 * mutual / (F.col("ha") + F.col("hb") + 1e-12), 0.0, 1.0).alias("nmi"))


# Refinement by correlation


def correlations(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Zero-mean normalised correlations of patches a (k, p, p) with all windows of that size in b (k, q, q): (k, q - p + 1, q - p + 1); 0 for flat windows."""
    size, n = a.shape[1], b.shape[1] - a.shape[1] + 1
    a = a - a.mean((1, 2), keepdims=True)
    b = b - b.mean((1, 2), keepdims=True)
    sums = []
    for v in (b, b * b):
        v = np.pad(v.cumsum(1).cumsum(2), ((0, 0), (1, 0), (1, 0)))
        sums.append(v[:, size:, size:] - v[:, :-size, size:] - v[:, size:, :-size] + v[:, :-size, :-size])
    spread = sums[1] - sums[0] ** 2 / size**2
    # What is left of a flat window is the rounding of the running sums.
    spread = np.sqrt(np.where(spread > 1e-12 * (b * b).sum((1, 2))[:, None, None], spread, np.inf))
    out = np.empty((len(a), n, n))
    flat = a.reshape(len(a), 1, -1)
    for dy in range(n):
        # The n windows of one row of offsets as columns: one product a patch.
        windows = np.lib.stride_tricks.sliding_window_view(b[:, dy: dy + size], size, axis=2)
        out[:, dy] = np.matmul(flat, np.ascontiguousarray(windows.transpose(0, 1, 3, 2)).reshape(len(a), -1, n))[:, 0]
    return out / (np.sqrt((a * a).sum((1, 2)))[:, None, None] * spread + 1e-12)


def _patches(px: DataFrame, at: DataFrame, x: str, y: str, radius: int, name: str) -> DataFrame:
    """(image, idx, name): the values around each place as bytes of doubles, row by row. A place goes to the tile that owns it, which sees ``radius`` pixels around; each patch is cut out there and leaves as one row."""
    places = at.select("image", "idx", F.col(x).alias("px"), F.col(y).alias("py"), F.floor(F.col(y) / BLOCK).alias("ty"), F.floor(F.col(x) / BLOCK).alias("tx"))
    parts = seen(px, BLOCK, radius).join(places.select("image", "ty", "tx").distinct(), ["image", "ty", "tx"], "left_semi")
    kinds = dict(at.dtypes)

    def cut(tile: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        if not len(tile) or not len(asked):
            return pd.DataFrame({"image": [], "idx": [], name: []})
        img, top, left = put_together(tile)
        inside = [img[b - top - radius: b - top + radius + 1, a - left - radius: a - left + radius + 1].tobytes() for a, b in zip(asked["px"], asked["py"])]
        return pd.DataFrame({"image": asked["image"], "idx": asked["idx"], name: inside})

    keys = ["image", "ty", "tx"]
    return parts.groupBy(*keys).cogroup(places.groupBy(*keys)).applyInPandas(cut, f"image {kinds['image']}, idx {kinds['idx']}, {name} binary")


def ncc_map(source: DataFrame, reference: DataFrame, matches: DataFrame, patch: int = 21, search: int = 3) -> DataFrame:
    """(match columns, ix, iy, jx, jy, dy, dx, ncc): zero-mean normalised correlation of each match's source patch with the reference at offsets -search..search around the rounded places.
    Matches whose patch or window leaves the image, or is flat (deviation under 1e-4), drop out; missing pixels count as 0. Each patch and each window is cut once, by the tile that it lies in, and correlated in batches: two rows a match are shuffled."""
    half = patch // 2
    cols = matches.columns
    m = matches.withColumns({"ix": F.rint("sx").cast("long"), "iy": F.rint("sy").cast("long"), "jx": F.rint("rx").cast("long"), "jy": F.rint("ry").cast("long")})
    for px, x, y, r in ((source, "ix", "iy", half), (reference, "jx", "jy", half + search)):
        m = m.join(stencil.extents(px), "image").where((F.col(x) >= r) & (F.col(x) < F.col("width") - r) & (F.col(y) >= r) & (F.col(y) < F.col("height") - r)).drop("height", "width")
    m = m.select(*cols, "ix", "iy", "jx", "jy")
    cut = m.join(_patches(source, m, "ix", "iy", half, "_a"), ["image", "idx"]).join(_patches(reference, m, "jx", "jy", half + search, "_b"), ["image", "idx"])
    p, q, n = 2 * half + 1, 2 * (half + search) + 1, 2 * search + 1

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for k in range(0, len(pdf), 256):
                part = pdf.iloc[k: k + 256]
                a, b = (np.frombuffer(b"".join(part[c]), np.float64).reshape(-1, n, n) for c, n in (("_a", p), ("_b", q)))
                varied = (a.std((1, 2)) >= 1e-4) & (b.std((1, 2)) >= 1e-4)
                part, ncc = part[varied].drop(columns=["_a", "_b"]), correlations(a[varied], b[varied])
                dy, dx = np.mgrid[-search: search + 1, -search: search + 1]
                yield part.loc[part.index.repeat(n * n)].assign(dy=np.tile(dy.ravel(), len(part)), dx=np.tile(dx.ravel(), len(part)), ncc=ncc.ravel())

    key = [*cols, "ix", "iy", "jx", "jy"]
    types = dict(m.dtypes)
    return cut.select(*key, "_a", "_b").mapInPandas(run, ", ".join(f"`{c}` {types[c]}" for c in key) + ", dy int, dx int, ncc double")


def refine(maps: DataFrame, least: float = 0.7, search: int = 3) -> DataFrame:
    """(image, idx, sx, sy, rx, ry, ncc, accuracy): each match's correlation peak (the first in row order), with a parabola through its neighbours on each axis where the peak is inside; weak peaks drop out."""
    key = ["image", "idx"]
    across, down = Window.partitionBy(*key, "dy").orderBy("dx"), Window.partitionBy(*key, "dx").orderBy("dy")
    near = maps.withColumns({"l": F.lag("ncc").over(across), "r": F.lead("ncc").over(across), "u": F.lag("ncc").over(down), "d": F.lead("ncc").over(down)})
    peak = near.withColumn("k", F.row_number().over(Window.partitionBy(*key).orderBy(F.desc(F.round("ncc", 9)), "dy", "dx"))).where(f"k = 1 and ncc >= {least}")

    def offset(before: str, after: str, at: str) -> Column:
        bend = 2 * F.col("ncc") - F.col(before) - F.col(after)
        return F.when((F.abs(at) < search) & (F.abs(bend) > 1e-5), (F.col(after) - F.col(before)) / (2 * bend)).otherwise(0.0)

    return peak.select(*key, "sx", "sy", (F.col("jx") + F.col("dx") + offset("l", "r", "dx")).alias("rx"), (F.col("jy") + F.col("dy") + offset("u", "d", "dy")).alias("ry"), "ncc", (0.05 * (1 - F.col("ncc")) + 0.01).alias("accuracy"))


def accuracy(refined: DataFrame) -> DataFrame:
    """Mean and median accuracy of each image's matches."""
    return refined.groupBy("image").agg(F.avg("accuracy").alias("mean_accuracy"), F.median("accuracy").alias("median_accuracy"))


def preview(px: DataFrame, most: int = 1024) -> DataFrame:
    """Stretched to 0..255 and shrunk so that the longest side has at most ``most`` pixels: means over the source cells of each output pixel."""
    from .illumination import contrast_to_u8

    px = stencil.with_extents(contrast_to_u8(px))
    scale = F.least(F.lit(1.0), F.lit(float(most)) / F.greatest("height", "width"))
    to = lambda c, size: F.least(F.floor(F.col(c) * F.greatest(F.floor(F.col(size) * scale), F.lit(1)) / F.col(size)), F.greatest(F.floor(F.col(size) * scale), F.lit(1)) - 1)
    return px.groupBy("image", to("y", "height").alias("y"), to("x", "width").alias("x")).agg(F.floor(F.avg("v")).cast("double").alias("v"))


def sample(px: DataFrame, points: DataFrame) -> DataFrame:
    """(image, idx, v): bilinear values at points (image, idx, x, y); neighbours outside count as 0."""
    bx, by = F.floor("x"), F.floor("y")
    fx, fy = F.col("x") - bx, F.col("y") - by
    taps = F.array(*[F.struct((by + j).alias("y"), (bx + i).alias("x"), ((fx if i else 1 - fx) * (fy if j else 1 - fy)).alias("w")) for j in (0, 1) for i in (0, 1)])
    asked = points.select("image", "idx", F.explode(taps).alias("t")).select("image", "idx", "t.y", "t.x", "t.w")
    return asked.join(px, ["image", "y", "x"], "left").groupBy("image", "idx").agg(F.sum(F.col("w") * F.coalesce("v", F.lit(0.0))).alias("v"))
