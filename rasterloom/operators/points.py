"""Operators on keypoints and tie points (pair_id, idx, sx, sy, rx, ry, confidence): matching, robust rejection, fits, scores."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.scalars import clip

BLOCK = 1024
#: Descriptors of a pair and side that one task compares, about.
SIDE = 4096


def _two_nearest(s: np.ndarray, r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of s, row of r, distance) of the two nearest rows of r for each row of s (one, if r has no more), ties to the smaller row. Squares by a matrix product only choose
    candidates: all within its rounding error of the second; their distances are computed without cancellation."""
    norms = (r * r).sum(1)
    own = (s * s).sum(1)
    d = own[:, None] + norms[None, :] - 2 * s @ r.T
    bound = np.partition(d, min(1, len(r) - 1), axis=1)[:, min(1, len(r) - 1)] + 1e-12 * (1 + s.shape[1]) * (own + norms.max())
    i, j = np.nonzero(d <= bound[:, None])
    exact = np.concatenate([np.sqrt(((s[i[k: k + 65536]] - r[j[k: k + 65536]]) ** 2).sum(1)) for k in range(0, len(i), 65536)])
    order = np.lexsort((j, exact, i))
    i, j, exact = i[order], j[order], exact[order]
    rank = np.arange(len(i)) - np.searchsorted(i, i)
    return i[rank < 2], j[rank < 2], exact[rank < 2]


def ratio_match(source: DataFrame, reference: DataFrame, ratio: float = 0.75, norm: str = "l2", blocks: int | None = None) -> DataFrame:
    """(pair_id, source_idx, reference_idx, distance, confidence) of each source descriptor's nearest reference, if it is nearer than ``ratio`` times the second nearest.

    Inputs: (pair_id, idx, descriptor array<double>, or long for norm hamming). One direction; references may be taken many times; ties go to the smaller idx. A pair with one reference has no second: then all
    match, with confidence 1 / (1 + d). Descriptors are compared in blocks by matrix products: a pair's sources are cut into ``blocks`` blocks, its references into as many (default: each side so that a block has about SIDE rows; a
    pair has as many as it needs itself), each pair of blocks is a task, and two candidates per source and block go on.
    """
    hamming = norm == "hamming"
    sizes = source.select("pair_id", F.lit(0).alias("side")).unionByName(reference.select("pair_id", F.lit(1).alias("side"))).groupBy("pair_id", "side").count()
    # Each side has blocks by its own rows: a row is copied once for each block of the other side.
    n = lambda side: F.ceil(F.greatest(F.max(F.when(F.col("side") == side, F.col("count"))), F.lit(1)) / SIDE) if blocks is None else F.lit(blocks)
    sizes = sizes.groupBy("pair_id").agg(n(0).cast("int").alias("of_a"), n(1).cast("int").alias("of_b"))
    cut = lambda df, col: df.join(F.broadcast(sizes), "pair_id").withColumn(col, F.pmod(F.xxhash64("idx"), F.col(f"of_{col}")).cast("int"))
    every = lambda col: F.explode(F.sequence(F.lit(0), F.col(f"of_{col}") - 1))
    a = cut(source, "a").withColumn("b", every("b")).withColumn("side", F.lit(0))
    b = cut(reference, "b").withColumn("a", every("a")).withColumn("side", F.lit(1))
    both = a.select("pair_id", "a", "b", "side", "idx", "descriptor").unionByName(b.select("pair_id", "a", "b", "side", "idx", "descriptor"))

    def nearest(pdf: pd.DataFrame) -> pd.DataFrame:
        src, ref = pdf[pdf["side"] == 0], pdf[pdf["side"] == 1].sort_values("idx")
        if not len(src) or not len(ref):
            return pd.DataFrame(columns=["pair_id", "source_idx", "reference_idx", "distance", "n"])
        ri, out = ref["idx"].to_numpy(), []
        r = ref["descriptor"].to_numpy() if hamming else np.stack(ref["descriptor"].to_numpy())
        for k in range(0, len(src), BLOCK):
            part = src.iloc[k: k + BLOCK]
            if hamming:
                d = np.bitwise_count((part["descriptor"].to_numpy()[:, None] ^ r[None, :]).view(np.uint64)).astype(float)
                two = np.argsort(d, axis=1, kind="stable")[:, :2]
                i, j, dist = np.repeat(np.arange(len(part)), two.shape[1]), two.ravel(), np.take_along_axis(d, two, axis=1).ravel()
            else:
                i, j, dist = _two_nearest(np.stack(part["descriptor"].to_numpy()), r)
            out.append(pd.DataFrame({"pair_id": part["pair_id"].iloc[0], "source_idx": part["idx"].to_numpy()[i], "reference_idx": ri[j], "distance": dist, "n": len(ref)}))
        return pd.concat(out)

    kind = dict(source.dtypes)["pair_id"]
    found = both.groupBy("pair_id", "a", "b").applyInPandas(nearest, f"pair_id {kind}, source_idx long, reference_idx long, distance double, n long")
    w = Window.partitionBy("pair_id", "source_idx").orderBy("distance", "reference_idx")
    ranked = found.withColumns({"k": F.row_number().over(w), "second": F.lead("distance").over(w)}).where("k = 1")
    kept = ranked.where(F.col("second").isNull() | (F.col("distance") < ratio * F.col("second")))
    confidence = F.when(F.col("second").isNull(), 1 / (1 + F.col("distance"))).otherwise(1 - F.col("distance") / (F.col("second") + 1e-8))
    return kept.select("pair_id", "source_idx", "reference_idx", "distance", confidence.alias("confidence"))


def keep_confident(matches: DataFrame, least: float, order: str = "idx") -> DataFrame:
    """Matches of at least that confidence, numbered anew within each pair."""
    kept = matches.where(F.col("confidence") >= least)
    return kept.withColumn("ordinal", F.row_number().over(Window.partitionBy("pair_id").orderBy(order)) - 1)


def rescale(matches: DataFrame, source_scale: float, reference_scale: float) -> DataFrame:
    """Points of pyramid levels back to full resolution."""
    return matches.withColumns({"sx": F.col("sx") / source_scale, "sy": F.col("sy") / source_scale, "rx": F.col("rx") / reference_scale, "ry": F.col("ry") / reference_scale})


# Fits


def affine_fit(matches: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Least squares (m0..m5, n) for each pair from one aggregate of moments; null coefficients for fewer than three or collinear points."""
    keys = keys or ["pair_id"]
    moments = matches.groupBy(*keys).agg(
        F.count("*").alias("n"), *[F.avg(c).alias(f"mean_{c}") for c in ("sx", "sy", "rx", "ry")], F.var_pop("sx").alias("vx"), F.var_pop("sy").alias("vy"), F.covar_pop("sx", "sy").alias("cxy"),
        *[F.covar_pop(a, b).alias(f"c_{a}_{b}") for a in ("sx", "sy") for b in ("rx", "ry")],
    )
    det = F.col("vx") * F.col("vy") - F.col("cxy") * F.col("cxy")
    ok = (F.col("n") >= 3) & (det > 1e-9)
    moments = moments.withColumn("det", F.when(ok, det))
    out = {}
    for k, to in enumerate(("rx", "ry")):
        out[f"m{3 * k}"] = (F.col("vy") * F.col(f"c_sx_{to}") - F.col("cxy") * F.col(f"c_sy_{to}")) / F.col("det")
        out[f"m{3 * k + 1}"] = (F.col("vx") * F.col(f"c_sy_{to}") - F.col("cxy") * F.col(f"c_sx_{to}")) / F.col("det")
    moments = moments.withColumns(out)
    shift = {f"m{3 * k + 2}": F.col(f"mean_{to}") - F.col(f"m{3 * k}") * F.col("mean_sx") - F.col(f"m{3 * k + 1}") * F.col("mean_sy") for k, to in enumerate(("rx", "ry"))}
    return moments.withColumns(shift).select(*keys, "n", "m0", "m1", "m2", "m3", "m4", "m5")


def affine_residual() -> Column:
    """Distance of a match from its transform's columns m0..m5."""
    x = F.col("m0") * F.col("sx") + F.col("m1") * F.col("sy") + F.col("m2") - F.col("rx")
    y = F.col("m3") * F.col("sx") + F.col("m4") * F.col("sy") + F.col("m5") - F.col("ry")
    return F.sqrt(x * x + y * y)


def residuals(matches: DataFrame, transforms: DataFrame) -> DataFrame:
    return matches.join(transforms.select("pair_id", "m0", "m1", "m2", "m3", "m4", "m5"), "pair_id").withColumn("residual", affine_residual())


def auto_model(matches: DataFrame, far: float = 2000.0) -> DataFrame:
    """projective for pairs whose source points span ``far`` pixels or more along an axis, else affine."""
    span = F.greatest(F.max("sx") - F.min("sx"), F.max("sy") - F.min("sy"))
    return matches.groupBy("pair_id").agg(F.when(span >= far, "projective").otherwise("affine").alias("model"))


def homography_array(src: np.ndarray, dst: np.ndarray) -> np.ndarray | None:
    """Least squares over all points by the normalised direct linear transform; null for fewer than four."""
    if len(src) < 4:
        return None

    def normal(p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        c = p.mean(0)
        s = np.sqrt(2) / max(np.sqrt(((p - c) ** 2).sum(1)).mean(), 1e-12)
        return (p - c) * s, np.array([[s, 0, -s * c[0]], [0, s, -s * c[1]], [0, 0, 1]])

    (a, ta), (b, tb) = normal(src), normal(dst)
    one, zero = np.ones(len(a)), np.zeros((len(a), 3))
    h = np.column_stack([a, one])
    rows = np.concatenate([np.hstack([h, zero, -b[:, :1] * h]), np.hstack([zero, h, -b[:, 1:] * h])])
    m = np.linalg.inv(tb) @ np.linalg.eigh(rows.T @ rows)[1][:, 0].reshape(3, 3) @ ta
    return m / m[2, 2] if abs(m[2, 2]) > 1e-12 else None


def fundamental_array(src: np.ndarray, dst: np.ndarray) -> np.ndarray | None:
    """The normalised eight-point fundamental matrix; null for fewer than eight."""
    if len(src) < 8:
        return None

    def normal(p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        c = p.mean(0)
        s = np.sqrt(2) / max(np.sqrt(((p - c) ** 2).sum(1)).mean(), 1e-12)
        return np.column_stack([(p - c) * s, np.ones(len(p))]), np.array([[s, 0, -s * c[0]], [0, s, -s * c[1]], [0, 0, 1]])

    (a, ta), (b, tb) = normal(src), normal(dst)
    rows = np.einsum("ni,nj->nij", b, a).reshape(len(a), 9)
    u, s, vt = np.linalg.svd(np.linalg.eigh(rows.T @ rows)[1][:, 0].reshape(3, 3))
    return tb.T @ (u @ np.diag([s[0], s[1], 0]) @ vt) @ ta


def affine_array(src: np.ndarray, dst: np.ndarray) -> np.ndarray | None:
    if len(src) < 3:
        return None
    a = np.column_stack([src, np.ones(len(src))])
    m, _, rank, _ = np.linalg.lstsq(a, dst, rcond=None)
    return np.vstack([m.T, [0, 0, 1]]) if rank == 3 else None


FITS = {"affine": (affine_array, 3), "homography": (homography_array, 4), "fundamental": (fundamental_array, 8)}


def distances(model: str, m: np.ndarray, src: np.ndarray, dst: np.ndarray) -> np.ndarray:
    """Pixels between transformed source and reference points; for fundamental matrices, to the epipolar lines, the larger of both sides."""
    a, b = np.column_stack([src, np.ones(len(src))]), np.column_stack([dst, np.ones(len(dst))])
    if model == "fundamental":
        lb, la = a @ m.T, b @ m
        up = np.abs((b * lb).sum(1))
        return np.maximum(up / (np.hypot(lb[:, 0], lb[:, 1]) + 1e-12), up / (np.hypot(la[:, 0], la[:, 1]) + 1e-12))
    p = a @ m.T
    return np.hypot(*(p[:, :2] / (p[:, 2:] + 1e-8) - dst).T)


def reject_array(src: np.ndarray, dst: np.ndarray, model: str = "affine", method: str = "ransac", threshold: float = 3.0, confidence: float = 0.999, most: int = 10_000, seed: int = 42) -> tuple[np.ndarray, np.ndarray | None]:
    """(inlier mask, 3x3 model or None). ransac counts inliers, magsac++ sums weights over noise scales and refits by them, lmeds takes the least median. Any failure gives no inliers."""
    fit, need = FITS[model]
    none = np.zeros(len(src), bool)
    if len(src) < max(need, 4 if model == "homography" else need):
        return none, None
    rng = np.random.default_rng(seed)

    def score(d: np.ndarray) -> float:
        if method == "lmeds":
            return -float(np.median(d))
        if method == "magsac++":
            return float(np.maximum(0, 1 - (d / (1.5 * threshold)) ** 2).sum())
        return float((d <= threshold).sum())

    best, best_m, tries, k = -np.inf, None, most, 0
    try:
        while k < tries:
            k += 1
            pick = rng.choice(len(src), need, replace=False)
            m = fit(src[pick], dst[pick])
            if m is None or not np.isfinite(m).all():
                continue
            d = distances(model, m, src, dst)
            s = score(d)
            if s > best:
                best, best_m = s, m
                share = min(max((d <= threshold).mean(), 1e-6), 1 - 1e-9)
                tries = min(tries, k + int(np.ceil(np.log(1 - confidence) / np.log(1 - share**need + 1e-300))))
        for _ in range(5):  # refine on what fits
            if best_m is None:
                return none, None
            d = distances(model, best_m, src, dst)
            m = fit(src[d <= threshold], dst[d <= threshold])
            if m is None or score(distances(model, m, src, dst)) < best:
                break
            best, best_m = score(distances(model, m, src, dst)), m
    except np.linalg.LinAlgError:
        return none, None
    return distances(model, best_m, src, dst) <= threshold, best_m


def reject(matches: DataFrame, model: str = "affine", method: str = "ransac", threshold: float = 3.0, confidence: float = 0.999, most: int = 10_000) -> DataFrame:
    """Matches with inlier (boolean) and the pair's model (array of 9, null if none was found). One pair is one task."""
    columns = ", ".join(f"`{c}` {t}" for c, t in matches.drop("inlier", "model").dtypes) + ", inlier boolean, model array<double>"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("idx").reset_index(drop=True)
        mask, m = reject_array(pdf[["sx", "sy"]].to_numpy(float), pdf[["rx", "ry"]].to_numpy(float), model, method, threshold, confidence, most)
        return pdf.assign(inlier=mask, model=[None if m is None else m.ravel().tolist()] * len(pdf))

    return matches.drop("inlier", "model").groupBy("pair_id").applyInPandas(run, columns)


# Scores


def uniformity(points: DataFrame, width: float, height: float, grid: int = 8) -> DataFrame:
    """max(0, 1 - deviation / mean) of the counts in grid x grid cells for each image (columns image, x, y); empty cells count, an image without points has no row."""
    cell = lambda c, size: F.least(F.greatest(F.floor(F.col(c) * grid / size), F.lit(0)), F.lit(grid - 1))
    counts = points.groupBy("image", cell("y", height).alias("cy"), cell("x", width).alias("cx")).agg(F.count("*").alias("c"))
    sums = counts.groupBy("image").agg(F.sum("c").alias("n"), F.sum(F.col("c") * F.col("c")).alias("q"))
    mean = F.col("n") / float(grid * grid)
    spread = F.sqrt(F.greatest(F.col("q") / float(grid * grid) - mean * mean, F.lit(0.0)))
    return sums.select("image", F.greatest(F.lit(0.0), 1 - spread / mean).alias("uniformity"))


def occupancy(points: DataFrame, width: float, height: float, grid: int = 8) -> DataFrame:
    """Share of the grid's cells that hold a point."""
    cell = lambda c, size: F.least(F.greatest(F.floor(F.col(c) * grid / size), F.lit(0)), F.lit(grid - 1))
    return points.groupBy("image").agg((F.count_distinct(cell("y", height) * grid + cell("x", width)) / float(grid * grid)).alias("occupancy"))


def repeatable(a: DataFrame, b: DataFrame, radius: float = 6.0) -> DataFrame:
    """Points of a (image, idx, x, y) with a point of b nearer than ``radius``: a range semi-join by cells of that size, of which a point looks at nine."""
    cell = lambda c: F.floor(F.col(c) / radius)
    near = F.array(*[F.struct((cell("x") + i).alias("cx"), (cell("y") + j).alias("cy")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    left = a.withColumn("c", F.explode(near)).select("image", "idx", "x", "y", "c.cx", "c.cy")
    right = b.select("image", F.col("x").alias("bx"), F.col("y").alias("by"), cell("x").alias("cx"), cell("y").alias("cy")).dropDuplicates()
    ok = (left["image"] == right["image"]) & (left["cx"] == right["cx"]) & (left["cy"] == right["cy"]) & ((F.col("x") - F.col("bx")) ** 2 + (F.col("y") - F.col("by")) ** 2 < radius * radius)
    return left.join(right, ok, "left_semi").select("image", "idx", "x", "y").distinct()


def q_score(ssim: Column, nmi: Column, ratio: Column) -> Column:
    return clip(0.4 * ssim + 0.4 * nmi + 0.2 * ratio, 0.0, 1.0)
