"""A whole registration: two rasters in, transform, scores and a warped raster out. One pair is one task; many pairs are one plan.

The steps are those of the operators, on arrays: normalise, bridge the scale gap with pyramids, detect, match, reject, refine, fit, check, refine at full resolution, warp, score.
A failure anywhere makes a failed result with its stage and message, never an exception.
"""

from __future__ import annotations

import math
import time
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from ..operators.features import blur, detector
from ..operators.images import correlations, resample, sources_of
from ..operators.illumination import phase_congruency_array
from ..operators.points import affine_array, distances, homography_array, reject_array
from .config import RegistrationConfig

THRESHOLD, LEAST_NCC, SEARCH = 3.0, 0.7, 3
PAIRS_A_TASK = 4


def stretch_u8(img: np.ndarray) -> np.ndarray:
    img = img.astype(np.float64)
    lo, hi = img.min(), img.max()
    return np.floor((img - lo) / (hi - lo) * 255) if hi > lo else np.zeros(img.shape)


def box_mean(img: np.ndarray, size: int) -> np.ndarray:
    r = size // 2
    s = np.pad(np.pad(img, r, mode="reflect").cumsum(0).cumsum(1), ((1, 0), (1, 0)))
    return (s[size:, size:] - s[:-size, size:] - s[size:, :-size] + s[:-size, :-size]) / size**2


def clahe(img: np.ndarray, clip: float = 2.0, grid: int = 8) -> np.ndarray:
    v = stretch_u8(img).astype(int)
    h, w = v.shape
    ys, xs = np.arange(h) * grid // h, np.arange(w) * grid // w
    luts = np.zeros((grid, grid, 256))
    for i in range(grid):
        for j in range(grid):
            cell = v[ys == i][:, xs == j]
            c = np.bincount(cell.ravel(), minlength=256)
            most = max(1, int(clip * cell.size / 256))
            over = int(np.maximum(c - most, 0).sum())
            c = np.minimum(c, most) + over // 256
            left = over % 256
            if left:
                c[:: max(1, 256 // left)][:left] += 1
            luts[i, j] = np.minimum(np.rint(c.cumsum() * 255.0 / max(1, cell.size)), 255)
    fy, fx = np.arange(h) * grid / h - 0.5, np.arange(w) * grid / w - 0.5
    y0, x0 = np.floor(fy).astype(int), np.floor(fx).astype(int)
    ay, ax = (fy - y0)[:, None], (fx - x0)[None, :]
    at = lambda i, j: luts[np.clip(y0 + i, 0, grid - 1)[:, None], np.clip(x0 + j, 0, grid - 1)[None, :], v]
    return np.rint((1 - ay) * ((1 - ax) * at(0, 0) + ax * at(0, 1)) + ay * ((1 - ax) * at(1, 0) + ax * at(1, 1)))


def normalise(img: np.ndarray, method: str) -> np.ndarray:
    """The named method as whole values 0..255."""
    if method == "clahe":
        return clahe(img)
    img = img.astype(np.float64)
    if method == "phase_congruency":
        out = phase_congruency_tiled(img)
    elif method == "lnms":
        m = box_mean(img, 31)
        out = (img - m) / (np.sqrt(np.maximum(box_mean(img * img, 31) - m * m, 0)) + 1e-4)
    else:
        p = np.pad(img, 1, mode="reflect")
        gx = (p[:-2, 2:] + 2 * p[1:-1, 2:] + p[2:, 2:]) - (p[:-2, :-2] + 2 * p[1:-1, :-2] + p[2:, :-2])
        gy = (p[2:, :-2] + 2 * p[2:, 1:-1] + p[2:, 2:]) - (p[:-2, :-2] + 2 * p[:-2, 1:-1] + p[:-2, 2:])
        out = np.arctan2(gy, gx) % (2 * np.pi)
    return np.floor(np.clip(out * 255, 0, 255))


def phase_congruency_tiled(img: np.ndarray, tile: int = 2048, overlap: int = 128) -> np.ndarray:
    if max(img.shape) <= tile:
        return phase_congruency_array(img)
    out, step = np.zeros(img.shape), tile - 2 * overlap
    for y in range(0, img.shape[0], step):
        for x in range(0, img.shape[1], step):
            y0, x0 = max(0, y - overlap), max(0, x - overlap)
            part = phase_congruency_array(img[y0: y + step + overlap, x0: x + step + overlap])
            out[y: y + step, x: x + step] = part[y - y0: y - y0 + step, x - x0: x - x0 + step]
    return out


def pyramid(img: np.ndarray, levels: int, factor: float) -> tuple[list[np.ndarray], list[float]]:
    out, scales = [img], [1.0]
    for _ in range(1, levels):
        h, w = out[-1].shape
        if min(h, w) < 8:
            break
        soft = blur(out[-1], 1 / (2 * factor))
        out.append(np.floor(area_resize(soft, max(1, round(h * factor)), max(1, round(w * factor)))))
        scales.append(scales[-1] * factor)
    return out, scales


def area_resize(img: np.ndarray, height: int, width: int) -> np.ndarray:
    """Means over each output pixel's area, by differences of interpolated running sums."""
    for axis, n in ((0, height), (1, width)):
        s = np.concatenate([np.zeros_like(img.take([0], axis)), img.cumsum(axis)], axis)
        at = np.linspace(0, img.shape[axis], n + 1)
        low = np.minimum(np.floor(at).astype(int), img.shape[axis] - 1)
        f = (at - low).reshape((-1, 1) if axis == 0 else (1, -1))
        edges = s.take(low, axis) * (1 - f) + s.take(low + 1, axis) * f
        img = np.diff(edges, axis=axis) * (n / img.shape[axis])
    return img


def levels_for(s_res: float, r_res: float, factor: float, count: int) -> tuple[int, int]:
    found = []
    for r in range(count):
        ref = r_res / factor**r
        s = min(range(count), key=lambda k: (abs(s_res / factor**k - ref), k))
        eff = s_res / factor**s
        if max(eff, ref) / min(eff, ref) < 2:
            found.append((s, r))
    return min(found, key=lambda p: (p[0] + p[1], p[1])) if found else (0, 0)


def match(a: np.ndarray, b: np.ndarray, ratio: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(source index, reference index, confidence) of ratio-test matches, in blocks."""
    if not len(a) or not len(b):
        return np.zeros(0, int), np.zeros(0, int), np.zeros(0)
    out, (low_a, low_b) = [], (v.astype(np.float32) for v in (a, b))
    norms = (low_b * low_b).sum(1) / 2
    apart = lambda p, q: np.sqrt(((p - q) ** 2).sum(1))
    for k in range(0, len(a), 1024):
        mine, row = a[k: k + 1024], np.arange(min(1024, len(a) - k))
        # Single precision finds the two nearest; their distances are taken in double.
        d = norms - low_a[k: k + 1024] @ low_b.T
        one = d.argmin(1)
        first = apart(mine, b[one])
        if len(b) == 1:
            keep, conf = np.ones(len(mine), bool), 1 / (1 + first)
        else:
            d[row, one] = np.inf
            two = d.argmin(1)
            second = apart(mine, b[two])
            one, (first, second) = np.where(second < first, two, one), np.sort([first, second], axis=0)
            keep, conf = first < ratio * second, 1 - first / (second + 1e-8)
        out.append((np.flatnonzero(keep) + k, one[keep], conf[keep]))
    return tuple(np.concatenate(x) for x in zip(*out))


#: Matchers by the name that the settings use: (descriptors, descriptors, ratio) to (source indexes, reference indexes, confidences).
MATCHERS = {"bf": match}


def refine(source: np.ndarray, reference: np.ndarray, src: np.ndarray, dst: np.ndarray, patch: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(kept indexes, refined reference points, correlations)."""
    w, r, n = patch // 2, SEARCH, 2 * SEARCH + 1
    (sx, sy), (rx, ry) = (np.rint(p).astype(int).reshape(-1, 2).T for p in (src, dst))
    inside = lambda x, y, m, img: (x >= m) & (y >= m) & (x + m < img.shape[1]) & (y + m < img.shape[0])
    at = np.flatnonzero(inside(sx, sy, w, source) & inside(rx, ry, w + r, reference))
    kept, points, scores = [np.zeros(0, int)], [np.zeros((0, 2))], [np.zeros(0)]
    for k in range(0, len(at), 256):
        i = at[k: k + 256]
        near, far = np.arange(-w, w + 1), np.arange(-w - r, w + r + 1)
        a = source[sy[i, None, None] + near[:, None], sx[i, None, None] + near].astype(np.float64)
        b = reference[ry[i, None, None] + far[:, None], rx[i, None, None] + far].astype(np.float64)
        varied = (a.std((1, 2)) >= 1e-4) & (b.std((1, 2)) >= 1e-4)
        i, a, b = i[varied], a[varied], b[varied]
        ncc = correlations(a, b)
        py, px = np.unravel_index(ncc.reshape(len(i), -1).argmax(1), (n, n))
        row = np.arange(len(i))
        peak, step = ncc[row, py, px], []
        for place, before, after in ((px, (py, px - 1), (py, px + 1)), (py, (py - 1, px), (py + 1, px))):
            l, h = ncc[row, np.clip(before[0], 0, n - 1), np.clip(before[1], 0, n - 1)], ncc[row, np.clip(after[0], 0, n - 1), np.clip(after[1], 0, n - 1)]
            bend = 2 * peak - l - h
            ok = (place > 0) & (place < n - 1) & (np.abs(bend) > 1e-5)
            step.append(np.where(ok, (h - l) / np.where(ok, 2 * bend, 1), 0))
        good = peak >= LEAST_NCC
        kept.append(i[good])
        points.append(np.column_stack([rx[i] - r + px + step[0], ry[i] - r + py + step[1]])[good])
        scores.append(peak[good])
    return np.concatenate(kept), np.concatenate(points), np.concatenate(scores)


def warp(img: np.ndarray, m: np.ndarray, shape: tuple[int, int], method: str = "bilinear", border: float = 0.0) -> np.ndarray:
    """img on a grid of ``shape`` by the inverse of m, in bands of rows."""
    inverse, out = np.linalg.inv(m), np.empty(shape)
    for k in range(0, shape[0], 64):
        y, x = np.mgrid[k: min(k + 64, shape[0]), : shape[1]]
        u, v = sources_of(inverse, y, x)
        # Only the rows that the band reads.
        low = int(np.clip(v.min() - 8, 0, img.shape[0] - 1))
        high = int(np.clip(v.max() + 9, low + 1, img.shape[0]))
        out[k: k + 64] = resample(img[low:high], u, v - low, method, border)
    return out


def assess(warped: np.ndarray, reference: np.ndarray, inliers: int, matches: int, rmse: float) -> dict[str, float]:
    seen = (warped > 0) & (reference > 0)
    out = {"ssim": 0.0, "psnr": 0.0, "mutual_information": 0.0, "q_score": 0.0, "inlier_ratio": inliers / matches if matches else 0.0, "rmse": rmse}
    if seen.sum() < 100:
        return out
    a, b = warped.astype(np.float64), reference.astype(np.float64)
    mse = ((a - b)[seen] ** 2).mean()
    out["psnr"] = math.inf if mse < 1e-10 else 20 * math.log10(255 / math.sqrt(mse))

    def soft(x: np.ndarray) -> np.ndarray:
        from ..operators.stencil import gaussian

        k = gaussian(11, 1.5)
        p = np.pad(x, 5, mode="reflect")
        p = sum(g * p[:, i: i + x.shape[1]] for i, g in enumerate(k))
        x = sum(g * p[i: i + x.shape[0]] for i, g in enumerate(k))
        return x

    ma, mb = soft(a), soft(b)
    va, vb, cov = np.maximum(soft(a * a) - ma * ma, 0), np.maximum(soft(b * b) - mb * mb, 0), soft(a * b) - ma * mb
    c1, c2 = 6.5025, 58.5225
    out["ssim"] = float(np.clip((((2 * ma * mb + c1) * (2 * cov + c2)) / ((ma**2 + mb**2 + c1) * (va + vb + c2)))[seen].mean(), 0, 1))
    joint = np.histogram2d(a[seen], b[seen], 32)[0] / seen.sum()
    entropy = lambda p: -(p * np.log2(p + 1e-12)).sum()
    ha, hb = entropy(joint.sum(1)), entropy(joint.sum(0))
    out["mutual_information"] = float(np.clip(2 * (ha + hb - entropy(joint)) / (ha + hb + 1e-12), 0, 1))
    out["q_score"] = float(np.clip(0.4 * out["ssim"] + 0.4 * out["mutual_information"] + 0.2 * out["inlier_ratio"], 0, 1))
    return out


@dataclass
class Fit:
    m: np.ndarray
    src: np.ndarray
    dst: np.ndarray
    rmse: float
    matches: int
    scores: np.ndarray


def _condition(m: np.ndarray) -> tuple[float, float, float]:
    s = np.linalg.svd(m[:2, :2], compute_uv=False)
    return s[0], s[1], s[0] / (s[1] + 1e-8)


def plausible(m: np.ndarray) -> bool:
    high, low, condition = _condition(m)
    return bool(np.linalg.det(m[:2, :2]) > 0 and high <= 20 and low >= 0.05 and condition <= 50)


def _pass(config: RegistrationConfig, a: np.ndarray, b: np.ndarray, scales: tuple[float, float], raw: tuple[np.ndarray, np.ndarray], model: str | None) -> Fit:
    if config.matching_method not in MATCHERS:
        raise NotImplementedError(f"matcher {config.matching_method!r} needs weights: add it to MATCHERS")
    find = detector(config.detection_method)
    (pa, da), (pb, db) = find(a, config.max_keypoints), find(b, config.max_keypoints)
    i, j, conf = MATCHERS[config.matching_method](da, db, config.lowe_ratio)
    if config.matching_method != "bf":  # networks give a confidence of their own
        sure = conf >= config.match_threshold
        i, j, conf = i[sure], j[sure], conf[sure]
    src, dst = pa[i, :2] / scales[0], pb[j, :2] / scales[1]
    if model is None:
        span = np.ptp(src, axis=0).max() if len(src) else 0
        model = "projective" if span >= 2000 else "affine"
    kind = "homography" if model == "projective" else "affine"
    mask, _ = reject_array(src, dst, kind, config.outlier_method, THRESHOLD, config.ransac_confidence, config.ransac_max_iters)
    src, dst, conf = src[mask], dst[mask], conf[mask]
    if config.refine_subpixel and len(src) >= 3:
        kept, points, scores = refine(raw[0], raw[1], src, dst, config.refinement_patch_size)
        if len(kept) >= (4 if kind == "homography" else 3):
            src, dst, conf = src[kept], points, scores
    m = (homography_array if kind == "homography" else affine_array)(src, dst)
    if m is None:
        raise ValueError(f"Insufficient points: {len(src)} for {model}")
    d = distances(kind, m, src, dst)
    return Fit(m, src, dst, float(np.sqrt((d**2).mean())), len(i), conf)


def register_arrays(source: np.ndarray, reference: np.ndarray, config: RegistrationConfig, s_res: float = 1.0, r_res: float = 1.0) -> dict:
    """The result record of one pair of single-band arrays; never raises."""
    began, stage = time.perf_counter(), "normalise"
    try:
        a, b = source.astype(np.float64), reference.astype(np.float64)
        na, nb = normalise(a, config.illumination_method), normalise(b, config.illumination_method)
        stage, scales, la, lb = "pyramid", (1.0, 1.0), na, nb
        gap = max(s_res, r_res) / (min(s_res, r_res) + 1e-8) > 1.2
        if gap:
            count, f = config.pyramid_levels or 5, config.pyramid_scale_factor
            (va, sa), (vb, sb) = pyramid(na, count, f), pyramid(nb, count, f)
            s, r = levels_for(s_res, r_res, f, min(len(va), len(vb)))
            la, lb, scales = va[s], vb[r], (sa[s], sb[r])
        stage = "match"
        fit = _pass(config, la, lb, scales, (stretch_u8(a), stretch_u8(b)), config.transform_type)
        if not plausible(fit.m):
            raise ValueError("the transform is not plausible")
        stage = "full resolution"
        if gap and config.full_res_refine:
            better = _full_resolution(config, a, b, fit)
            if better is not None:
                fit = better
        stage = "warp"
        warped = warp(a, fit.m, b.shape, config.interpolation)
        quality = assess(warped, b, len(fit.src), max(fit.matches, len(fit.src)), fit.rmse)
        cells = {(min(7, int(y * 8 / b.shape[0])), min(7, int(x * 8 / b.shape[1]))) for x, y in fit.dst if 0 <= x < b.shape[1] and 0 <= y < b.shape[0]}
        quality["spatial_distribution_score"] = len(cells) / 64
        return {"success": True, "m": fit.m, "matches": fit, "metrics": quality, "warped": warped, "seconds": time.perf_counter() - began, "stage": None, "error": None}
    except Exception as e:  # the record says what failed
        return {"success": False, "m": None, "matches": None, "metrics": None, "warped": None, "seconds": time.perf_counter() - began, "stage": stage, "error": f"{type(e).__name__}: {e}"}


def _full_resolution(config: RegistrationConfig, a: np.ndarray, b: np.ndarray, coarse: Fit) -> Fit | None:
    """A second pass on the reference warped into the source's grid; None unless it is at least as good."""
    try:
        back = warp(b, np.linalg.inv(coarse.m), a.shape, "bilinear")
        fit = _pass(config, stretch_u8(a), stretch_u8(back), (1.0, 1.0), (stretch_u8(a), stretch_u8(back)), config.transform_type)
    except (ValueError, np.linalg.LinAlgError):
        return None
    m = coarse.m @ fit.m
    p = np.column_stack([fit.dst, np.ones(len(fit.dst))]) @ coarse.m.T
    dst = p[:, :2] / p[:, 2:]
    d = distances("homography", m / m[2, 2], fit.src, dst)
    rmse = float(np.sqrt((d**2).mean()))
    good = len(fit.src) >= 10 and plausible(m) and (rmse <= coarse.rmse + 1e-6 or (len(coarse.src) < 10 and rmse < 1))
    return Fit(m / m[2, 2], fit.src, dst, rmse, max(fit.matches, len(fit.src)), fit.scores) if good else None


RESULT = (
    "pair_id string, success boolean, m array<double>, metrics map<string,double>, matches array<struct<sx:double,sy:double,rx:double,ry:double,confidence:double>>, output string, stage string, error string, seconds double"
)


def register_pairs(pairs: DataFrame, config: RegistrationConfig, out: str | None = None) -> DataFrame:
    """Results of pairs (pair_id, source, reference: paths that executors reach). Each row is read, registered and, where ``out`` is given, written as <out>/<pair_id>_registered.tif by the task that has it;
    all bands are warped, the first one is matched."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples():
                yield pd.DataFrame([_one(str(r.pair_id), r.source, r.reference, config, out)], columns=[c.split()[0] for c in RESULT.replace("map<string,double>", "x").replace("array<struct<sx:double,sy:double,rx:double,ry:double,confidence:double>>", "x").split(", ")])

    # A few pairs a task, so that a lost executor repeats few.
    slots = max(pairs.sparkSession.sparkContext.defaultParallelism, -(-pairs.count() // PAIRS_A_TASK), 1)
    return pairs.select("pair_id", "source", "reference").repartition(slots).mapInPandas(run, RESULT)


def _one(pair_id: str, source: str, reference: str, config: RegistrationConfig, out: str | None) -> tuple:
    from ..operators.rules import DEFAULT_RESOLUTION, sensor_of
    from ..sources.raster import load_pair

    try:
        s, r = load_pair(source, reference)
    except Exception as e:
        return pair_id, False, None, None, None, None, "load", f"{type(e).__name__}: {e}", 0.0
    size = lambda x, path: abs(x.geotransform[1]) if x.geotransform and x.crs else DEFAULT_RESOLUTION[sensor_of(path, x.tags)]
    found = register_arrays(s.data[0], r.data[0], config, size(s, source), size(r, reference))
    if not found["success"]:
        return pair_id, False, None, None, None, None, found["stage"], found["error"], found["seconds"]
    fit, path, stage = found["matches"], None, "export"
    try:
        if out:
            path = _export(pair_id, s, r, found["m"], config, out)
    except Exception as e:  # a full disk or a lost folder fails this pair alone; its transform stays
        fit_m = found["m"].ravel().tolist()
        return pair_id, False, fit_m, {k: float(v) for k, v in found["metrics"].items()}, None, None, stage, f"{type(e).__name__}: {e}", found["seconds"]
    matches = [dict(zip(("sx", "sy", "rx", "ry", "confidence"), map(float, (*p, *q, c)))) for p, q, c in zip(fit.src, fit.dst, fit.scores)]
    return pair_id, True, found["m"].ravel().tolist(), {k: float(v) for k, v in found["metrics"].items()}, matches, path, None, None, found["seconds"]


def _export(pair_id: str, s, r, m: np.ndarray, config: RegistrationConfig, out: str) -> str:
    """All bands of s warped onto r's grid, as <out>/<pair_id>_registered.tif; the file appears when it is whole."""
    from ..sources import codecs
    from ..sources.raster import _open

    kind = s.data.dtype
    bands = [warp(b, m, r.data.shape[1:], config.interpolation) for b in s.data]
    limits = (np.iinfo(kind).min, np.iinfo(kind).max) if kind.kind in "iu" else (-np.inf, np.inf)
    data = np.clip(np.stack(bands), *limits).astype(kind)
    files, root = _open(out)
    files.create_dir(root, recursive=True)
    path = f"{root}/{pair_id}_registered.tif"
    with files.open_output_stream(path + ".part") as f:
        f.write(codecs.write_tiff(codecs.Raster(data, r.crs, r.geotransform, r.nodata)))
    files.move(path + ".part", path)
    return path
