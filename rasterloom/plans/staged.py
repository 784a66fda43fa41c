"""A registration as a plan of tables: every stage of all pairs is a stored table, so a lost executor repeats a part of a stage, and no pair or raster has to fit a task.

Stages: normalised rasters, levels for pairs of different resolution, keypoints by tiles, candidates of the ratio test, robust models, refined points, fits, a second pass at full resolution for pairs with a gap, warped rasters, scores. A pair
that fails has the stage and the reason in its row; the others go on. ``register_pairs`` does the same for many small pairs, one task each, from files.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.scalars import invert3, matmul3, plausible, to_u8
from ..operators import features, illumination, images, points, robust, rules, stencil
from ..sources.shared import Folder
from .config import RegistrationConfig

M9 = robust.M9
#: Inlier threshold in pixels, least correlation of a refined point, search radius, resolution gap that calls for levels, span that calls for a projective model.
THRESHOLD, LEAST_NCC, SEARCH, GAP, FAR = 3.0, 0.7, 3, 1.2, 2000.0
#: A second pass needs so many points.
SECOND_PASS = 10


def _whole(px: DataFrame, method: str) -> DataFrame:
    """Values 0..255 of a normalisation."""
    made = illumination.normalize(px, method).select("image", "y", "x", "v")
    return made if method == "clahe" else made.withColumn("v", to_u8(F.col("v")))


def _at_level(px: DataFrame, picks: DataFrame, level: str, config: RegistrationConfig, folder: Folder, name: str) -> DataFrame:
    """px at each pair's level of its pyramid; picks: (image, s_level, r_level)."""
    deepest = picks.agg(F.max(level)).first()[0] or 0
    at, out = px, px.join(picks.where(F.col(level) == 0).select("image"), "image", "left_semi")
    for k in range(1, deepest + 1):
        deeper = picks.where(F.col(level) >= k).select("image")
        at = at.join(deeper, "image", "left_semi")
        f = config.pyramid_scale_factor
        at = folder.save((stencil.half(at) if f == 0.5 else stencil.shrink(at, f)).withColumn("v", F.floor(F.round("v", 6)).cast("double")), f"{name}{k}")
        out = out.unionByName(at.join(picks.where(F.col(level) == k).select("image"), "image", "left_semi"))
    return out


def matched(a: DataFrame, b: DataFrame, config: RegistrationConfig, folder: Folder, name: str) -> DataFrame:
    """(pair_id, idx, sx, sy, rx, ry, confidence): ratio-test matches of two pixel tables whose images are pairs; stored."""
    both = a.withColumn("image", F.concat(F.lit("s"), "image")).unionByName(b.withColumn("image", F.concat(F.lit("r"), "image")))
    found = folder.save(features.detect(both, config.max_keypoints), f"{name}-keypoints")
    side = lambda s: found.where(F.substring("image", 1, 1) == s).select(F.expr("substring(image, 2)").alias("pair_id"), F.col("kp_idx").alias("idx"), "x", "y", "descriptor")
    s, r = side("s"), side("r")
    hits = points.ratio_match(s.drop("x", "y"), r.drop("x", "y"), config.lowe_ratio)
    place = lambda df, key, to: df.select("pair_id", F.col("idx").alias(key), F.col("x").alias(f"{to}x"), F.col("y").alias(f"{to}y"))
    joined = hits.join(place(s, "source_idx", "s"), ["pair_id", "source_idx"]).join(place(r, "reference_idx", "r"), ["pair_id", "reference_idx"])
    return folder.save(joined.select("pair_id", F.col("source_idx").alias("idx"), "sx", "sy", "rx", "ry", "confidence"), f"{name}-matches")


def one_pass(a: DataFrame, b: DataFrame, scales: DataFrame, raw_a: DataFrame, raw_b: DataFrame, config: RegistrationConfig, folder: Folder, name: str) -> tuple[DataFrame, DataFrame]:
    """(fits (pair_id, model, matches, n, rmse, m), points that they rest on): keypoints of a and b (scales: image, s_scale, r_scale), rejected, refined on raw_a and raw_b, fitted."""
    hits = matched(a, b, config, folder, name).join(scales.withColumnRenamed("image", "pair_id"), "pair_id")
    hits = hits.withColumns({c: F.col(c) / F.col(f"{c[0]}_scale") for c in ("sx", "sy", "rx", "ry")}).drop("s_scale", "r_scale")
    model = points.auto_model(hits, FAR) if config.transform_type is None else hits.select("pair_id").distinct().withColumn("model", F.lit(config.transform_type))
    hits = folder.save(hits.join(model, "pair_id"), f"{name}-scaled")
    kinds = {r["model"] for r in hits.select("model").distinct().collect()}  # two at most
    inliers = None
    for kind in sorted(kinds):
        mine, of = hits.where(F.col("model") == kind), "homography" if kind == "projective" else "affine"
        best = robust.robust_fit(mine, of, config.outlier_method, THRESHOLD, config.ransac_confidence, config.ransac_max_iters)
        if of == "affine":
            best = robust.refined_affine(mine, best, config.outlier_method, THRESHOLD)
        kept = robust.with_models(mine, best).where(robust.residual(of) <= THRESHOLD).drop(*M9)
        inliers = kept if inliers is None else inliers.unionByName(kept)
    if inliers is None:
        inliers = hits
    inliers = folder.save(inliers, f"{name}-inliers")
    if config.refine_subpixel:
        maps = images.ncc_map(raw_a, raw_b, inliers.withColumnRenamed("pair_id", "image"), config.refinement_patch_size, SEARCH)
        better = folder.save(images.refine(maps, LEAST_NCC, SEARCH), f"{name}-refined")
        better = better.select(F.col("image").alias("pair_id"), "idx", "sx", "sy", "rx", "ry", F.col("ncc").alias("confidence")).join(model, "pair_id")
        least = F.when(F.col("model") == "projective", robust.NEED["homography"]).otherwise(robust.NEED["affine"])
        enough = better.groupBy("pair_id", "model").agg(F.count("*").alias("n")).where(F.col("n") >= least).select("pair_id")
        used = better.join(enough, "pair_id", "left_semi").unionByName(inliers.select(better.columns).join(enough, "pair_id", "left_anti"))
        inliers = folder.save(used, f"{name}-points")
    fits = points.affine_fit(inliers.where("model = 'affine'")).withColumns({"m6": F.lit(0.0), "m7": F.lit(0.0), "m8": F.lit(1.0)}).unionByName(robust.homography_fit(inliers.where("model = 'projective'")))
    fits = folder.save(fits.where("m0 IS NOT NULL"), f"{name}-fits")
    left = robust.with_models(inliers, fits)
    squares = left.groupBy("pair_id", "model").agg(F.sqrt(F.avg(F.when(F.col("model") == "projective", robust.residual("homography")).otherwise(robust.residual("affine")) ** 2)).alias("rmse"))
    counts = hits.groupBy("pair_id").agg(F.count("*").alias("matches"))
    out = fits.join(squares, "pair_id").join(counts, "pair_id").select("pair_id", "model", "matches", "n", "rmse", F.array(*M9).alias("m"))
    return folder.save(out, f"{name}-fit"), inliers


def _ok(m: str) -> Column:
    return plausible(*[F.col(m)[k] for k in (0, 1, 3, 4)])


def _second(source: DataFrame, reference: DataFrame, first: DataFrame, sizes: DataFrame, config: RegistrationConfig, folder: Folder) -> tuple[DataFrame, DataFrame]:
    """Fits of a pass at full resolution that are at least as good as the first, and their points: the reference is warped onto the source's grid by the first fit and matched there."""
    back = first.withColumn("inverse", invert3("m")).where("inverse IS NOT NULL").join(sizes.select(F.col("image").alias("pair_id"), "height", "width"), "pair_id")
    seen = images.warp_each(reference.join(back.select(F.col("pair_id").alias("image")), "image", "left_semi"), back.select(F.col("pair_id").alias("image"), F.col("inverse").alias("m"), "height", "width"), "bilinear")
    u8 = lambda px, name: folder.save(illumination.contrast_to_u8(px).select("image", "y", "x", "v"), name)
    a, b = u8(source.join(first.select(F.col("pair_id").alias("image")), "image", "left_semi"), "second-source"), u8(folder.save(seen, "second-warped"), "second-reference")
    same = first.select(F.col("pair_id").alias("image"), F.lit(1.0).alias("s_scale"), F.lit(1.0).alias("r_scale"))
    fit, inliers = one_pass(a, b, same, a, b, config, folder, "second")
    both = fit.withColumnRenamed("m", "step").join(first.select("pair_id", F.col("m").alias("coarse"), F.col("rmse").alias("coarse_rmse"), F.col("n").alias("coarse_n"), F.col("matches").alias("coarse_matches")), "pair_id")
    whole = F.transform("raw", lambda v: v / F.col("raw")[8])
    both = both.withColumn("raw", matmul3("coarse", "step")).withColumn("m", whole).drop("raw")
    # Points of the warped reference back where the reference has them.
    c = [F.col("coarse")[k] for k in range(9)]
    w = c[6] * F.col("rx") + c[7] * F.col("ry") + c[8]
    moved = inliers.join(both.select("pair_id", "coarse", "m"), "pair_id").withColumns({"ux": (c[0] * F.col("rx") + c[1] * F.col("ry") + c[2]) / w, "uy": (c[3] * F.col("rx") + c[4] * F.col("ry") + c[5]) / w})
    moved = moved.withColumns({"rx": F.col("ux"), "ry": F.col("uy"), **{name: F.col("m")[k] for k, name in enumerate(M9)}}).drop("ux", "uy", "coarse", "m")
    errors = moved.groupBy("pair_id").agg(F.sqrt(F.avg(robust.residual("homography") ** 2)).alias("new_rmse"))
    better = (F.col("n") >= SECOND_PASS) & _ok("m") & ((F.col("new_rmse") <= F.col("coarse_rmse") + 1e-6) | ((F.col("coarse_n") < SECOND_PASS) & (F.col("new_rmse") < 1)))
    good = both.join(errors, "pair_id").where(better).select("pair_id", "model", F.greatest("matches", "n").alias("matches"), "n", F.col("new_rmse").alias("rmse"), "m")
    return folder.save(good, "second-good"), folder.save(moved.drop(*M9), "second-moved")


def register_tables(source: DataFrame, reference: DataFrame, pairs: DataFrame, config: RegistrationConfig, folder: Folder | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(results, points, warped) of pairs (pair_id string, s_res, r_res: pixel sizes), whose rasters are pixel tables (image = pair_id, y, x, v).

    results: pair_id, success, m (array of 9, source to reference), n, matches, rmse, ssim, psnr, nmi, q_score, spatial, stage, error. points: those the transform rests on. warped: the source on the reference's grid. A pair without a raster, without enough
    matches or with a transform that isn't plausible has success false, with the stage and the reason; a pair of no overlap has scores of 0. The rows are stored.
    """
    folder = folder or Folder(pairs.sparkSession, "registration")
    if config.detection_method != "sift" or config.matching_method != "bf":
        raise NotImplementedError("tables are matched by keypoints and the ratio test; networks need weights")
    named = lambda px: folder_px(px, pairs)
    source, reference = folder.save(named(source), "source"), folder.save(named(reference), "reference")
    s_size, r_size = (folder.save(stencil.extents(px), f"{n}-size") for n, px in (("source", source), ("reference", reference)))
    picks = rules.level_pick(pairs, config.pyramid_levels or 5, config.pyramid_scale_factor, GAP).withColumnRenamed("pair_id", "image")
    f = F.lit(config.pyramid_scale_factor)
    picks = folder.save(picks.withColumns({"s_scale": F.pow(f, F.col("s_level")), "r_scale": F.pow(f, F.col("r_level"))}), "levels")
    sides = {}
    for name, px, level in (("source", source, "s_level"), ("reference", reference, "r_level")):
        whole = folder.save(_whole(px, config.illumination_method), f"{name}-normalised")
        sides[name] = folder.save(_at_level(whole, picks, level, config, folder, f"{name}-level"), f"{name}-levelled")
    raw = {n: folder.save(illumination.contrast_to_u8(px).select("image", "y", "x", "v"), f"{n}-u8") for n, px in (("source", source), ("reference", reference))}
    fit, used = one_pass(sides["source"], sides["reference"], picks.select("image", "s_scale", "r_scale"), raw["source"], raw["reference"], config, folder, "first")
    sound = folder.save(fit.where(_ok("m")), "sound")
    if config.full_res_refine:
        gap = pairs.where(F.greatest("s_res", "r_res") / (F.least("s_res", "r_res") + 1e-8) > GAP).select("pair_id")
        coarse = folder.save(sound.join(gap, "pair_id", "left_semi"), "coarse")
        if not coarse.isEmpty():
            better, moved = _second(source, reference, coarse, s_size, replace(config, full_res_refine=False), folder)
            sound = folder.save(sound.join(better.select("pair_id"), "pair_id", "left_anti").unionByName(better.select(sound.columns)), "final")
            used = used.join(better.select("pair_id"), "pair_id", "left_anti").unionByName(moved.join(better.select("pair_id"), "pair_id", "left_semi").select(used.columns))
    used = folder.save(used.join(sound.select("pair_id"), "pair_id", "left_semi"), "points")
    models = sound.select(F.col("pair_id").alias("image"), "m").join(r_size, "image")
    warped = folder.save(images.warp_each(source, models, config.interpolation), "warped")
    return _results(pairs, source, reference, warped, fit, sound, used, r_size, folder), used, warped


def folder_px(px: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pixels of these pairs' images, in the types that the stages use."""
    slim = px.select(F.col("image").cast("string").alias("image"), F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x"), F.col("v").cast("double").alias("v"))
    return slim.join(pairs.select(F.col("pair_id").alias("image")).distinct(), "image", "left_semi")


def _results(pairs: DataFrame, source: DataFrame, reference: DataFrame, warped: DataFrame, fit: DataFrame, sound: DataFrame, used: DataFrame, sizes: DataFrame, folder: Folder) -> DataFrame:
    both = folder.save(images.aligned(warped, reference), "aligned")
    ssim, psnr = images.ssim(both), images.psnr(both).select("image", "psnr", "overlap")
    nmi = images.nmi(both.where("a > 0 AND b > 0").select("image", "a", "b"))
    cell = lambda c, n: F.floor(F.col(c) * 8 / F.col(n))
    inside = used.join(sizes.withColumnRenamed("image", "pair_id"), "pair_id").where("rx >= 0 AND ry >= 0 AND rx < width AND ry < height")
    spread = inside.groupBy("pair_id").agg((F.count_distinct(cell("ry", "height") * 8 + cell("rx", "width")) / 64.0).alias("spatial"))
    scores = ssim.join(psnr, "image").join(nmi, "image", "left").withColumnRenamed("image", "pair_id")
    there = lambda px: px.select(F.col("image").alias("pair_id"), F.lit(True).alias("there")).distinct()
    out = pairs.select("pair_id").join(there(source).withColumnRenamed("there", "s"), "pair_id", "left").join(there(reference).withColumnRenamed("there", "r"), "pair_id", "left")
    out = out.join(fit.select("pair_id", F.lit(True).alias("fitted")), "pair_id", "left").join(sound, "pair_id", "left").join(scores, "pair_id", "left").join(spread, "pair_id", "left")
    few = F.col("overlap") < images.LEAST_OVERLAP
    score = {c: F.when(F.col("m").isNotNull(), F.when(few | F.col("overlap").isNull(), 0.0).otherwise(F.coalesce(c, F.lit(0.0)))).alias(c) for c in ("ssim", "psnr", "nmi")}
    ratio = F.when(F.col("matches") > 0, F.col("n") / F.col("matches")).otherwise(0.0)
    q = F.when(F.col("m").isNotNull(), F.when(few | F.col("overlap").isNull(), 0.0).otherwise(points.q_score(F.col("ssim"), F.coalesce("nmi", F.lit(0.0)), F.least(ratio, F.lit(1.0)))))
    stage = F.when(F.col("s").isNull() | F.col("r").isNull(), "load").when(F.col("fitted").isNull(), "match").when(F.col("m").isNull(), "plausibility")
    error = F.when(stage == "load", "no raster").when(stage == "match", "too few points for a transform").when(stage == "plausibility", "the transform is not plausible")
    return folder.save(out.select("pair_id", stage.isNull().alias("success"), "m", "n", "matches", "rmse", *score.values(), q.alias("q_score"), "spatial", stage.alias("stage"), error.alias("error")), "results")
