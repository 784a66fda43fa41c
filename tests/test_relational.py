"""Every query that has SQL gives DuckDB's rows; the others are held against arrays."""

import duckdb
import numpy as np
import pandas as pd
import pytest

from rasterloom.operators import illumination, images, points, rules, stencil
from rasterloom.plans import catalog, registration, scenes, tables

SF = "/root/testdata/sf0.001"
NAMES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in NAMES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


def comparable(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)]

    def text(v):
        if v is None or (isinstance(v, float) and np.isnan(v)) or v is pd.NA:
            return ""
        return str(v) if isinstance(v, (bool, np.bool_, str)) else f"{float(v):.6f}"

    return df.map(text).sort_values(list(df.columns)).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_equals_sql(spark, duck, name):
    ours, theirs = catalog.QUERIES[name](spark, SF).toPandas(), duck.execute(catalog.ORACLE_SQL[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    pd.testing.assert_frame_equal(comparable(ours), comparable(theirs))


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE_SQL)))
def test_query_without_sql_has_rows(spark, name):
    assert catalog.QUERIES[name](spark, SF).count() > 0


def frame(spark, img, image="s"):
    y, x = np.indices(img.shape)
    return spark.createDataFrame(pd.DataFrame({"image": image, "y": y.ravel(), "x": x.ravel(), "v": img.ravel().astype(float)}))


def array(px, shape):
    pdf = px.toPandas()
    out = np.full(shape, np.nan)
    out[pdf["y"], pdf["x"]] = pdf["v"]
    return out


@pytest.fixture(scope="module")
def img():
    return np.random.default_rng(4).integers(0, 256, (40, 52)).astype(float)


def test_tiled_phase_congruency_equals_tiles_by_hand(spark, img):
    got = array(illumination.phase_congruency(frame(spark, img), tile=24, overlap=4), img.shape)
    wanted = registration.phase_congruency_tiled(img.astype(np.float32), 24, 4)
    np.testing.assert_allclose(got, wanted, atol=1e-6)
    whole = array(illumination.phase_congruency(frame(spark, img)), img.shape)
    np.testing.assert_allclose(whole, illumination.phase_congruency_array(img.astype(np.float32)), atol=1e-9)
    assert whole.min() >= 0 and whole.max() <= 1


def test_phase_congruency_mostly_ignores_a_ramp():
    base = scenes.terrain(256)
    ramp = base * np.linspace(0.5, 1.5, 256)[None, :] * np.linspace(0.8, 1.2, 256)[:, None]
    a, b = (illumination.phase_congruency_array(x) for x in (base, ramp))
    assert np.corrcoef(a.ravel(), b.ravel())[0, 1] > 0.75


def test_clahe_equals_arrays(spark, img):
    # Sums in another order may round the other way.
    off = np.abs(array(illumination.clahe(frame(spark, img)), img.shape) - registration.clahe(img))
    assert off.max() <= 1 and (off > 0).mean() < 0.01
    flat = array(illumination.clahe(frame(spark, np.full((16, 16), 7.0))), (16, 16))
    assert len(np.unique(flat)) == 1


@pytest.mark.parametrize("method", ["nearest", "bilinear", "bicubic", "lanczos"])
def test_warp_equals_arrays(spark, img, method):
    m = np.array([[1.02, 0.05, 2.5], [-0.04, 0.97, 3.2], [1e-4, 0, 1]])
    got = array(images.warp(frame(spark, img), m.ravel(), 30, 45, method, 9.0), (30, 45))
    np.testing.assert_allclose(got, registration.warp(img, m, (30, 45), method, 9.0), atol=1e-6)
    same = array(images.warp(frame(spark, img), np.eye(3).ravel(), *img.shape, method), img.shape)
    np.testing.assert_allclose(same, img, atol=1e-9)


def test_scores_of_equal_images(spark, img):
    both = images.aligned(frame(spark, img + 1), frame(spark, img + 1))
    assert images.ssim(both).first().ssim == pytest.approx(1)
    assert images.psnr(both).first().psnr == np.inf
    assert images.nmi(both).first().nmi == pytest.approx(1, abs=1e-9)
    few = images.aligned(frame(spark, np.ones((5, 5))), frame(spark, np.ones((5, 5))))
    assert images.psnr(few).first().psnr == 0


def test_scores_equal_arrays(spark, img):
    other = np.roll(img, 1, 0)
    both = images.aligned(frame(spark, img), frame(spark, other))
    wanted = registration.assess(img, other, 3, 4, 0.5)
    assert images.ssim(both).first().ssim == pytest.approx(wanted["ssim"], abs=1e-9)
    assert images.psnr(both).first().psnr == pytest.approx(wanted["psnr"])
    seen = both.where("a > 0 and b > 0")
    assert images.nmi(seen).first().nmi == pytest.approx(wanted["mutual_information"], abs=1e-9)


def test_blend_rules(spark):
    a, b = frame(spark, np.array([[0, 2.0], [4, 0]])), frame(spark, np.array([[3, 4.0], [0, 0]]))
    for mode, wanted in (("overlay", [[3, 2], [4, 0]]), ("average", [[3, 3], [4, 0]]), ("difference", [[0, 2], [0, 0]])):
        np.testing.assert_array_equal(array(images.blend(a, b, mode), (2, 2)), wanted)
    with pytest.raises(ValueError):
        images.blend(a, b, "sum")
    with pytest.raises(Exception, match="different shapes"):
        images.blend(a, frame(spark, np.ones((3, 2))), "overlay").collect()


def test_pyramid_sizes(spark, img):
    levels = stencil.pyramid(frame(spark, img), 4).groupBy("level").agg({"y": "max", "x": "max"}).collect()
    assert {(r.level, r["max(y)"] + 1, r["max(x)"] + 1) for r in levels} == {(0, 40, 52), (1, 20, 26), (2, 10, 13), (3, 5, 6)}


def test_pyramid_of_another_factor_equals_arrays(spark, img):
    from rasterloom.plans.registration import pyramid

    got = stencil.pyramid(frame(spark, img), 3, 0.6)
    wanted, scales = pyramid(np.asarray(img, float), 3, 0.6)
    for k, level in enumerate(wanted):
        mine = got.where(f"level = {k}")
        assert mine.first().scale == scales[k] and mine.count() == level.size
        # A sum that is whole but for rounding may be cut to either side.
        values = array(mine, level.shape)
        assert np.abs(values - level).max() <= 1 and (values == level).mean() > 0.99


def test_warp_of_any_footprint(spark):
    """Tiles whose source is outside, denser, or behind the horizon of a projective matrix."""
    big = np.random.default_rng(4).integers(0, 255, (300, 520)).astype(float)
    for m in ([0.3, 0.02, -20.0, -0.01, 0.25, 9.0, 0.0, 0.0, 1.0], [1.0, 0.1, 400.0, 0.0, 1.0, -90.0, 0.0, 0.0, 1.0], [0.9, 0.1, 5.0, 0.05, 1.1, -3.0, 0.002, 0.001, 1.0]):
        got = array(images.warp(frame(spark, big), m, 290, 300, "bicubic", 3.0), (290, 300))
        np.testing.assert_allclose(got, registration.warp(big, np.array(m).reshape(3, 3), (290, 300), "bicubic", 3.0), atol=1e-6)


def test_robust_fits(spark):
    rng = np.random.default_rng(3)
    src = rng.uniform(0, 500, (200, 2))
    truths = {"affine": np.array([[0.9, 0.2, 5], [-0.1, 1.1, -3], [0, 0, 1]]), "homography": np.array([[1, 0.02, 5], [-0.01, 1.05, -3], [1e-4, -5e-5, 1]])}
    for model, m in truths.items():
        p = np.column_stack([src, np.ones(200)]) @ m.T
        dst = p[:, :2] / p[:, 2:]
        bad = rng.random(200) < 0.3
        dst[bad] += rng.uniform(20, 80, (bad.sum(), 2))
        for method in ("ransac", "magsac++", "lmeds"):
            mask, found = points.reject_array(src, dst, model, method)
            assert (mask == ~bad).mean() > 0.99
            np.testing.assert_allclose(found / found[2, 2], m, atol=1e-2)
        rows = [("p", k, *map(float, (*s, *d))) for k, (s, d) in enumerate(zip(src, dst))]
        got = points.reject(spark.createDataFrame(rows, "pair_id string, idx long, sx double, sy double, rx double, ry double"), model)
        assert {r.idx for r in got.where("inlier").collect()} == set(np.flatnonzero(~bad).tolist())
    for model, least in (("affine", 3), ("homography", 4), ("fundamental", 8)):
        mask, m = points.reject_array(src[: least - 1], src[: least - 1], model)
        assert m is None and not mask.any()


def test_fundamental():
    rng = np.random.default_rng(8)
    world = np.column_stack([rng.uniform(-1, 1, (80, 2)), rng.uniform(4, 8, 80)])
    a = 400 * world[:, :2] / world[:, 2:] + 250
    c, s = np.cos(0.1), np.sin(0.1)
    moved = world @ np.array([[c, 0, s], [0, 1, 0], [-s, 0, c]]).T + [0.5, 0.1, 0]
    b = 400 * moved[:, :2] / moved[:, 2:] + 250
    bad = np.arange(80) % 5 == 0
    b[bad] += rng.uniform(30, 90, (bad.sum(), 2))
    mask, _ = points.reject_array(a, b, "fundamental")
    assert mask[~bad].all() and mask[bad].mean() < 0.2


def test_matching_corners(spark):
    side = lambda rows: spark.createDataFrame([("p", k, v) for k, v in rows], "pair_id string, idx long, descriptor array<double>")
    a = side([(0, [0.0, 0.0]), (1, [1.0, 0.0])])
    assert points.ratio_match(a, side([])).count() == 0 and points.ratio_match(side([]), a).count() == 0
    twice = side([(0, [0.0, 0.0]), (1, [0.0, 0.0])])
    assert [r.source_idx for r in points.ratio_match(a, twice).collect()] == []
    one = {r.source_idx: r.confidence for r in points.ratio_match(a, side([(7, [0.0, 0.0])])).collect()}
    assert one == {0: 1.0, 1: 0.5}
    rng = np.random.default_rng(1)
    x, y = rng.normal(size=(90, 6)), rng.normal(size=(70, 6))
    got = {(r.source_idx, r.reference_idx) for r in points.ratio_match(side([(k, v.tolist()) for k, v in enumerate(x)]), side([(k, v.tolist()) for k, v in enumerate(y)]), 0.9, blocks=3).collect()}
    i, j, _ = registration.match(x, y, 0.9)
    assert got == set(zip(i.tolist(), j.tolist()))


def test_uniformity_of_an_even_grid(spark):
    rows = [("s", i * 8 + j, 12.5 * j + 6, 12.5 * i + 6) for i in range(8) for j in range(8)]
    even = spark.createDataFrame(rows, "image string, idx long, x double, y double")
    assert points.uniformity(even, 100, 100).first().uniformity == pytest.approx(1)
    assert points.occupancy(even, 100, 100).first().occupancy == 1


def test_raster_table_is_whole(spark):
    assert tables.raster(spark, SF).count() == 64 * spark.read.parquet(f"{SF}/embeddings.parquet").count()


def test_pyramid_levels_shuffle_nothing(spark):
    pairs = spark.range(1, 200).selectExpr("id AS pair_id", "cast(id AS double) AS s_res", "200.0D / id AS r_res")
    for found in (rules.level_pairs(pairs), rules.level_pick(pairs)):
        assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()


def test_sources_are_not_copied_for_a_single_reference(spark, monkeypatch):
    """Each side is cut by its own rows: many sources meet one reference in as many tasks as they have blocks."""
    monkeypatch.setattr(points, "SIDE", 10)
    d = spark.range(101).selectExpr("'p' AS pair_id", "id AS idx", "array(cast(id AS double), 1.0D) AS descriptor")
    found = points.ratio_match(d.where("idx > 0"), d.where("idx = 0"))
    plan = spark.sparkContext._jvm.PythonSQLUtils.explainString(found._jdf.queryExecution(), "simple")
    assert "of_a" in plan and "of_b" in plan
    assert {(r.source_idx, r.reference_idx, round(r.distance, 9)) for r in found.collect()} == {(k, 0, float(k)) for k in range(1, 101)}


def test_top_peaks_keep_few_before_an_image_meets_in_a_task(spark):
    """The rows are those of a plain sort, also among ties, negative values and values that aren't numbers; the limit holds before the shuffle."""
    rng = np.random.default_rng(3)
    values = [float("nan"), float("inf"), -float("inf"), None, -3.5, 0.0, 2.0, 2.0, 255.0, 1e300, -1e300, 0.3, 0.3001]
    rows = [(None if k % 3 == 2 else f"i{k % 3}", int(k // 40), int(k % 40), values[rng.integers(len(values))] if k % 2 else float(np.round(rng.normal(0, 50)))) for k in range(3000)]
    px = spark.createDataFrame(rows, "image string, y long, x long, v double").repartition(5)
    for most in (1, 7, 100, 2000):
        got = {(r.image, r.kp_idx): (r.y, r.x) for r in stencil.top_peaks(px, most).collect()}
        wanted = {}
        for image in ("i0", "i1", None):
            own = [r for r in rows if r[0] == image]
            key = lambda r: (r[3] is None, not (r[3] is not None and np.isnan(r[3])), 0 if r[3] is None or np.isnan(r[3]) else -r[3], r[1], r[2])
            wanted |= {(image, k): (r[1], r[2]) for k, r in enumerate(sorted(own, key=key)[:most])}
        assert got == wanted, most
    assert "WindowGroupLimit" in stencil.top_peaks(px, 7)._jdf.queryExecution().executedPlan().toString()
