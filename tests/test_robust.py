"""Robust fits as tables against per-pair arrays, and fits from moments against singular vectors."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterloom.operators import points, robust
from rasterloom.sources.shared import Folder

COLUMNS = "pair_id long, idx long, sx double, sy double, rx double, ry double"
AFFINE = np.array([[0.9, 0.2, 5], [-0.1, 1.1, -3], [0, 0, 1]])
HOMOGRAPHY = np.array([[1, 0.02, 5], [-0.01, 1.05, -3], [1e-4, -5e-5, 1]])


def made(seed, pairs, n, outliers, noise, matrix=AFFINE):
    """(rows, mask of good ones) of each pair."""
    rng = np.random.default_rng(seed)
    rows, good = [], {}
    for p in range(pairs):
        src = rng.uniform(0, 1000, (n, 2))
        to = np.column_stack([src, np.ones(n)]) @ matrix.T
        dst = to[:, :2] / to[:, 2:] + rng.normal(0, noise, (n, 2))
        bad = rng.random(n) < outliers
        dst[bad] += rng.uniform(30, 300, (bad.sum(), 2)) * rng.choice([-1, 1], (bad.sum(), 2))
        rows += [(p, k, *map(float, (*src[k], *dst[k]))) for k in range(n)]
        good[p] = ~bad
    return rows, good


def model(r):
    return np.array([r[c] for c in robust.M9]).reshape(3, 3)


def error(m, truth=AFFINE):
    grid = np.array([[x, y, 1] for x in (100, 500, 900) for y in (100, 500, 900)])
    a, b = grid @ m.T, grid @ truth.T
    return np.hypot(*(a[:, :2] / a[:, 2:] - b[:, :2] / b[:, 2:]).T).mean()


def test_no_pair_is_lost_among_many_outliers(spark):
    """Every pair for which the search on arrays finds a model has one here, of as many inliers but for chance."""
    rows, good = made(1, 120, 100, 0.6, 0.5)
    df = spark.createDataFrame(rows, COLUMNS).repartition(4)
    found = {r.pair_id: r for r in robust.robust_fit(df).collect()}
    assert max(r.tries for r in found.values()) > robust_first() and len(found) == 120
    for p in range(120):
        part = np.array([r[2:] for r in rows[100 * p: 100 * p + 100]])
        mask, m = points.reject_array(part[:, :2], part[:, 2:])
        if m is not None and mask.sum() >= 0.8 * good[p].sum():
            assert found[p].inliers >= 0.7 * good[p].sum(), p
    refined = {r.pair_id: model(r) for r in robust.refined_affine(df, robust.robust_fit(df)).collect()}
    assert np.median([error(m) for m in refined.values()]) < 0.3
    assert max(error(m) for m in refined.values()) < 2


def robust_first():
    return 64


def test_homographies(spark):
    rows, good = made(2, 12, 120, 0.35, 0.2, HOMOGRAPHY)
    df = spark.createDataFrame(rows, COLUMNS)
    best = robust.robust_fit(df, "homography")
    found = {r.pair_id: r for r in best.collect()}
    assert all(found[p].inliers > 0.85 * good[p].sum() for p in good)
    for r in robust.refined_homography(df, best).collect():
        assert error(model(r), HOMOGRAPHY) < 0.2
        inside = np.array([x[2:] for x in rows[120 * r.pair_id: 120 * r.pair_id + 120]])
        d = points.distances("homography", model(found[r.pair_id]), inside[:, :2], inside[:, 2:])
        assert r.n == found[r.pair_id].inliers == (d <= 3).sum()


@pytest.mark.parametrize("noise", [0.5, 1.0, 2.0, 3.0])
def test_marginal_scores_beat_counts(spark, noise):
    """At every noise level the median error of magsac++ is below that of the best counted hypothesis refitted on its inliers."""
    df = spark.createDataFrame(made(3, 60, 100, 0.3, noise)[0], COLUMNS).repartition(4)
    errors = {m: np.median([error(model(r)) for r in robust.refined_affine(df, robust.robust_fit(df, method=m), m).collect()]) for m in ("ransac", "magsac++")}
    assert errors["magsac++"] < errors["ransac"] * 1.005
    if noise > 1:
        assert errors["magsac++"] < 0.9 * errors["ransac"]


def test_robust_fundamental(spark):
    """Two views of a scene with depth, three of ten matches wrong: the inliers are the true ones, and points of the same epipolar lines."""
    rng = np.random.default_rng(9)
    rows, good = [], {}
    for p in range(3):
        world = np.column_stack([rng.uniform(-1, 1, (120, 2)), rng.uniform(4, 8, 120)])
        c, s = np.cos(0.15), np.sin(0.15)
        moved = world @ np.array([[c, 0, s], [0, 1, 0], [-s, 0, c]]).T + [0.6, 0.2, 0]
        a, b = (400 * w[:, :2] / w[:, 2:] + 250 for w in (world, moved))
        good[p] = rng.random(120) > 0.3
        b[~good[p]] += rng.uniform(30, 90, ((~good[p]).sum(), 2))
        rows += [(p, k, *map(float, (*a[k], *b[k]))) for k in range(120)]
    df = spark.createDataFrame(rows, COLUMNS).repartition(3)
    best = robust.robust_fit(df, "fundamental", threshold=1.0)
    inside = robust.with_models(df, best).withColumn("d", robust.residual("fundamental")).where("d <= 1").collect()
    for r in best.collect():
        found = {x.idx for x in inside if x.pair_id == r.pair_id}
        # A wrong match may lie on its line by chance.
        assert r.inliers == len(found) >= good[r.pair_id].sum() and len(set(np.flatnonzero(good[r.pair_id])) - found) <= 4 and len(found) < good[r.pair_id].sum() + 12
        part = np.array([x[2:] for x in rows[120 * r.pair_id: 120 * r.pair_id + 120]])
        d = points.distances("fundamental", model(r), part[:, :2], part[:, 2:])
        assert set(np.flatnonzero(d <= 1)) == found


def test_least_median(spark):
    df = spark.createDataFrame(made(4, 20, 80, 0.3, 0.3)[0], COLUMNS)
    for r in robust.robust_fit(df, method="lmeds").collect():
        assert r.tries == 64 and -r.score < 1.5 and error(model(r)) < 5


def test_edges(spark):
    """Few, collinear, repeated and null matches; one pair far larger than the others; equal scores."""
    line = [(1, k, float(k), 2.0 * k, float(k), 2.0 * k) for k in range(20)]
    same = [(2, 7, 5.0, 5.0, 6.0, 6.0)] * 30
    few = [(3, k, float(k * k), float(k), 1.0, 2.0) for k in range(2)]
    nulls = [(4, k, None, 1.0, 1.0, 1.0) for k in range(5)]
    exact = [(5, k, *p, *(2 * np.array(p) + 1).tolist()) for k, p in enumerate([(0.0, 0.0), (10.0, 0.0), (0.0, 10.0), (10.0, 10.0), (3.0, 4.0)])]
    big = [(6, k, *r[2:]) for k, r in enumerate(made(6, 1, 4000, 0.2, 0.1)[0])]
    df = spark.createDataFrame(line + same + few + nulls + exact + big, COLUMNS).repartition(4)
    for name in ("affine", "homography"):
        found = {r.pair_id: r for r in robust.robust_fit(df, name, most=300).collect()}
        assert sorted(found) == [1, 2, 3, 4, 5, 6]
        assert [found[p].h for p in (1, 2, 3, 4)] == [None] * 4 and found[3].tries == found[4].tries == 0 and found[4].n == 0
        assert (found[1].tries, found[2].tries) == (300, 300)
        assert found[5].inliers == 5 and found[5].tries == 16
        assert found[6].inliers > 3000
    first = robust.robust_fit(df.where("pair_id = 5")).first()
    assert first.h == min(r.h for r in robust.hypotheses(robust.ordinals(df.where("pair_id = 5"), Folder(spark, "test")), spark.createDataFrame([(5, 5)], "pair_id long, n long"), 0, 16, "affine").collect())
    assert robust.robust_fit(df.limit(0)).count() == 0


def test_ordinals_and_draws(spark):
    rows = [(p, k // 2, float(k), 0.0, 0.0, 0.0) for p, n in ((1, 500), (2, 3), (9, 1)) for k in range(n)]
    got = robust.ordinals(spark.createDataFrame(rows[::-1], COLUMNS).repartition(5), Folder(spark, "test")).orderBy("pair_id", "k").collect()
    assert [(r.pair_id, r.k, r.sx) for r in got] == [(p, k, float(k)) for p, n in ((1, 500), (2, 3), (9, 1)) for k in range(n)]
    for need, n in ((3, 3), (3, 7), (4, 4), (4, 100), (8, 30)):
        drawn = [r.k for r in spark.range(200).select(robust.drawn(F.col("id"), F.lit(n), need).alias("k")).collect()]
        assert all(len(set(r)) == need and min(r) >= 0 and max(r) < n for r in drawn)
        assert len({frozenset(r) for r in drawn}) == 1 if n == need else len({frozenset(r) for r in drawn}) > 10


def test_incomplete_gamma(spark):
    got = spark.range(400).select((F.col("id") / 20.0).alias("x")).withColumn("g", robust.upper_gamma(F.col("x"))).collect()
    for r in got:
        assert r.g == pytest.approx(0.5 * math.sqrt(math.pi) * math.erfc(math.sqrt(r.x)) + math.sqrt(r.x) * math.exp(-r.x), abs=3e-7)
    rows = spark.range(300).select((F.col("id") / 25.0).alias("r")).withColumns({"w": robust.marginal_weight(F.col("r"), 2.0), "g": robust.marginal_gain(F.col("r"), 2.0)}).collect()
    w, g = np.array([r.w for r in rows]), np.array([r.g for r in rows])
    assert w[0] == pytest.approx(1, abs=1e-6) and g[0] == pytest.approx(1, abs=1e-6) and (np.diff(w) <= 1e-7).all() and (np.diff(g) <= 1e-7).all() and w[-1] == g[-1] == 0
    # The loss grows by the weighted residual.
    r = np.array([x.r for x in rows])
    loss = np.concatenate([[0], np.cumsum((w * r)[1:] + (w * r)[:-1]) * 0.5 * 0.04])
    np.testing.assert_allclose(1 - g, loss / loss[-1], atol=2e-3)


def normal_by_rms(p):
    c = p.mean(0)
    s = math.sqrt(2 / ((p - c) ** 2).sum(1).mean())
    return (p - c) * s, np.array([[s, 0, -s * c[0]], [0, s, -s * c[1]], [0, 0, 1]])


def test_homography_from_moments(spark):
    rows = made(7, 6, 60, 0.0, 0.7, HOMOGRAPHY)[0] + [(50, k, float(k), 1.0, 2.0, 3.0) for k in range(3)]
    for r in robust.homography_fit(spark.createDataFrame(rows, COLUMNS).repartition(3)).collect():
        if r.pair_id == 50:
            assert r.n == 3 and r.m0 is None
            continue
        part = np.array([x[2:] for x in rows[60 * r.pair_id: 60 * r.pair_id + 60]])
        (a, ta), (b, tb) = normal_by_rms(part[:, :2]), normal_by_rms(part[:, 2:])
        h, zero = np.column_stack([a, np.ones(60)]), np.zeros((60, 3))
        whole = np.vstack([np.hstack([h, zero, -b[:, :1] * h]), np.hstack([zero, h, -b[:, 1:] * h])])
        m = np.linalg.inv(tb) @ np.linalg.svd(whole)[2][-1].reshape(3, 3) @ ta
        np.testing.assert_allclose(model(r), m / m[2, 2], atol=1e-7)


def test_fundamental_from_moments(spark):
    rng = np.random.default_rng(8)
    rows, wanted = [], {}
    for p in range(4):
        world = np.column_stack([rng.uniform(-1, 1, (50, 2)), rng.uniform(4, 8, 50)])
        c, s = np.cos(0.1 + p / 20), np.sin(0.1 + p / 20)
        moved = world @ np.array([[c, 0, s], [0, 1, 0], [-s, 0, c]]).T + [0.5, 0.1, 0]
        src, dst = (400 * w[:, :2] / w[:, 2:] + 250 + rng.normal(0, 0.1, (50, 2)) for w in (world, moved))
        rows += [(p, k, *map(float, (*src[k], *dst[k]))) for k in range(50)]
        (a, ta), (b, tb) = normal_by_rms(src), normal_by_rms(dst)
        a, b = (np.column_stack([x, np.ones(50)]) for x in (a, b))
        u, d, v = np.linalg.svd(np.linalg.svd(np.einsum("ni,nj->nij", b, a).reshape(50, 9))[2][-1].reshape(3, 3))
        f = (tb.T @ (u @ np.diag([d[0], d[1], 0]) @ v) @ ta).ravel()
        wanted[p] = f / np.linalg.norm(f) * np.sign(f[np.abs(f).argmax()])
    rows += [(9, k, float(k), 1.0, 2.0, 3.0) for k in range(7)]
    got = {r.pair_id: r for r in robust.fundamental_fit(spark.createDataFrame(rows, COLUMNS)).collect()}
    assert got.pop(9).m0 is None
    for p, r in got.items():
        np.testing.assert_allclose(model(r).ravel(), wanted[p], atol=1e-9)
        assert abs(np.linalg.det(model(r))) < 1e-12


def test_draws_are_not_sent_through_the_driver(spark):
    """Spark takes draws for as small as the pairs that they come from, so no exchange to all executors may hold them."""
    rows, _ = made(3, 3, 30, 0.2, 0.5)
    folder = Folder(spark, "test")
    pairs = folder.save(spark.range(3).selectExpr("id AS pair_id", "30L AS n"), "pairs")
    numbered = robust.ordinals(spark.createDataFrame(rows, COLUMNS), folder)
    inside = None
    for line in robust.hypotheses(numbered, pairs, 0, 64, "affine")._jdf.queryExecution().executedPlan().toString().split("\n"):
        depth = len(line) - len(line.lstrip(" :+-*"))
        inside = None if inside is not None and depth <= inside else inside
        assert inside is None or "Generate" not in line
        inside = depth if inside is None and "BroadcastExchange" in line else inside


def test_blocks_number_the_matches_of_large_pairs(spark):
    df = spark.range(5000).selectExpr("if(id % 5 = 0, 'a', 'b') AS pair_id", "5000 - id AS idx", *[f"cast(id AS double) AS {c}" for c in ("sx", "sy", "rx", "ry")])
    folder = Folder(spark, "test")
    found = robust.blocks(df.repartition(7), folder)
    assert found.selectExpr("max(size(sx))").first()[0] <= robust.BLOCK
    for pair, ids in (("a", range(4995, -1, -5)), ("b", [k for k in range(4999, -1, -1) if k % 5])):
        rows = sorted(found.where(F.col("pair_id") == pair).collect(), key=lambda r: r.lo)
        assert [x for r in rows for x in r.sx] == list(map(float, ids))
        assert [r.lo for r in rows] == np.cumsum([0, *[len(r.sx) for r in rows[:-1]]]).tolist()


def test_medians_of_pairs_of_many_blocks_and_what_is_gathered_for_them(spark, tmp_path, monkeypatch):
    """Medians of odd and even counts, with equal residuals, in one block or in many, are those of all residuals; what is gathered is a small part of them."""
    monkeypatch.setattr(robust, "BLOCK", 256)
    rng = np.random.default_rng(5)
    rows = []
    for p, n in enumerate((3, 4, 101, 256, 257, 4000, 9001)):
        src = rng.uniform(0, 1000, (n, 2))
        dst = np.rint(src + rng.normal(0, 20, (n, 2)))  # idx sorts residuals, so that blocks differ
        order = np.argsort(np.hypot(*(dst - src).T)) if p % 2 else np.arange(n)
        rows += [(p, k, *map(float, (*src[i], *dst[i]))) for k, i in enumerate(order)]
        rows[-1] = (*rows[-1][:2], *([1.0] * 4))
    df = spark.createDataFrame(rows, COLUMNS).repartition(3)
    found = {r.pair_id: r for r in robust.robust_fit(df, method="lmeds").collect()}
    folder = Folder(spark, "test")
    numbered = robust.blocks(df, folder)
    pairs = df.groupBy("pair_id").agg(F.count("*").alias("n"))
    drawn = folder.save(robust.hypotheses(numbered, pairs, 0, 64, "affine"), "drawn")
    scores = robust.scored_by_median(numbered, drawn, pairs, True, "affine", 3.0).collect()
    each = {(r.pair_id, r.h): (r.score, r.inliers) for r in scores}
    assert len(each) == len(scores) == drawn.count()
    for r in drawn.collect():
        x, y = (np.array([q[k] for q in rows if q[0] == r.pair_id]) for k in (slice(2, 4), slice(4, 6)))
        off = np.hypot(*(x @ np.array([[r.m0, r.m3], [r.m1, r.m4]]) + [r.m2, r.m5] - y).T)
        assert each[r.pair_id, r.h][0] == pytest.approx(-np.median(off), abs=2e-9)
        assert abs(each[r.pair_id, r.h][1] - (off <= 3).sum()) <= 1
    for p, r in found.items():
        assert r.score == max(s for (q, _), (s, _) in each.items() if q == p)
        assert r.h == min(h for (q, h), (s, _) in each.items() if q == p and s == r.score)
    # No residual is shuffled to be put in order but those near the median.
    plan = robust.scored_by_median(numbered, drawn, pairs, True, "affine", 3.0)._jdf.queryExecution().executedPlan().toString()
    assert "percentile" not in plan and "median(" not in plan
