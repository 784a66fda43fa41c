"""Queries of robust fits and of fits from moments. Their SQL draws the same hypotheses round by round, and finds eigenvectors by Jacobi rotations."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.scalars import r6
from ..operators import points, robust
from . import tables as t
from .registry import query

R6 = t.sql_r6
M6, M9 = robust.M9[:6], robust.M9
THRESHOLD, CONFIDENCE, MOST, FIRST, GROWTH = 3.0, 0.999, 10_000, 16, 4


# SQL


def _num(v: float) -> str:
    return f"({v!r}::DOUBLE)"


def _residual(model: str) -> str:
    down = " / (m6 * sx + m7 * sy + m8 + 1e-8::DOUBLE)" if model == "homography" else ""
    x, y = f"((m0 * sx + m1 * sy + m2){down} - rx)", f"((m3 * sx + m4 * sy + m5){down} - ry)"
    return f"sqrt({x} * {x} + {y} * {y})"


def _upper_gamma(x: str) -> str:
    series = "0.0::DOUBLE"
    step = f"(1 / (1 + {_num(robust.ERFC_P)} * sqrt({x})))"
    for a in reversed(robust.ERFC_A):
        series = f"(({series} + {_num(a)}) * {step})"
    return f"(({_num(0.5 * math.sqrt(math.pi))} * {series} + sqrt({x})) * exp(-({x})))"


_END = _num(robust.REACH**2 / 2)


def _weight(r: str, sigma: float) -> str:
    x = f"({r} * {r} / {_num(2 * sigma * sigma)})"
    return f"CASE WHEN {r} < {_num(robust.REACH * sigma)} THEN greatest(({_upper_gamma(x)} - {_upper_gamma(_END)}) / ({_num(0.5 * math.sqrt(math.pi))} - {_upper_gamma(_END)}), 0) ELSE 0 END"


def _gain(r: str, sigma: float) -> str:
    loss = lambda x: f"(({_num(0.75 * math.sqrt(math.pi))} - 1.5::DOUBLE * {_upper_gamma(x)} - {x} * sqrt({x}) * exp(-{x})) + {x} * ({_upper_gamma(x)} - {_upper_gamma(_END)}))"
    return f"CASE WHEN {r} < {_num(robust.REACH * sigma)} THEN 1 - {loss(f'({r} * {r} / {_num(2 * sigma * sigma)})')} / {loss(_END)} ELSE 0 END"


def _area(p: str, i: int, j: int, k: int) -> str:
    return f"(({p}x{j} - {p}x{i}) * ({p}y{k} - {p}y{i}) - ({p}x{k} - {p}x{i}) * ({p}y{j} - {p}y{i}))"


def _through(model: str, source: str, into: str) -> str:
    """CTEs from samples to models."""
    if model == "affine":
        det = _area("s", 0, 1, 2)
        lin = ", ".join(f"(({to}1 - {to}0) * (sy2 - sy0) - ({to}2 - {to}0) * (sy1 - sy0)) / {det} AS m{3 * k}, (({to}2 - {to}0) * (sx1 - sx0) - ({to}1 - {to}0) * (sx2 - sx0)) / {det} AS m{3 * k + 1}" for k, to in enumerate(("rx", "ry")))
        return f"""{into}l AS (SELECT *, {lin} FROM {source} WHERE abs({det}) > 1e-9),
{into} AS MATERIALIZED (SELECT pair_id, h, m0, m1, rx0 - m0 * sx0 - m1 * sy0 AS m2, m3, m4, ry0 - m3 * sx0 - m4 * sy0 AS m5, 0.0::DOUBLE AS m6, 0.0::DOUBLE AS m7, 1.0::DOUBLE AS m8 FROM {into}l)"""
    weights = {f"{p}w{i}": _area(p, *[3 if k == i else k for k in range(3)]) for p in "sr" for i in range(3)} | {f"{p}w3": _area(p, 0, 1, 2) for p in "sr"}
    sums = ["0.0::DOUBLE"] * 9
    for i in range(3):
        a, b = (i + 1) % 3, (i + 2) % 3
        cross = (f"(sy{a} - sy{b})", f"(sx{b} - sx{a})", f"(sx{a} * sy{b} - sy{a} * sx{b})")
        for r, to in enumerate((f"rx{i}", f"ry{i}", "1.0::DOUBLE")):
            for c in range(3):
                sums[3 * r + c] += f" + rw{i} / sw{i} * {to} * {cross[c]}"
    return f"""{into}w AS (SELECT *, {', '.join(f'{v} AS {k}' for k, v in weights.items())} FROM {source}),
{into}g AS (SELECT pair_id, h, {', '.join(f'{v} AS g{k}' for k, v in enumerate(sums))} FROM {into}w WHERE {' AND '.join(f'abs({w}) > 1e-6' for w in weights)}),
{into} AS MATERIALIZED (SELECT pair_id, h, {', '.join(f'g{k} / g8 AS m{k}' for k in range(9))} FROM {into}g WHERE abs(g8) > 1e-12)"""


def sql_robust(ties: str, model: str = "affine", method: str = "ransac") -> str:
    """CTEs that end in be (pair_id, n, tries, h, score, inliers, m0..m8)."""
    need, res = robust.NEED[model], _residual(model)
    score = {"ransac": f"CAST(count(*) FILTER ({res} <= 3) AS DOUBLE)", "lmeds": f"-round(median({res}), 9)", "magsac++": f"round(sum({_gain('r', THRESHOLD)}), 6)"}[method]
    share = "0.5::DOUBLE" if method == "lmeds" else "least(greatest(coalesce(inliers / n::DOUBLE, 0), 1e-6), 1 - 1e-9::DOUBLE)"
    enough = f"tries >= ceil({_num(math.log(1 - CONFIDENCE))} / ln(least(1 - {' * '.join([share] * need)}, 1 - 1e-15::DOUBLE)))"
    ms = ", ".join(M9)
    out = [
        ties, f"rk AS MATERIALIZED (SELECT pair_id, sx, sy, rx, ry, pair_id * 1000000000 + row_number() OVER (PARTITION BY pair_id ORDER BY idx, sx, sy, rx, ry) - 1 AS place FROM {ties.split(' ')[0]})",
        f"s0 AS MATERIALIZED (SELECT pair_id, count(*) AS n, 0 AS tries, CAST(NULL AS DOUBLE) AS score, CAST(NULL AS BIGINT) AS h, CAST(NULL AS BIGINT) AS inliers, {', '.join(f'CAST(NULL AS DOUBLE) AS {m}' for m in M9)}, count(*) < {need} AS sure FROM rk GROUP BY 1)",
    ]
    low, high, k = 0, FIRST, 0
    while low < MOST:
        digits = ", ".join(f"('0x' || substr(md5(h || '-{c}'), 1, 8))::BIGINT % (n - {c}) AS r{c}" for c in range(need))
        out.append(f"d{k}_0 AS (SELECT pair_id, h, {digits} FROM (SELECT pair_id, n FROM s{k} WHERE NOT sure) p, (SELECT unnest(range({low}, {high})) AS h) q)")
        for c in range(need):  # the number among those that are left
            value = f"r{c}"
            for i in range(c):
                value = f"({value} + CAST({value} >= list_sort([{', '.join(f'k{j}' for j in range(c))}])[{i + 1}] AS BIGINT))"
            out.append(f"d{k}_{c + 1} AS (SELECT *, {value} AS k{c} FROM d{k}_{c})")
        joined = " ".join(f"JOIN rk p{c} ON p{c}.place = d.pair_id * 1000000000 + d.k{c}" for c in range(need))
        out.append(f"t{k} AS (SELECT d.pair_id, h, {', '.join(f'p{c}.{v} AS {v}{c}' for c in range(need) for v in ('sx', 'sy', 'rx', 'ry'))} FROM d{k}_{need} d {joined})")
        out.append(_through(model, f"t{k}", f"h{k}"))
        each = f"(SELECT rk.pair_id, h, {ms}, sx, sy, rx, ry, {res} AS r FROM rk JOIN h{k} USING (pair_id)) e"
        out.append(f"c{k} AS (SELECT pair_id, h, {ms}, {score} AS score, count(*) FILTER ({res} <= 3) AS inliers FROM {each} GROUP BY ALL)")
        out.append(f"b{k} AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY pair_id ORDER BY score DESC, h) AS place FROM c{k}) z WHERE place = 1)")
        new = "(b.score IS NOT NULL AND (s.score IS NULL OR b.score > s.score))"
        columns = ", ".join(f"CASE WHEN {new} THEN b.{v} ELSE s.{v} END AS {v}" for v in ("score", "h", "inliers", *M9))
        out.append(f"s{k + 1} AS MATERIALIZED (SELECT pair_id, n, tries, score, h, inliers, {ms}, {enough} AS sure FROM (SELECT s.pair_id, n, {high} AS tries, {columns} FROM s{k} s LEFT JOIN b{k} b ON s.pair_id = b.pair_id WHERE NOT s.sure) z)")
        low, high, k = high, min(high * GROWTH, MOST), k + 1
    last = " UNION ALL ".join(f"SELECT pair_id, n, tries, h, score, inliers, {ms} FROM s{j} WHERE {'sure' if j < k else 'true'}" for j in range(k + 1))
    return ",\n".join([*out, f"be AS MATERIALIZED ({last})"])


def _sql_affine_refit(source: str, into: str, weight: str) -> str:
    """CTEs that correct the models of ``source`` by weighted least squares."""
    cov = lambda a, b: f"(s{a}{b} / s_w - s{a} / s_w * s{b} / s_w)"
    u, v = "(rx - m0 * sx - m1 * sy - m2)", "(ry - m3 * sx - m4 * sy - m5)"
    x, y = "(sx - cx)", "(sy - cy)"
    sums = {"s_w": "w", "sx": f"w * {x}", "sy": f"w * {y}", "sxx": f"w * {x} * {x}", "sxy": f"w * {x} * {y}", "syy": f"w * {y} * {y}"}
    for c, e in (("u", u), ("v", v)):
        sums |= {f"s{c}": f"w * {e}", f"sx{c}": f"w * {x} * {e}", f"sy{c}": f"w * {y} * {e}"}
    new = []
    for k, c in enumerate("uv"):
        a, b = f"(({cov('y', 'y')} * {cov('x', c)} - {cov('x', 'y')} * {cov('y', c)}) / det)", f"(({cov('x', 'x')} * {cov('y', c)} - {cov('x', 'y')} * {cov('x', c)}) / det)"
        shift = f"(s{c} / s_w - {a} * (sx / s_w + cx) - {b} * (sy / s_w + cy))"
        new += [f"m{3 * k + i} + CASE WHEN det > 1e-9 THEN {d} ELSE 0 END AS m{3 * k + i}" for i, d in enumerate((a, b, shift))]
    return f"""{into}e AS (SELECT rk.*, {', '.join(M6)}, avg(sx) OVER (PARTITION BY rk.pair_id) AS cx, avg(sy) OVER (PARTITION BY rk.pair_id) AS cy FROM rk JOIN {source} USING (pair_id) WHERE m0 IS NOT NULL),
{into}r AS (SELECT *, {_residual('affine')} AS r FROM {into}e), {into}w AS (SELECT *, {weight} AS w FROM {into}r),
{into}s AS (SELECT pair_id, cx, cy, {', '.join(M6)}, {', '.join(f'sum({e}) AS {c}' for c, e in sums.items())} FROM {into}w GROUP BY ALL),
{into}d AS (SELECT *, CASE WHEN s_w >= 3 THEN {cov('x', 'x')} * {cov('y', 'y')} - {cov('x', 'y')} * {cov('x', 'y')} END AS det FROM {into}s),
{into} AS MATERIALIZED (SELECT pair_id, {', '.join(new)} FROM {into}d)"""


def _sql_homography(source: str) -> str:
    """CTEs that end in ho (pair_id, n, m0..m8): the normalised direct linear transform over the matches of ``source``, its eigenvector by eight sweeps of Jacobi rotations."""
    six = robust._SIX
    at = lambda i, j: six.index((min(i, j), max(i, j)))
    h = ("x", "y", "1.0::DOUBLE")
    sums = ", ".join(f"sum({h[i]} * {h[j]} * {w}) AS q{6 * b + k}" for b, w in enumerate(("1.0::DOUBLE", "u", "v", "(u * u + v * v)")) for k, (i, j) in enumerate(six))
    block = {(0, 0): (0, ""), (1, 1): (0, ""), (0, 2): (1, "-"), (2, 0): (1, "-"), (1, 2): (2, "-"), (2, 1): (2, "-"), (2, 2): (3, "")}
    cells = []
    for r in range(9):
        for c in range(9):
            b = block.get((r // 3, c // 3))
            cells.append("0.0::DOUBLE" if b is None else f"{b[1]}q{6 * b[0] + at(r % 3, c % 3)}")
    turns = [(p, q) for p in range(9) for q in range(p + 1, 9)]
    left, right = "[" + ", ".join(str(p) for p, _ in turns) + "]", "[" + ", ".join(str(q) for _, q in turns) + "]"
    moved = lambda m: f"list_transform(range(81), lambda i: CASE WHEN i % 9 = p THEN c * {m}[i + 1] - s * {m}[i - p + q + 1] WHEN i % 9 = q THEN s * {m}[i - q + p + 1] + c * {m}[i + 1] ELSE {m}[i + 1] END)"
    down = "list_transform(range(81), lambda i: CASE WHEN i // 9 = p THEN c * b[i + 1] - s * b[i + 9 * (q - p) + 1] WHEN i // 9 = q THEN s * b[i - 9 * (q - p) + 1] + c * b[i + 1] ELSE b[i + 1] END)"
    g = [f"{m}[{3 * i + 1}] * scale_s" if j == 0 else f"{m}[{3 * i + 2}] * scale_s" if j == 1 else f"({m}[{3 * i + 3}] - scale_s * mean_sx * {m}[{3 * i + 1}] - scale_s * mean_sy * {m}[{3 * i + 2}])" for m in ("e",) for i in range(3) for j in range(3)]
    final = [f"({g[j]} / scale_r + mean_rx * {g[6 + j]}) / {g[8]} AS m{j}" for j in range(3)] + [f"({g[3 + j]} / scale_r + mean_ry * {g[6 + j]}) / {g[8]} AS m{3 + j}" for j in range(3)] + [f"{g[6 + j]} / {g[8]} AS m{6 + j}" for j in range(3)]
    moves = "n, mean_sx, mean_sy, mean_rx, mean_ry, scale_s, scale_r"
    return f"""mv AS (SELECT pair_id, count(*) AS n, {', '.join(f'avg({c}) AS mean_{c}' for c in ('sx', 'sy', 'rx', 'ry'))}, sqrt(2 / (var_pop(sx) + var_pop(sy))) AS scale_s, sqrt(2 / (var_pop(rx) + var_pop(ry))) AS scale_r FROM {source} GROUP BY 1),
no AS (SELECT z.pair_id, {moves}, (sx - mean_sx) * scale_s AS x, (sy - mean_sy) * scale_s AS y, (rx - mean_rx) * scale_r AS u, (ry - mean_ry) * scale_r AS v FROM {source} z JOIN mv USING (pair_id) WHERE n >= 4),
qs AS (SELECT pair_id, {moves}, {sums} FROM no GROUP BY ALL),
jc AS (SELECT pair_id, 0 AS k, [{', '.join(cells)}] AS a, list_transform(range(81), lambda i: CAST(i // 9 = i % 9 AS DOUBLE)) AS v FROM qs
  UNION ALL SELECT pair_id, k + 1, {down} AS a, w AS v FROM (SELECT *, {moved('a')} AS b, {moved('v')} AS w FROM (SELECT *, 1 / sqrt(t * t + 1) AS c, t / sqrt(t * t + 1) AS s FROM (SELECT *, CASE WHEN abs(o) < 1e-300 THEN 0 ELSE (CASE WHEN th < 0 THEN -1 ELSE 1 END) / (abs(th) + sqrt(th * th + 1)) END AS t
    FROM (SELECT *, a[9 * p + q + 1] AS o, CASE WHEN abs(a[9 * p + q + 1]) < 1e-300 THEN 0 ELSE (a[10 * q + 1] - a[10 * p + 1]) / (2 * a[9 * p + q + 1]) END AS th FROM (SELECT *, {left}[k % 36 + 1] AS p, {right}[k % 36 + 1] AS q FROM jc WHERE k < 288) z1) z2) z3) z4) z5),
ev AS (SELECT pair_id, list_transform(range(9), lambda i: v[9 * i + least_at]) AS e FROM (SELECT *, list_position(list_transform(range(9), lambda i: a[10 * i + 1]), list_min(list_transform(range(9), lambda i: a[10 * i + 1]))) AS least_at FROM jc WHERE k = 288) z),
ho AS (SELECT pair_id, n, {', '.join(final)} FROM ev JOIN mv USING (pair_id))"""


# Queries

SQL_BEST = f"WITH {sql_robust(t.SQL_TIES)}"
SQL_TRIES = f"pair_id, tries, CAST(h AS BIGINT) AS h, inliers, {', '.join(f'{R6(m)} AS {m}' for m in M6)}"


def _tries(best: DataFrame) -> DataFrame:
    return best.select("pair_id", "tries", "h", "inliers", *[r6(m).alias(m) for m in M6])


@query(f"{SQL_BEST} SELECT {SQL_TRIES} FROM be")
def ransac_affine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tries(robust.robust_fit(t.ties(spark, sf_dir)))


@query(f"WITH {sql_robust(t.SQL_FAR_TIES)} SELECT {SQL_TRIES} FROM be")
def ransac_affine_many_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six of ten tie points are wrong: most pairs need a second round."""
    return _tries(robust.robust_fit(t.far_ties(spark, sf_dir)))


@query(f"WITH {sql_robust(t.SQL_TIES, method='lmeds')} SELECT pair_id, CAST(h AS BIGINT) AS h, {R6('-score')} AS median FROM be")
def lmeds_affine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return robust.robust_fit(t.ties(spark, sf_dir), method="lmeds").select("pair_id", "h", r6(-F.col("score")).alias("median"))


_MAGSAC = ",\n".join([sql_robust(t.SQL_TIES, method="magsac++"), *[_sql_affine_refit(a, b, _weight("r", THRESHOLD)) for a, b in (("be", "f1"), ("f1", "f2"), ("f2", "f3"))]])


@query(f"WITH {_MAGSAC} SELECT f3.pair_id, tries, CAST(h AS BIGINT) AS h, {R6('score')} AS score, {', '.join(f'{R6(f'f3.{m}')} AS {m}' for m in M6)} FROM f3 JOIN be ON f3.pair_id = be.pair_id")
def magsac_affine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best hypothesis by marginal gains, and the model after three reweighted fits."""
    ties = t.ties(spark, sf_dir)
    best = robust.robust_fit(ties, method="magsac++")
    fitted = robust.refined_affine(ties, best, "magsac++")
    return fitted.join(best.select("pair_id", "tries", "h", "score"), "pair_id").select("pair_id", "tries", "h", r6("score").alias("score"), *[r6(m).alias(m) for m in M6])


_RES = _residual("affine")


@query(f"{SQL_BEST} SELECT pair_id, count(*) FILTER ({_RES} <= 3) AS inliers, count(*) FILTER ({_RES} > 3) AS outliers, {R6(f'avg(CASE WHEN {_RES} <= 3 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)')} AS ratio FROM rk JOIN be USING (pair_id) GROUP BY 1")
def inlier_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    ties = t.ties(spark, sf_dir)
    inlier = F.col("residual") <= 3
    return points.residuals(ties, robust.robust_fit(ties)).groupBy("pair_id").agg(F.count_if(inlier).alias("inliers"), F.count_if(~inlier).alias("outliers"), r6(F.avg(inlier.cast("double"))).alias("ratio"))


SQL_SECOND = f"""{SQL_BEST}, {t.SQL_FIT.format('rk')}, r AS (SELECT pair_id, count(*) FILTER ({_RES} <= 3) AS inliers, sqrt(avg(CASE WHEN {_RES} <= 3 THEN pow({_RES}, 2) END)) AS rmse FROM rk JOIN be USING (pair_id) GROUP BY 1), c AS (SELECT pair_id, sqrt(avg(pow({_RES}, 2))) AS coarse FROM rk JOIN fit USING (pair_id) GROUP BY 1)"""


@query(f"{SQL_SECOND} SELECT pair_id, coalesce(inliers >= 10 AND rmse <= coarse + 1e-6, false) AS accepted FROM r JOIN c USING (pair_id)")
def refine_acceptance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a second pass replaces the first: ten inliers at least and no larger error."""
    ties = t.ties(spark, sf_dir)
    new = points.residuals(ties, robust.robust_fit(ties)).groupBy("pair_id").agg(F.count_if(F.col("residual") <= 3).alias("inliers"), F.sqrt(F.avg(F.when(F.col("residual") <= 3, F.col("residual") ** 2))).alias("rmse"))
    old = points.residuals(ties, points.affine_fit(ties)).groupBy("pair_id").agg(F.sqrt(F.avg(F.col("residual") ** 2)).alias("coarse"))
    return new.join(old, "pair_id").select("pair_id", F.coalesce((F.col("inliers") >= 10) & (F.col("rmse") <= F.col("coarse") + 1e-6), F.lit(False)).alias("accepted"))


_SHOWN = {m: f"{m} * 1000" if m in ("m6", "m7") else m for m in M9[:8]}
SQL_SHOWN = ", ".join(f"{R6(e)} AS {m}" for m, e in _SHOWN.items())


def _shown(fit: DataFrame) -> list:
    return [r6(F.expr(e)).alias(m) for m, e in _SHOWN.items()]


@query(f"WITH RECURSIVE {t.SQL_TIES}, {_sql_homography('ties')} SELECT pair_id, n, {SQL_SHOWN} FROM ho")
def homography_lsq(spark: SparkSession, sf_dir: str) -> DataFrame:
    fit = robust.homography_fit(t.ties(spark, sf_dir))
    return fit.select("pair_id", "n", *_shown(fit))


_INLIERS = f"il AS (SELECT rk.* FROM rk JOIN be USING (pair_id) WHERE {_residual('homography')} <= 3)"


@query(f"WITH RECURSIVE {sql_robust(t.SQL_TIES, 'homography')}, {_INLIERS}, {_sql_homography('il')} SELECT ho.pair_id, ho.n, tries, CAST(h AS BIGINT) AS h, inliers, {SQL_SHOWN.replace('(m', '(ho.m')} FROM ho JOIN be ON ho.pair_id = be.pair_id")
def robust_homography(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best homography through four matches, and the least squares one over its inliers."""
    ties = t.ties(spark, sf_dir)
    best = robust.robust_fit(ties, "homography")
    fit = robust.refined_homography(ties, best)
    return fit.join(best.select("pair_id", "tries", "h", "inliers"), "pair_id").select("pair_id", "n", "tries", "h", "inliers", *_shown(fit))


@query()
def robust_fundamental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tie points of one plane agree with many fundamental matrices: what counts is how many an eight-point hypothesis explains."""
    return robust.robust_fit(t.ties(spark, sf_dir), "fundamental").select("pair_id", "n", "tries", "h", "inliers")


_GRID = "(SELECT unnest(range(9)) AS i) gi, (SELECT unnest(range(9)) AS j) gj"
_OFF = "sqrt(pow((m0 - 0.98::DOUBLE) * x + (m1 + 0.12::DOUBLE) * y + m2 - 15, 2) + pow((m3 - 0.11::DOUBLE) * x + (m4 - 1.02::DOUBLE) * y + m5 + 10, 2))"


@query(f"""WITH {sql_robust(t.SQL_FAR_TIES)}, {_sql_affine_refit('be', 'f1', 'CASE WHEN r <= 3 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END')},
e AS (SELECT pair_id, {_RES} AS r FROM rk JOIN f1 USING (pair_id)), c AS (SELECT pair_id, sqrt(avg(CASE WHEN r <= 3 THEN r * r END)) AS rmse, avg(CASE WHEN r <= 3 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS ratio FROM e GROUP BY 1),
g AS (SELECT pair_id, avg({_OFF}) AS mean_off, max({_OFF}) AS most_off FROM (SELECT f1.*, 1024 * (0.1::DOUBLE + i * 0.1::DOUBLE) AS x, 1024 * (0.1::DOUBLE + j * 0.1::DOUBLE) AS y FROM f1, {_GRID}) z GROUP BY 1)
SELECT c.pair_id, rmse < 1 AS sub_pixel, ratio > 0.3 AS enough_inliers, mean_off < 0.5 AND most_off < 1 AS accurate, {R6('rmse')} AS rmse, {R6('mean_off')} AS mean_off FROM c JOIN g ON c.pair_id = g.pair_id""")
def requirement_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The gates of a benchmark over fits with a known answer: residuals under a pixel, more than 30 % inliers, and points of a 9 x 9 grid near where the true transform takes them, with six of ten tie points wrong."""
    ties = t.far_ties(spark, sf_dir)
    fits = robust.refined_affine(ties, robust.robust_fit(ties), times=1)
    inside = F.col("residual") <= THRESHOLD
    left = robust.with_models(ties, fits).withColumn("residual", robust.residual("affine")).groupBy("pair_id").agg(F.sqrt(F.avg(F.when(inside, F.col("residual") ** 2))).alias("rmse"), F.avg(inside.cast("double")).alias("ratio"))
    step = F.sequence(F.lit(0), F.lit(8))
    x, y = 1024 * (0.1 + F.col("i") * 0.1), 1024 * (0.1 + F.col("j") * 0.1)
    ex = (F.col("m0") - 0.98) * x + (F.col("m1") + 0.12) * y + F.col("m2") - 15
    ey = (F.col("m3") - 0.11) * x + (F.col("m4") - 1.02) * y + F.col("m5") + 10
    off = fits.withColumn("i", F.explode(step)).withColumn("j", F.explode(step)).groupBy("pair_id").agg(F.avg(F.sqrt(ex * ex + ey * ey)).alias("mean_off"), F.max(F.sqrt(ex * ex + ey * ey)).alias("most_off"))
    gates = {"sub_pixel": F.col("rmse") < 1, "enough_inliers": F.col("ratio") > 0.3, "accurate": (F.col("mean_off") < 0.5) & (F.col("most_off") < 1)}
    return left.join(off, "pair_id").select("pair_id", *[v.alias(k) for k, v in gates.items()], r6("rmse").alias("rmse"), r6("mean_off").alias("mean_off"))
