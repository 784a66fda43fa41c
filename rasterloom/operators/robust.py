"""Robust fits of many pairs as tables: rounds of seeded hypotheses until each pair is sure, then refits from moments.

Matches are (pair_id, idx, sx, sy, rx, ry). They are numbered once within their pairs and stored in blocks. A round draws hypotheses for the pairs that aren't finished, scores each by one aggregate over their matches, and keeps the
best of each pair; a pair is finished when so many tries find a sample of inliers with the wanted confidence, given the best share of inliers so far. Rounds grow by a factor, so there are few; only tables of one row per pair
and hypothesis travel between them. A pair with very many matches is spread over tasks: numbers come from ranges, scores are partial sums.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..sources.shared import Folder

#: Matches that a model needs.
NEED = {"affine": 3, "homography": 4, "fundamental": 8}
M9 = [f"m{k}" for k in range(9)]
#: Reach of a residual in noise scales: the 0.99 quantile of the chi distribution with four degrees of freedom (fixed value).
REACH = 3.64
#: Rational approximation of the complementary error function, to 1.5e-7 (fixed values).
ERFC_P, ERFC_A = 0.3275911, (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)


#: Matches in a block at most.
BLOCK = 1024
POINT = ["sx", "sy", "rx", "ry"]


def blocks(matches: DataFrame, folder: Folder) -> DataFrame:
    """(pair_id, lo, sx, sy, rx, ry): each pair's matches in order of idx, then coordinates, as arrays of at most BLOCK, lo being the number of a block's first match in its pair; stored. Ranges of matches are
    packed where they were sorted and blocks are numbered by their sizes, so that no pair has to meet in one task and matches are shuffled once."""
    order = ["pair_id", "idx", *POINT]
    kind = dict(matches.dtypes)["pair_id"]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, place = TaskContext.get().partitionId(), 0
        for b in batches:
            pairs = b.column(0)
            n = len(pairs)
            if not n:
                continue
            ends = np.flatnonzero(pc.not_equal(pairs[1:], pairs[:-1]).to_numpy(zero_copy_only=False)) + 1
            starts = np.concatenate([np.arange(lo, hi, BLOCK) for lo, hi in zip([0, *ends.tolist()], [*ends.tolist(), n])])
            at = pa.array(np.append(starts, n).astype(np.int32))
            made = [pairs.take(pa.array(starts)), pa.array(np.full(len(starts), part, np.int32)), pa.array(np.arange(place, place + len(starts))), pa.array(np.diff(np.append(starts, n)))]
            yield pa.RecordBatch.from_arrays([*made, *[pa.ListArray.from_arrays(at, b.column(1 + k)) for k in range(4)]], ["pair_id", "part", "place", "n", *POINT])
            place += len(starts)

    dealt = matches.where("pair_id IS NOT NULL").select("pair_id", "idx", *[F.col(c).cast("double").alias(c) for c in POINT]).repartitionByRange(*order).sortWithinPartitions(*order)
    packed = dealt.select("pair_id", *POINT).mapInArrow(pack, f"pair_id {kind}, part int, place long, n long, " + ", ".join(f"{c} array<double>" for c in POINT))
    parts = folder.save(packed, "parts")
    before = F.sum("n").over(Window.partitionBy("pair_id").orderBy("part", "place").rowsBetween(Window.unboundedPreceding, -1))
    placed = parts.select("pair_id", "part", "place", F.coalesce(before, F.lit(0)).cast("long").alias("lo"))
    return folder.save(parts.join(placed.drop("pair_id"), ["part", "place"]).select("pair_id", "lo", *POINT), "blocks")


def unpacked(blocks: DataFrame, *others: str) -> DataFrame:
    """The matches of blocks, each with its block's other columns."""
    return blocks.select("pair_id", *others, F.inline(F.arrays_zip(*POINT)))


def ordinals(matches: DataFrame, folder: Folder) -> DataFrame:
    """(pair_id, k, sx, sy, rx, ry): each pair's matches numbered from 0 by idx, then coordinates (``blocks``)."""
    each = blocks(matches, folder).select("pair_id", "lo", F.posexplode(F.arrays_zip(*POINT)).alias("at", "p"))
    return each.select("pair_id", (F.col("lo") + F.col("at")).alias("k"), "p.*")


def drawn(h: Column, n: Column, need: int) -> Column:
    """``need`` different numbers below n for hypothesis h, as an array: digits of MD5 pick among those that are left."""

    def pick(taken: Column, c: Column) -> Column:
        number = F.conv(F.substring(F.md5(F.concat_ws("-", h, c).cast("binary")), 1, 8), 16, 10).cast("long")
        among = F.aggregate(F.array_sort(taken), number % (n - c), lambda k, t: k + (k >= t).cast("long"))
        return F.concat(taken, F.array(among))

    return F.aggregate(F.sequence(F.lit(0), F.lit(need - 1)), F.array().cast("array<bigint>"), pick)


def _twice_area(p: str, i: int, j: int, k: int) -> Column:
    """Twice the signed area of the triangle of points i, j, k of that side (s or r)."""
    x, y = (lambda a: F.col(f"{p}x{a}")), (lambda a: F.col(f"{p}y{a}"))
    return (x(j) - x(i)) * (y(k) - y(i)) - (x(k) - x(i)) * (y(j) - y(i))


def through(samples: DataFrame, model: str) -> DataFrame:
    """samples (columns sx0, sy0, rx0, ...) with the exact model m0..m8 through them; degenerate ones drop out."""
    if model == "affine":
        d = lambda p, a: F.col(f"{p}{a}") - F.col(f"{p}0")
        det = _twice_area("s", 0, 1, 2)
        out = {}
        for k, to in enumerate(("rx", "ry")):
            out[f"m{3 * k}"] = (d(to, 1) * d("sy", 2) - d(to, 2) * d("sy", 1)) / F.col("det")
            out[f"m{3 * k + 1}"] = (d(to, 2) * d("sx", 1) - d(to, 1) * d("sx", 2)) / F.col("det")
        shift = {f"m{3 * k + 2}": F.col(f"{to}0") - F.col(f"m{3 * k}") * F.col("sx0") - F.col(f"m{3 * k + 1}") * F.col("sy0") for k, to in enumerate(("rx", "ry"))}
        return samples.withColumn("det", det).where("abs(det) > 1e-9").withColumns(out).withColumns(shift).withColumns({"m6": F.lit(0.0), "m7": F.lit(0.0), "m8": F.lit(1.0)})
    # Three points span a frame in which the fourth has the weights w; a homography maps frame to frame.
    weights = {f"{p}w{i}": _twice_area(p, *[3 if k == i else k for k in range(3)]) for p in "sr" for i in range(3)} | {f"{p}w3": _twice_area(p, 0, 1, 2) for p in "sr"}
    found = samples.withColumns(weights).where(" and ".join(f"abs({w}) > 1e-6" for w in weights))
    x, y = (lambda a: F.col(f"sx{a % 3}")), (lambda a: F.col(f"sy{a % 3}"))
    sums: list[Column] = [F.lit(0.0)] * 9
    for i in range(3):
        a, b = i + 1, i + 2
        cross = (y(a) - y(b), x(b) - x(a), x(a) * y(b) - x(b) * y(a))
        for r, to in enumerate((F.col(f"rx{i}"), F.col(f"ry{i}"), F.lit(1.0))):
            for c in range(3):
                sums[3 * r + c] = sums[3 * r + c] + F.col(f"rw{i}") / F.col(f"sw{i}") * to * cross[c]
    raw = found.withColumns({f"g{k}": v for k, v in enumerate(sums)}).where("abs(g8) > 1e-12")
    return raw.withColumns({m: F.col(f"g{k}") / F.col("g8") for k, m in enumerate(M9)})


def _distance(model: str, m: Sequence, sx, sy, rx, ry, root=F.sqrt, size=F.abs, larger=F.greatest):
    """``residual`` of elements m and coordinates, which are columns, or arrays with numpy's functions: the operations are the same, in the same order."""
    if model == "fundamental":
        there = [m[3 * i] * sx + m[3 * i + 1] * sy + m[3 * i + 2] * 1.0 for i in range(3)]
        here = [m[i] * rx + m[3 + i] * ry + m[6 + i] * 1.0 for i in range(2)]
        up = size(rx * there[0] + ry * there[1] + 1.0 * there[2])
        return larger(*[up / (root(x * x + y * y) + 1e-12) for x, y in (there[:2], here)])
    down = (m[6] * sx + m[7] * sy + m[8] + 1e-8) if model == "homography" else 1.0
    x = (m[0] * sx + m[1] * sy + m[2]) / down - rx
    y = (m[3] * sx + m[4] * sy + m[5]) / down - ry
    return root(x * x + y * y)


def residual(model: str) -> Column:
    """Distance of a match (sx, sy, rx, ry) from its model's columns m0..m8; for fundamental matrices from the epipolar lines, the larger of both sides."""
    return _distance(model, [F.col(c) for c in M9], *[F.col(c) for c in POINT])


def upper_gamma(x: Column) -> Column:
    """The upper incomplete gamma function of 3/2, for x >= 0."""
    root = F.sqrt(x)
    t = 1 / (1 + ERFC_P * root)
    series = F.lit(0.0)
    for a in reversed(ERFC_A):
        series = (series + a) * t
    return (0.5 * math.sqrt(math.pi) * series + root) * F.exp(-x)


def marginal_weight(r: Column, sigma: float) -> Column:
    """A residual's weight when its noise scale may be anything from 0 to sigma: falls from 1 at 0 to 0 at REACH * sigma."""
    rest = upper_gamma(F.lit(REACH * REACH / 2))
    w = (upper_gamma(r * r / (2 * sigma * sigma)) - rest) / (0.5 * math.sqrt(math.pi) - rest)
    return F.when(r < REACH * sigma, F.greatest(w, F.lit(0.0))).otherwise(0.0)


def marginal_gain(r: Column, sigma: float) -> Column:
    """1 minus the marginal loss of a residual, scaled so that the loss is 1 at REACH * sigma and beyond."""
    rest, all_of = upper_gamma(F.lit(REACH * REACH / 2)), 0.75 * math.sqrt(math.pi)

    def loss(x: Column) -> Column:  # x = r^2 / (2 sigma^2); the lower incomplete gamma of 5/2 from the upper one of 3/2
        up = upper_gamma(x)
        return (all_of - 1.5 * up - x * F.sqrt(x) * F.exp(-x)) + x * (up - rest)

    return F.when(r < REACH * sigma, 1 - loss(r * r / (2 * sigma * sigma)) / loss(F.lit(REACH * REACH / 2))).otherwise(0.0)


def tries_needed(share: Column, need: int, confidence: float) -> Column:
    """Draws that hold a sample of inliers only with that confidence."""
    s = F.least(F.greatest(share, F.lit(1e-6)), F.lit(1 - 1e-9))
    good = F.lit(1.0)
    for _ in range(need):
        good = good * s
    # A share too small to tell from none would need more tries than anyone makes.
    return F.ceil(math.log(1 - confidence) / F.log(F.least(1 - good, F.lit(1 - 1e-15))))


def hypotheses(numbered: DataFrame, pairs: DataFrame, first: int, last: int, model: str) -> DataFrame:
    """(pair_id, h, m0..m8) for h from first to last - 1 of the pairs (pair_id, n), n matches at least as many as the model needs. numbered: blocks of matches, or ``ordinals``, which are blocks of one.

    Draws are made where the blocks are, which take their own out: a join of matches with draws would send all draws through the driver, as Spark takes them for as small as the pairs that they come from."""
    need = NEED[model]
    if "k" in numbered.columns:
        numbered = numbered.select("pair_id", F.col("k").alias("lo"), *[F.array(c).alias(c) for c in POINT])
    draws = numbered.join(pairs.select("pair_id", "n"), "pair_id").withColumn("h", F.explode(F.sequence(F.lit(first), F.lit(last - 1))))
    picks = draws.select("pair_id", "h", "lo", *POINT, F.posexplode(drawn(F.col("h"), F.col("n"), need)).alias("c", "k")).where("k >= lo AND k < lo + size(sx)")
    picks = picks.select("pair_id", "h", "c", *[F.get(c, (F.col("k") - F.col("lo")).cast("int")).alias(c) for c in POINT])
    if model == "fundamental":
        return fundamental_fit(picks, ("pair_id", "h")).where("m0 IS NOT NULL").select("pair_id", "h", *M9)
    at = lambda col, c: F.max(F.when(F.col("c") == c, F.col(col))).alias(f"{col}{c}")
    samples = picks.groupBy("pair_id", "h").agg(*[at(col, c) for col in ("sx", "sy", "rx", "ry") for c in range(need)])
    return through(samples, model).select("pair_id", "h", *M9)


def scored(numbered: DataFrame, found: DataFrame, model: str, method: str, threshold: float) -> DataFrame:
    """(pair_id, h, m0..m8, score, inliers) from blocks of matches; larger scores are better. A pair's hypotheses meet its blocks as one row."""
    packed = found.groupBy("pair_id").agg(F.collect_list(F.struct("h", *M9)).alias("hs"))
    each = unpacked(numbered.join(packed, "pair_id"), "hs").select("pair_id", *POINT, F.inline("hs"))
    each = each.withColumn("residual", residual(model))
    inliers = F.count_if(F.col("residual") <= threshold)
    score = {"ransac": inliers.cast("double"), "magsac++": F.round(F.sum(marginal_gain(F.col("residual"), threshold)), 6)}[method]
    return each.groupBy("pair_id", "h", *M9).agg(score.alias("score"), inliers.alias("inliers"))


#: Hypotheses whose residuals from a block are in memory at once, and places of a block's sorted residuals that bracket the median of a pair of many blocks.
AT_ONCE, SAMPLED = 64, 64


def _by_block(joined: DataFrame, model: str, each: Callable[[np.ndarray, dict[str, np.ndarray]], dict[str, np.ndarray | list]], schema: str) -> DataFrame:
    """From blocks with their pair's n and hs (structs of h, m0..m8 and others): (pair_id, h, m0..m8) and what ``each`` makes of the residuals (a row per hypothesis) and of n and the others of hs."""
    kind = dict(joined.dtypes)["pair_id"]
    into = joined.select("pair_id", "n", *POINT, "hs")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                point = [b.column(2 + k)[i].values.to_numpy() for k in range(4)]
                hs = b.column(6)[i].values
                if hs is None or not len(hs):
                    continue
                for lo in range(0, len(hs), AT_ONCE):
                    some = hs.slice(lo, AT_ONCE)
                    # flatten() keeps to the slice
                    fields = dict(zip([f.name for f in some.type], some.flatten()))
                    own = {c: v.to_numpy() for c, v in fields.items()}
                    with np.errstate(all="ignore"):
                        r = _distance(model, [own[c][:, None] for c in M9], *point, root=np.sqrt, size=np.abs, larger=np.maximum)
                    made = each(r, own | {"n": b.column(1)[i].as_py()})
                    at = pa.array(np.full(len(some), i, np.int32))
                    columns = {"pair_id": b.column(0).take(at), "h": fields["h"], **{c: fields[c] for c in M9}, **made}
                    yield pa.RecordBatch.from_arrays([v if isinstance(v, pa.Array) else pa.array(v) for v in columns.values()], list(columns))

    return into.mapInArrow(run, f"pair_id {kind}, h long, " + ", ".join(f"{c} double" for c in M9) + ", " + schema)


def scored_by_median(numbered: DataFrame, found: DataFrame, counts: DataFrame, many: bool, model: str, threshold: float) -> DataFrame:
    """``scored`` by least medians, rounded to nine places; counts: (pair_id, n); many: whether some pair has more than a block.

    Residuals stay in the blocks' tasks. A pair in one block has its median there. In a pair of many, each block gives every hypothesis SAMPLED of its sorted residuals with the numbers of residuals that are surely no
    larger and no smaller, which bracket the middle; only residuals within the bracket, a sixteenth of a pair's or so, are gathered, and one of a known rank among them is the median."""
    def hs(*others: str) -> Column:
        return F.collect_list(F.struct(F.col("h").cast("long").alias("h"), *M9, *others)).alias("hs")

    joined = numbered.join(found.groupBy("pair_id").agg(hs()).join(counts.select("pair_id", "n"), "pair_id"), "pair_id")
    middle = lambda n: ((n - 1) // 2, n // 2)

    def whole(r: np.ndarray, own: dict[str, np.ndarray]) -> dict[str, np.ndarray | list]:
        a, b = middle(r.shape[1])
        r_sorted = np.partition(r, (a, b), axis=1)
        return {"inliers": (r <= threshold).sum(1), "median": 0.5 * r_sorted[:, a] + 0.5 * r_sorted[:, b]}

    def sample(r: np.ndarray, own: dict[str, np.ndarray]) -> dict[str, np.ndarray | list]:
        size = r.shape[1]
        at = np.unique(np.linspace(0, size - 1, min(size, SAMPLED)).astype(np.int64))
        return {"n": np.full(len(r), own["n"]), "v": list(np.sort(r, axis=1)[:, at]), "up": [np.diff(at, prepend=-1)] * len(r), "down": [np.diff(at, append=size)] * len(r)}

    def inside(r: np.ndarray, own: dict[str, np.ndarray]) -> dict[str, np.ndarray | list]:
        # What isn't a number is larger than all numbers.
        low, high = own["low"][:, None], own["high"][:, None]
        below = (r < low) | (np.isnan(low) & ~np.isnan(r))
        within = ~below & ((r <= high) | np.isnan(high))
        return {"n": np.full(len(r), own["n"]), "inliers": (r <= threshold).sum(1), "below": below.sum(1), "values": [x[k] for x, k in zip(r, within)]}

    one = _by_block(joined.where(F.size("sx") == F.col("n")), model, whole, "inliers long, median double")
    result = lambda df: df.select("pair_id", "h", *M9, (-F.round("median", 9)).alias("score"), "inliers")
    if not many:
        return result(one)
    parts = joined.where(F.size("sx") < F.col("n"))
    samples = _by_block(parts, model, sample, "n long, v array<double>, up array<long>, down array<long>").select("pair_id", "h", *M9, "n", F.inline(F.arrays_zip("v", "up", "down")))
    key = Window.partitionBy("pair_id", "h")
    surely = samples.withColumns({"up": F.sum("up").over(key.orderBy("v")), "down": F.sum("down").over(key.orderBy(F.desc("v")))})
    ends = {"low": F.max(F.when(F.col("down") >= F.col("n") - F.expr("(n - 1) div 2"), F.col("v"))), "high": F.min(F.when(F.col("up") >= F.expr("n div 2") + 1, F.col("v")))}
    ends = surely.groupBy("pair_id", "n", "h", *M9).agg(*[v.alias(c) for c, v in ends.items()]).groupBy("pair_id", "n").agg(hs("low", "high"))
    near = _by_block(numbered.join(ends, "pair_id"), model, inside, "n long, inliers long, below long, values array<double>")
    near = near.groupBy("pair_id", "n", "h", *M9).agg(F.sum("inliers").alias("inliers"), F.sum("below").alias("below"), F.sort_array(F.flatten(F.collect_list("values"))).alias("values"))
    value = lambda rank: F.get("values", (F.expr(rank) - F.col("below")).cast("int"))
    return result(one).unionByName(result(near.withColumn("median", 0.5 * value("(n - 1) div 2") + 0.5 * value("n div 2"))))


def robust_fit(matches: DataFrame, model: str = "affine", method: str = "ransac", threshold: float = 3.0, confidence: float = 0.999, most: int = 10_000, first: int = 16, growth: int = 4) -> DataFrame:
    """(pair_id, n, tries, h, score, inliers, m0..m8), one row per pair: the best of as many hypotheses as the pair needs, ``most`` at the outside.

    ransac counts inliers (residual at most ``threshold``), magsac++ sums gains marginal over noise scales up to ``threshold``, lmeds takes the least median residual and draws for half of outliers. Equal scores go to the smaller h. Pairs with too few matches or
    only degenerate samples have null h and model. The rows are stored; matches with a null coordinate don't count.
    """
    spark, need = matches.sparkSession, NEED[model]
    folder = Folder(spark, "robust")
    numbered = blocks(matches.dropna(subset=POINT), folder)
    folder.drop("parts")
    kinds = "struct<score: double, back: bigint, inliers: bigint, m: array<double>>"
    every = matches.select("pair_id").distinct().join(numbered.groupBy("pair_id").agg(F.sum(F.size("sx")).alias("n")), "pair_id", "left").na.fill(0, ["n"])
    state = folder.save(every.select("pair_id", "n", F.lit(0).alias("tries"), F.lit(None).cast(kinds).alias("best"), (F.col("n") < need).alias("sure")), "state0")
    many = method == "lmeds" and not numbered.where("lo > 0").isEmpty()
    low, high, k = 0, min(first, most), 0
    while low < most and not state.where("not sure").isEmpty():
        open_now = state.where("not sure")
        found = hypotheses(numbered, open_now, low, high, model)
        if method == "lmeds":
            each = scored_by_median(numbered, folder.save(found, f"drawn{k}") if many else found, open_now, many, model, threshold)
        else:
            each = scored(numbered, found, model, method, threshold)
        won = each.groupBy("pair_id").agg(F.max(F.struct("score", (-F.col("h")).cast("long").alias("back"), "inliers", F.array(*M9).alias("m"))).cast(kinds).alias("now"))
        # Earlier hypotheses have larger ``back``, so they win ties.
        best = F.greatest(F.col("best"), F.col("now"))
        share = F.coalesce(F.col("best.inliers") / F.col("n"), F.lit(0.0)) if method != "lmeds" else F.lit(0.5)
        done = open_now.join(won, "pair_id", "left").withColumns({"best": best, "tries": F.lit(high)}).drop("now").withColumn("sure", F.col("tries") >= tries_needed(share, need, confidence))
        k += 1
        state = folder.save(state.where("sure").unionByName(done.select(state.columns)), f"state{k}")
        low, high = high, min(high * growth, most)
    for name in ("blocks", *[f"state{j}" for j in range(k)], *[f"drawn{j}" for j in range(k) if many]):
        folder.drop(name)
    m = {name: F.col("best.m")[i] for i, name in enumerate(M9)}
    return state.select("pair_id", "n", "tries", (-F.col("best.back")).alias("h"), "best.score", "best.inliers", *[v.alias(name) for name, v in m.items()])


# Refits from moments


def with_models(matches: DataFrame, models: DataFrame) -> DataFrame:
    """matches with their pair's m0..m8."""
    return matches.join(models.select("pair_id", *M9), "pair_id")


def weighted_affine(matches: DataFrame, models: DataFrame, weight: Column, least: float = 3.0) -> DataFrame:
    """(pair_id, m0..m8): ``models`` corrected by weighted least squares over the matches, from one aggregate of moments of the residuals around the pair's mean. weight: an expression of ``residual``. Pairs whose weights sum to less than
    ``least``, or whose points are collinear, keep their model."""
    centre = matches.groupBy("pair_id").agg(F.avg("sx").alias("cx"), F.avg("sy").alias("cy"))
    each = with_models(matches, models).join(centre, "pair_id").withColumn("residual", residual("affine")).withColumn("w", weight)
    x, y, w = F.col("sx") - F.col("cx"), F.col("sy") - F.col("cy"), F.col("w")
    errors = {"u": F.col("rx") - F.col("m0") * F.col("sx") - F.col("m1") * F.col("sy") - F.col("m2"), "v": F.col("ry") - F.col("m3") * F.col("sx") - F.col("m4") * F.col("sy") - F.col("m5")}
    sums = {"w": w, "x": w * x, "y": w * y, "xx": w * x * x, "xy": w * x * y, "yy": w * y * y}
    for c, e in errors.items():
        sums |= {c: w * e, f"x{c}": w * x * e, f"y{c}": w * y * e}
    made = each.groupBy("pair_id", "cx", "cy", *M9).agg(*[F.sum(v).alias(f"s_{c}") for c, v in sums.items()])
    of = lambda c: F.col(f"s_{c}") / F.col("s_w")
    cov = lambda a, b: of(a + b) - of(a) * of(b)
    made = made.withColumn("det", F.when(F.col("s_w") >= least, cov("x", "x") * cov("y", "y") - cov("x", "y") * cov("x", "y")))
    out = {}
    for k, c in enumerate(("u", "v")):
        a, b = (cov("y", "y") * cov("x", c) - cov("x", "y") * cov("y", c)) / F.col("det"), (cov("x", "x") * cov("y", c) - cov("x", "y") * cov("x", c)) / F.col("det")
        shift = of(c) - a * (of("x") + F.col("cx")) - b * (of("y") + F.col("cy"))
        out |= {f"m{3 * k + i}": F.col(f"m{3 * k + i}") + F.when(F.col("det") > 1e-9, d).otherwise(0.0) for i, d in enumerate((a, b, shift))}
    return made.withColumns(out).select("pair_id", *M9)


def refined_affine(matches: DataFrame, models: DataFrame, method: str = "ransac", threshold: float = 3.0, times: int = 3) -> DataFrame:
    """(pair_id, m0..m8): ``times`` refits, on the inliers, or for magsac++ on all matches by marginal weights."""
    weight = marginal_weight(F.col("residual"), threshold) if method == "magsac++" else (F.col("residual") <= threshold).cast("double")
    models = models.where("m0 IS NOT NULL")
    for _ in range(times):
        models = weighted_affine(matches, models, weight)
    return models


def _least_vectors(moments: np.ndarray) -> np.ndarray:
    """The eigenvector of the smallest eigenvalue of each symmetric 9 x 9 matrix; rows with a value that isn't finite give NaN."""
    out = np.full((len(moments), 9), np.nan)
    ok = np.isfinite(moments).all((1, 2))
    if ok.any():
        out[ok] = np.linalg.eigh(moments[ok])[1][:, :, 0]
    return out


#: Places of the products of a point (x, y, 1) with itself in a symmetric 3 x 3 matrix.
_SIX = [(0, 0), (0, 1), (0, 2), (1, 1), (1, 2), (2, 2)]
_FULL = np.array([[_SIX.index((min(i, j), max(i, j))) for j in range(3)] for i in range(3)])


def _normalised(matches: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """matches with each side moved to its mean and scaled to a root mean square distance of sqrt(2): columns x, y, u, v, and the moves."""
    sides = {"s": ("sx", "sy"), "r": ("rx", "ry")}
    moves = [F.avg(c).alias(f"mean_{c}") for cs in sides.values() for c in cs] + [F.sqrt(2 / (F.var_pop(cs[0]) + F.var_pop(cs[1]))).alias(f"scale_{s}") for s, cs in sides.items()]
    both = matches.join(matches.groupBy(*keys).agg(F.count("*").alias("n"), *moves), list(keys))
    return both.withColumns({to: (F.col(c) - F.col(f"mean_{c}")) * F.col(f"scale_{c[0]}") for to, c in zip("xyuv", ("sx", "sy", "rx", "ry"))})


_MOVES = ["n", "mean_sx", "mean_sy", "mean_rx", "mean_ry", "scale_s", "scale_r"]


def _solve(sums: DataFrame, finish, keys: tuple[str, ...]) -> DataFrame:
    """One matrix per row of sums, by ``finish`` (arrays of moves and of moments to (rows, 9)), in batches; rows are pairs, no points."""
    kinds = dict(sums.dtypes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                with np.errstate(all="ignore"):
                    m = finish({c: pdf[c].to_numpy(float) for c in _MOVES}, np.stack(pdf["moments"].to_numpy()).astype(float))
                yield pd.DataFrame({**{c: pdf[c] for c in keys}, "n": pdf["n"], "m": [x.tolist() if np.isfinite(x).all() else None for x in m]})

    found = sums.mapInPandas(run, ", ".join(f"{c} {kinds[c]}" for c in keys) + ", n long, m array<double>")
    return found.select(*keys, "n", *[F.col("m")[k].alias(c) for k, c in enumerate(M9)])


def _moved(mean_x: np.ndarray, mean_y: np.ndarray, scale: np.ndarray) -> np.ndarray:
    out = np.zeros((len(scale), 3, 3))
    out[:, 0, 0] = out[:, 1, 1] = scale
    out[:, 0, 2], out[:, 1, 2], out[:, 2, 2] = -scale * mean_x, -scale * mean_y, 1
    return out


def homography_fit(matches: DataFrame) -> DataFrame:
    """(pair_id, n, m0..m8): the homography of least algebraic error over all matches of each pair (the normalised direct linear transform), with m8 = 1; null for fewer than four matches or without a solution.

    The 9 x 9 matrix of the problem has four different blocks of sums of six products each; two aggregates make them, and the eigenvectors of a batch of pairs are found in one call."""
    h = (F.col("x"), F.col("y"), F.lit(1.0))
    u, v = F.col("u"), F.col("v")
    blocks = [F.sum(h[i] * h[j] * w) for w in (F.lit(1.0), u, v, u * u + v * v) for i, j in _SIX]
    keys = ("pair_id",)
    sums = _normalised(matches, keys).groupBy(*keys, *_MOVES).agg(F.array(*blocks).alias("moments")).where("n >= 4")

    def finish(at: dict[str, np.ndarray], moments: np.ndarray) -> np.ndarray:
        one, by_u, by_v, by_w = (moments[:, 6 * k: 6 * k + 6][:, _FULL] for k in range(4))
        zero = np.zeros_like(one)
        whole = np.concatenate([np.concatenate(r, 2) for r in ((one, zero, -by_u), (zero, one, -by_v), (-by_u, -by_v, by_w))], 1)
        m = _least_vectors(whole).reshape(-1, 3, 3)
        to = _moved(at["mean_rx"], at["mean_ry"], at["scale_r"])
        ok = np.isfinite(m).all((1, 2)) & np.isfinite(to).all((1, 2))
        out = np.full((len(m), 3, 3), np.nan)
        out[ok] = np.linalg.inv(to[ok]) @ m[ok] @ _moved(at["mean_sx"], at["mean_sy"], at["scale_s"])[ok]
        return (out / out[:, 2:, 2:]).reshape(-1, 9)

    few = matches.groupBy("pair_id").agg(F.count("*").alias("n")).where("n < 4").select("pair_id", "n", *[F.lit(None).cast("double").alias(c) for c in M9])
    return _solve(sums, finish, keys).unionByName(few)


def fundamental_fit(matches: DataFrame, keys: tuple[str, ...] = ("pair_id",)) -> DataFrame:
    """(keys, n, m0..m8): the normalised eight-point fundamental matrix of rank two over all matches of each key, of norm 1 with its largest element positive; null for fewer than eight. Its 9 x 9 matrix is 36 sums."""
    a, b = (F.col("x"), F.col("y"), F.lit(1.0)), (F.col("u"), F.col("v"), F.lit(1.0))
    products = [F.sum(b[i] * b[k] * a[j] * a[l]) for i, k in _SIX for j, l in _SIX]
    sums = _normalised(matches, keys).groupBy(*keys, *_MOVES).agg(F.array(*products).alias("moments")).where("n >= 8")
    # Element (3 i + j, 3 k + l) is the sum of b_i b_k a_j a_l.
    place = np.array([[6 * _FULL[i, k] + _FULL[j, l] for k in range(3) for l in range(3)] for i in range(3) for j in range(3)])

    def finish(at: dict[str, np.ndarray], moments: np.ndarray) -> np.ndarray:
        f = _least_vectors(moments[:, place]).reshape(-1, 3, 3)
        ok = np.isfinite(f).all((1, 2))
        out = np.full((len(f), 3, 3), np.nan)
        p, s, q = np.linalg.svd(f[ok])
        s[:, 2] = 0
        to, by = _moved(at["mean_rx"], at["mean_ry"], at["scale_r"])[ok], _moved(at["mean_sx"], at["mean_sy"], at["scale_s"])[ok]
        out[ok] = to.transpose(0, 2, 1) @ ((p * s[:, None, :]) @ q) @ by
        flat = out.reshape(-1, 9)
        top = np.take_along_axis(flat, np.abs(np.nan_to_num(flat)).argmax(1)[:, None], 1)
        return flat / np.linalg.norm(flat, axis=1, keepdims=True) * np.sign(top)

    few = matches.groupBy(*keys).agg(F.count("*").alias("n")).where("n < 8").select(*keys, "n", *[F.lit(None).cast("double").alias(c) for c in M9])
    return _solve(sums, finish, keys).unionByName(few)


def refined_homography(matches: DataFrame, models: DataFrame, threshold: float = 3.0) -> DataFrame:
    """(pair_id, n, m0..m8): the least squares homography over each pair's inliers."""
    inliers = with_models(matches, models.where("m0 IS NOT NULL")).where(residual("homography") <= threshold)
    return homography_fit(inliers.drop(*M9))
