"""Queries of the co-registration operators over whole tables, each with the SQL that gives the same rows."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.scalars import condition_number, invert3, matmul3, plausible, r6
from ..operators import features, illumination, images, points, rules, stencil
from ..sources.shared import Folder
from . import fits, tables as t
from .registry import ORACLE_SQL, QUERIES, query

R6 = t.sql_r6
PIXELS = "SELECT y, x, " + R6("v") + " AS v FROM {}"


def pixels(px: DataFrame) -> DataFrame:
    return px.select("y", "x", r6("v").alias("v"))


# Matching

DESCRIPTORS = "d AS (SELECT vec_id AS idx, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)"


def _descriptors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Even rows are sources, odd rows references."""
    d = t.table(spark, sf_dir, "embeddings").select(F.lit("p").alias("pair_id"), F.col("vec_id").alias("idx"), F.col("embedding").cast("array<double>").alias("descriptor"))
    return d.where("idx % 2 = 0"), d.where("idx % 2 = 1")


@query(f"""WITH {DESCRIPTORS}, p AS (SELECT s.idx AS source_idx, r.idx AS reference_idx, list_distance(s.e, r.e) AS distance FROM d s, d r WHERE s.idx % 2 = 0 AND r.idx % 2 = 1),
k AS (SELECT *, row_number() OVER w AS k, lead(distance) OVER w AS second FROM p WINDOW w AS (PARTITION BY source_idx ORDER BY distance, reference_idx))
SELECT source_idx, reference_idx, {R6('1 - distance / (second + 1e-8)')} AS confidence FROM k WHERE k = 1 AND distance < 0.95 * second""")
def match_ratio_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    return points.ratio_match(*_descriptors(spark, sf_dir), ratio=0.95).select("source_idx", "reference_idx", r6("confidence").alias("confidence"))


@query(f"""WITH {DESCRIPTORS} SELECT s.idx AS source_idx, r.idx AS reference_idx, {R6('1 / (1 + list_distance(s.e, r.e))')} AS confidence
FROM d s, d r WHERE r.idx = (SELECT min(idx) FROM d) AND s.idx <> r.idx""")
def match_single_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _descriptors(spark, sf_dir)
    every = a.unionByName(b)
    first = every.groupBy("pair_id").agg(F.min("idx").alias("first"))
    split = every.join(F.broadcast(first), "pair_id")
    found = points.ratio_match(split.where("idx <> first").drop("first"), split.where("idx = first").drop("first"))
    return found.select("source_idx", "reference_idx", r6("confidence").alias("confidence"))


BITS = "d AS (SELECT vec_id AS idx, array_to_string(list_transform(embedding, lambda x: CASE WHEN x > 0 THEN '1' ELSE '0' END), '')::BIT AS e FROM embeddings)"


@query(f"""WITH {BITS}, p AS (SELECT s.idx AS source_idx, r.idx AS reference_idx, CAST(bit_count(xor(s.e, r.e)) AS DOUBLE) AS distance FROM d s, d r WHERE s.idx % 2 = 0 AND r.idx % 2 = 1),
k AS (SELECT *, row_number() OVER w AS k, lead(distance) OVER w AS second FROM p WINDOW w AS (PARTITION BY source_idx ORDER BY distance, reference_idx))
SELECT source_idx, reference_idx, distance, {R6('1 - distance / (second + 1e-8)')} AS confidence FROM k WHERE k = 1 AND distance < 0.9 * second""")
def match_norm_hamming(spark: SparkSession, sf_dir: str) -> DataFrame:
    bit = lambda e: F.aggregate(e, F.lit(0).cast("long"), lambda a, x: F.shiftleft(a, 1) + F.when(x > 0, 1).otherwise(0))
    a, b = (d.withColumn("descriptor", bit(F.col("descriptor"))) for d in _descriptors(spark, sf_dir))
    return points.ratio_match(a, b, ratio=0.9, norm="hamming").select("source_idx", "reference_idx", "distance", r6("confidence").alias("confidence"))


@query(f"""WITH {t.SQL_TIES} SELECT pair_id, idx, row_number() OVER (PARTITION BY pair_id ORDER BY idx, sx, sy) - 1 AS ordinal, {R6('sx / 0.5')} AS sx, {R6('ry / 0.25')} AS ry, {R6('confidence')} AS confidence FROM ties WHERE confidence >= 0.945""")
def match_threshold_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    matches = t.ties(spark, sf_dir).withColumn("order", F.struct("idx", "sx", "sy"))
    kept = points.rescale(points.keep_confident(matches, 0.945, "order"), 0.5, 0.25)
    return kept.select("pair_id", "idx", F.col("ordinal").cast("long").alias("ordinal"), r6("sx").alias("sx"), r6("ry").alias("ry"), r6("confidence").alias("confidence"))


# Pyramid levels: parts as image pairs

SQL_PAIRS = "prs AS (SELECT p_partkey AS pair_id, CAST(p_size AS DOUBLE) AS s_res, p_retailprice / 50 AS r_res FROM part)"
SQL_LEVELS = f"""{SQL_PAIRS}, l AS (SELECT CAST(unnest(range(5)) AS BIGINT) AS k),
x AS (SELECT pair_id, r.k AS r_level, s.k AS s_level, s_res / pow(0.5, s.k) AS s_eff, r_res / pow(0.5, r.k) AS r_eff FROM prs, l r, l s),
b AS (SELECT *, row_number() OVER (PARTITION BY pair_id, r_level ORDER BY abs(s_eff - r_eff), s_level) AS n FROM x),
lv AS (SELECT pair_id, r_level, s_level FROM b WHERE n = 1 AND greatest(s_eff, r_eff) / least(s_eff, r_eff) < 2)"""


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("pair_id"), F.col("p_size").cast("double").alias("s_res"), (F.col("p_retailprice") / 50).alias("r_res"))


@query(f"WITH {SQL_LEVELS} SELECT * FROM lv")
def pyramid_level_pairing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.level_pairs(_pairs(spark, sf_dir)).select("pair_id", F.col("r_level").cast("long").alias("r_level"), F.col("s_level").cast("long").alias("s_level"))


@query(f"""WITH {SQL_LEVELS}, pk AS (SELECT *, row_number() OVER (PARTITION BY pair_id ORDER BY r_level + s_level, r_level) AS n FROM lv)
SELECT p.pair_id, CASE WHEN greatest(s_res, r_res) / (least(s_res, r_res) + 1e-8) > 1.2 THEN coalesce(s_level, 0) ELSE 0 END AS s_level,
CASE WHEN greatest(s_res, r_res) / (least(s_res, r_res) + 1e-8) > 1.2 THEN coalesce(r_level, 0) ELSE 0 END AS r_level FROM prs p LEFT JOIN pk ON p.pair_id = pk.pair_id AND n = 1""")
def pyramid_level_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.level_pick(_pairs(spark, sf_dir)).select("pair_id", F.col("s_level").cast("long").alias("s_level"), F.col("r_level").cast("long").alias("r_level"))


@query(f"""WITH {SQL_PAIRS} SELECT pair_id, CASE WHEN greatest(s_res, r_res) / least(s_res, r_res) <= 1 THEN 1 ELSE CAST(ceil(round(ln(greatest(s_res, r_res) / least(s_res, r_res)) / ln(2.0), 12)) + 1 AS BIGINT) END AS levels FROM prs""")
def pyramid_levels_for_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir).select("pair_id", rules.levels_needed(F.col("s_res"), F.col("r_res")).alias("levels"))


# Names, tags, boxes

_PARTS = (("/en", "english"), ("example.net", "net"), ("on", "on"))
SQL_PART = "CASE WHEN contains({0}, '/en') THEN 'english' WHEN contains({0}, 'example.net') THEN 'net' WHEN contains({0}, 'on') THEN 'on' END"


@query(f"""SELECT page_id, coalesce({SQL_PART.format("lower(regexp_extract(url, '([^/]*)$', 1))")}, {SQL_PART.format("lower(coalesce(nullif(regexp_extract(url, '^(https):', 1), ''), url))")}, 'unknown') AS sensor FROM pages""")
def sensor_inference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.table(spark, sf_dir, "pages").select("page_id", rules.sensor(F.col("url"), F.regexp_extract("url", "^(https):", 1), F.col("url"), _PARTS).alias("sensor"))


@query("""SELECT page_id, coalesce(lower(regexp_extract(url || '.' || (ARRAY['tif','TIFF','txt','png','jp2.zip','img','Pds'])[1 + page_id % 7], '\\.([^./]+)$', 1)) IN ('tif','tiff','img','pds','jp2','png'), false) AS supported FROM pages""")
def format_allowlist(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = F.array(*[F.lit(x) for x in ("tif", "TIFF", "txt", "png", "jp2.zip", "img", "Pds")])
    return t.table(spark, sf_dir, "pages").select("page_id", F.coalesce(rules.supported(F.concat("url", F.lit("."), F.get(kinds, (F.col("page_id") % 7).cast("int")))), F.lit(False)).alias("supported"))


@query("""SELECT event_id, coalesce(try_cast(event_type AS DOUBLE), try_cast(props->>'$.k' AS DOUBLE), try_cast(props->>'$.ab' AS DOUBLE), value) AS number, coalesce(nullif(props->>'$.none', ''), nullif(event_type, 'view'), 'last') AS text FROM events""")
def tag_coalesce(spark: SparkSession, sf_dir: str) -> DataFrame:
    tag = lambda k: F.get_json_object("props", f"$.{k}")
    return t.table(spark, sf_dir, "events").select("event_id", rules.first_number([F.col("event_type"), tag("k"), tag("ab"), F.col("value").cast("string")]).alias("number"), rules.first_text([tag("none"), F.nullif("event_type", F.lit("view")), F.lit("last")]).alias("text"))


SQL_BOXES = """bx AS (SELECT o_orderkey AS id, o_orderstatus AS crs, CAST(o_custkey * 31 % 4000 AS DOUBLE) AS l, CAST(o_orderkey * 17 % 4000 AS DOUBLE) AS b, CAST(o_custkey * 31 % 4000 + 1 + o_orderkey % 40 AS DOUBLE) AS r, CAST(o_orderkey * 17 % 4000 + 1 + o_custkey % 40 AS DOUBLE) AS t FROM orders)"""


def _boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, o = F.col("o_custkey"), F.col("o_orderkey")
    box = {"left": c * 31 % 4000, "bottom": o * 17 % 4000, "right": c * 31 % 4000 + 1 + o % 40, "top": o * 17 % 4000 + 1 + c % 40}
    return t.table(spark, sf_dir, "orders").select(o.alias("id"), F.col("o_orderstatus").alias("crs"), *[v.cast("double").alias(k) for k, v in box.items()])


@query(f"""WITH {SQL_BOXES} SELECT p.id AS a_id, q.id AS b_id, greatest(p.l, q.l) AS "left", greatest(p.b, q.b) AS bottom, least(p.r, q.r) AS "right", least(p.t, q.t) AS top
FROM bx p JOIN bx q ON p.crs = q.crs AND p.id % 2 = 0 AND q.id % 2 = 1 AND least(p.r, q.r) > greatest(p.l, q.l) AND least(p.t, q.t) > greatest(p.b, q.b)""")
def bbox_overlap_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    boxes = _boxes(spark, sf_dir)
    return rules.overlap(boxes.where("id % 2 = 0"), boxes.where("id % 2 = 1"), 40.0)


_SIDE = "CASE WHEN o_orderkey % 199 = 0 THEN 4000 WHEN o_orderkey % 31 = 0 THEN 300 ELSE 1 + o_custkey % 20 END"
SQL_MIXED = f"""mb AS (SELECT o_orderkey AS id, o_orderstatus AS crs, o_custkey * 31 % 4000 AS l, o_orderkey * 17 % 4000 AS b, o_custkey * 31 % 4000 + {_SIDE} AS r, o_orderkey * 17 % 4000 + 1 + ({_SIDE}) // 2 AS t FROM orders)"""


@query(f"""WITH {SQL_MIXED} SELECT p.id AS a_id, q.id AS b_id, CAST(greatest(p.l, q.l) AS DOUBLE) AS "left", CAST(greatest(p.b, q.b) AS DOUBLE) AS bottom, CAST(least(p.r, q.r) AS DOUBLE) AS "right", CAST(least(p.t, q.t) AS DOUBLE) AS top
FROM mb p JOIN mb q ON p.crs = q.crs AND p.id % 2 = 0 AND q.id % 2 = 1 AND least(p.r, q.r) > greatest(p.l, q.l) AND least(p.t, q.t) > greatest(p.b, q.b)""")
def bbox_overlap_mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes with sides from 1 to 4000 in one table."""
    side = F.expr(_SIDE)
    l, b = F.col("o_custkey") * 31 % 4000, F.col("o_orderkey") * 17 % 4000
    box = {"left": l, "bottom": b, "right": l + side, "top": b + 1 + F.floor(side / 2)}
    boxes = t.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("crs"), *[v.cast("double").alias(k) for k, v in box.items()])
    return rules.overlap(boxes.where("id % 2 = 0"), boxes.where("id % 2 = 1"), 4.0)


SQL_CAP = """SELECT p_partkey, greatest(0, floor({0})) + greatest(0, floor((greatest(1, least(ceil({1}), {2} - greatest(0, floor({0})))) - 30) / 2)) AS {3}_off,
least(greatest(1, least(ceil({1}), {2} - greatest(0, floor({0})))), 30) AS {3}_size FROM part"""


@query(f"""SELECT a.p_partkey, CAST(row_off AS BIGINT) AS row_off, CAST(row_size AS BIGINT) AS h, CAST(col_off AS BIGINT) AS col_off, CAST(col_size AS BIGINT) AS w
FROM ({SQL_CAP.format('p_size / 7.0 - 2', 'p_retailprice / 30.0', '60', 'row')}) a JOIN ({SQL_CAP.format('p_retailprice / 50.0 - 5', 'p_size * 1.3', '50', 'col')}) b ON a.p_partkey = b.p_partkey""")
def capped_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    size, price = F.col("p_size").cast("double"), F.col("p_retailprice")
    window = rules.capped_window(size / 7.0 - 2, price / 50.0 - 5, price / 30.0, size * 1.3, F.lit(60), F.lit(50), 30)
    return t.table(spark, sf_dir, "part").select("p_partkey", *window).select("p_partkey", *[F.col(c).cast("long").alias(c) for c in ("row_off", "h", "col_off", "w")])


@query("""SELECT p_partkey, CAST(floor((p_size * 200 - least(p_size * 200, 4096)) / 2.0) AS BIGINT) AS row_off, CAST(floor((floor(p_retailprice * 5) - least(floor(p_retailprice * 5), 4096)) / 2.0) AS BIGINT) AS col_off,
CAST(least(p_size * 200, 4096) AS BIGINT) AS h, CAST(least(floor(p_retailprice * 5), 4096) AS BIGINT) AS w FROM part""")
def centre_crop(spark: SparkSession, sf_dir: str) -> DataFrame:
    crop = rules.centre_crop(F.col("p_size").cast("long") * 200, F.floor(F.col("p_retailprice") * 5))
    return t.table(spark, sf_dir, "part").select("p_partkey", *[c.cast("long").alias(n) for c, n in zip(crop, ("row_off", "col_off", "h", "w"))])


KINDS = ("xml", "LBL", "tif", "xml", "txt", "img")


@query(f"""WITH f AS (SELECT source, doc_id || '.' || (ARRAY{list(KINDS)!r})[1 + doc_id % 6] AS path, CASE WHEN contains(text, 'st') AND n_chars % 3 = 0 THEN 'Array_2D' ELSE '' END AS head FROM documents),
g AS (SELECT *, CASE WHEN lower(path) LIKE '%.xml' AND head <> '' THEN 0 WHEN lower(path) LIKE '%.lbl' THEN 1 WHEN lower(path) LIKE '%.xml' THEN 2 WHEN regexp_matches(lower(path), '\\.(tif|tiff|img)$') THEN 3 END AS rnk FROM f)
SELECT source, path, rnk FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY rnk, path) AS k FROM g WHERE rnk IS NOT NULL) z WHERE k = 1""")
def bundle_member_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.get(F.array(*[F.lit(k) for k in KINDS]), (F.col("doc_id") % 6).cast("int"))
    head = F.when(F.contains("text", F.lit("st")) & (F.col("n_chars") % 3 == 0), "Array_2D").otherwise("")
    files = t.table(spark, sf_dir, "documents").select("source", F.concat(F.col("doc_id").cast("string"), F.lit("."), kind).alias("path"), head.alias("head"))
    return rules.bundle_member(files, ["source"]).select("source", "path", F.col("rank").alias("rnk"))


_SHAPES = [(d, b, w) for d, b in rules.RAW_TYPES for w in rules.RAW_WIDTHS]


@query("""WITH s AS (SELECT p_partkey, (p_size * 256 + p_partkey % 3) * CAST(floor(p_retailprice / 10) AS BIGINT) AS size FROM part),
w(ord, dtype, bytes, width) AS (VALUES """ + ", ".join(f"({k}, '{d}', {b}, {w})" for k, (d, b, w) in enumerate(_SHAPES)) + """),
c AS (SELECT p_partkey, dtype, size // bytes // width AS height, width, row_number() OVER (PARTITION BY p_partkey ORDER BY ord) AS k FROM s, w WHERE (size // bytes) % width = 0 AND size // bytes // width > 100 AND size // bytes // width < 1000000)
SELECT s.p_partkey, dtype, CAST(height AS BIGINT) AS height, CAST(width AS BIGINT) AS width FROM s LEFT JOIN c ON s.p_partkey = c.p_partkey AND k = 1""")
def raw_shape_guess(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = (F.col("p_size") * 256 + F.col("p_partkey") % 3) * F.floor(F.col("p_retailprice") / 10)
    return t.table(spark, sf_dir, "part").select("p_partkey", rules.raw_shape(size).alias("s")).select("p_partkey", "s.dtype", "s.height", F.col("s.width").cast("long").alias("width"))


# Illumination and stencils on the raster


@query(f"WITH {t.SQL_RASTER}, e AS (SELECT min(v) AS lo, max(v) AS hi FROM ras) SELECT y, x, {R6('CASE WHEN hi > lo THEN (v - lo) / (hi - lo) ELSE 0 END')} AS v FROM ras, e")
def minmax_stretch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pixels(illumination.stretch(t.raster(spark, sf_dir)))


@query("WITH e AS (SELECT event_type, min(value) AS lo, max(value) AS hi FROM events GROUP BY 1) SELECT event_id, CASE WHEN hi > lo THEN floor((value - lo) / (hi - lo) * 255) ELSE 0 END AS v FROM events JOIN e USING (event_type)")
def contrast_to_u8(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = t.table(spark, sf_dir, "events").select(F.col("event_type").alias("image"), "event_id", F.col("value").alias("v"))
    return illumination.contrast_to_u8(px).select("event_id", "v")


@query(f"""WITH {t.SQL_RASTER}, sq AS (SELECT y, x, v, v AS m, v * v AS s FROM ras), {t.sql_box('sq', 'bx', ['m', 's'], 31)}
SELECT r.y, r.x, {R6('(v - m) / (sqrt(greatest(s - m * m, 0)) + 1e-4)')} AS v FROM ras r JOIN bx ON r.y = bx.y AND r.x = bx.x""")
def lnms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pixels(stencil.local_normal(t.raster(spark, sf_dir)))


SQL_SOBEL = f"""two AS (SELECT y, x, v AS gx, v AS gy FROM ras), {t.sql_weighted('two', 'sx1', {'gx': [-1.0, 0.0, 1.0], 'gy': [1.0, 2.0, 1.0]}, 'x')}, {t.sql_weighted('sx1', 'sob', {'gx': [1.0, 2.0, 1.0], 'gy': [-1.0, 0.0, 1.0]}, 'y')}"""


@query(f"WITH {t.SQL_RASTER}, {SQL_SOBEL} SELECT y, x, {R6('CASE WHEN atan2(gy, gx) < 0 THEN atan2(gy, gx) + 2 * pi() ELSE atan2(gy, gx) END')} AS v FROM (SELECT y, x, gx + 0.0::DOUBLE AS gx, gy + 0.0::DOUBLE AS gy FROM sob) z")
def sobel_orientation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pixels(stencil.orientation(t.raster(spark, sf_dir)))


@query(f"WITH {t.SQL_RASTER}, {t.sql_separable('ras', 'g', ['v'], stencil.gaussian(7, 1.0))} {PIXELS.format('g')}")
def gaussian_blur(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pixels(stencil.separable(stencil.with_extents(t.raster(spark, sf_dir)), ["v"], stencil.gaussian(7, 1.0)))


@query(f"WITH {t.SQL_RASTER}, {t.sql_separable('ras', 'g', ['v'], stencil.gaussian(7, 1.0))} SELECT y // 2 AS y, x // 2 AS x, {R6('avg(v)')} AS v FROM g, ext WHERE y < 2 * (h // 2) AND x < 2 * (w // 2) GROUP BY 1, 2")
def pyramid_half(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pixels(stencil.half(t.raster(spark, sf_dir)))


def _sql_shares(at: str, size: str, name: str) -> str:
    """name(at, i, wt): the parts of rows or columns in those of a raster of 0.6 times the size."""
    parts = f"SELECT {at}, {size} AS size, {at} * n AS lo, ({at} + 1) * n AS hi, {at} * n // {size} + k AS i FROM (SELECT DISTINCT {at} FROM ras) p, (SELECT {size}, greatest(1, CAST(round_even({size} * 0.6, 0) AS BIGINT)) AS n FROM ext) e, (VALUES (0), (1)) o(k)"
    return f"{name} AS (SELECT {at}, i, (least(hi, (i + 1) * size) - greatest(lo, i * size)) / size AS wt FROM ({parts}) z WHERE least(hi, (i + 1) * size) > greatest(lo, i * size))"


@query(f"""WITH {t.SQL_RASTER}, {t.sql_separable('ras', 'g', ['v'], stencil.gaussian(7, 1 / 1.2))}, {_sql_shares('y', 'h', 'sy')}, {_sql_shares('x', 'w', 'sx')}
SELECT sy.i AS y, sx.i AS x, {R6('sum(sy.wt * sx.wt * v)')} AS v FROM g JOIN sy ON g.y = sy.y JOIN sx ON g.x = sx.x GROUP BY 1, 2""")
def pyramid_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pixels(stencil.shrink(t.raster(spark, sf_dir), 0.6))


@query(f"""WITH {t.SQL_RASTER}, c AS (SELECT v, count(*) AS c FROM ras GROUP BY 1), r AS (SELECT v, sum(c) OVER (ORDER BY v) AS cdf FROM c), f AS (SELECT min(cdf) AS base, max(cdf) AS n FROM r)
SELECT y, x, CASE WHEN n > base THEN round_even((cdf - base) * 255.0::DOUBLE / (n - base), 0) ELSE ras.v END AS v FROM ras JOIN r ON ras.v = r.v, f""")
def hist_equalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return illumination.equalize(t.raster(spark, sf_dir)).select("y", "x", "v")


#: The tables of the 8 x 8 cells of a raster ``src`` of whole values 0..255.
SQL_CELLS = """c AS (SELECT y * 8 // h AS ty, x * 8 // w AS tx, v, count(*) AS c FROM src, ext GROUP BY 1, 2, 3),
a AS (SELECT ty, tx, CAST(sum(c) AS BIGINT) AS n FROM c GROUP BY 1, 2), m AS (SELECT *, greatest(CAST(floor(2.0 * n / 256) AS BIGINT), 1) AS most FROM a),
s AS (SELECT m.ty, m.tx, n, most, CAST(sum(greatest(c - most, 0)) AS BIGINT) AS spill FROM m JOIN c ON m.ty = c.ty AND m.tx = c.tx GROUP BY 1, 2, 3, 4),
e AS (SELECT s.*, CAST(u.i AS DOUBLE) AS v FROM s, (SELECT unnest(range(256)) AS i) u),
l AS (SELECT e.ty, e.tx, e.v, n, least(coalesce(c, 0), most) + spill // 256 + CASE WHEN e.v % greatest(256 // greatest(spill % 256, 1), 1) = 0 AND e.v / greatest(256 // greatest(spill % 256, 1), 1) < spill % 256 THEN 1 ELSE 0 END AS lev FROM e LEFT JOIN c ON e.ty = c.ty AND e.tx = c.tx AND e.v = c.v),
lut AS (SELECT ty, tx, v, least(round_even(sum(lev) OVER (PARTITION BY ty, tx ORDER BY v) * 255.0::DOUBLE / n, 0), 255) AS mapped FROM l)"""


@query(f"WITH {t.SQL_RASTER}, src AS (SELECT * FROM ras), {SQL_CELLS} SELECT ty, tx, v, mapped FROM lut")
def clahe_lut(spark: SparkSession, sf_dir: str) -> DataFrame:
    return illumination.clahe_tables(t.raster(spark, sf_dir)).select("ty", "tx", "v", "mapped")


@query(f"""WITH {t.SQL_RASTER}, m AS (SELECT min(v) AS lo, max(v) AS hi FROM ras), src AS (SELECT y, x, CASE WHEN hi > lo THEN floor((v - lo) / (hi - lo) * 255) ELSE 0 END AS v FROM ras, m), {SQL_CELLS.replace("m AS (", "mo AS (").replace("FROM m JOIN", "FROM mo m JOIN")},
f AS (SELECT y, x, v, y * 8 / CAST(h AS DOUBLE) - 0.5 AS fy, x * 8 / CAST(w AS DOUBLE) - 0.5 AS fx FROM src, ext),
p AS (SELECT y, x, v, least(greatest(floor(fy) + dy, 0), 7) AS ty, least(greatest(floor(fx) + dx, 0), 7) AS tx,
  CASE WHEN dy = 0 THEN 1 - (fy - floor(fy)) ELSE fy - floor(fy) END * CASE WHEN dx = 0 THEN 1 - (fx - floor(fx)) ELSE fx - floor(fx) END AS wt FROM f, (SELECT unnest([0, 1]) AS dy) a, (SELECT unnest([0, 1]) AS dx) b)
SELECT y, x, {R6('round_even(round(sum(wt * mapped), 6), 0)')} AS v FROM p JOIN lut ON p.ty = lut.ty AND p.tx = lut.tx AND p.v = lut.v GROUP BY 1, 2""")
def clahe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pixels(illumination.clahe(t.raster(spark, sf_dir)))


@query()
def phase_congruency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pixels(illumination.phase_congruency(t.raster(spark, sf_dir)))


@query()
def phase_congruency_tiled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pixels(illumination.phase_congruency(t.raster(spark, sf_dir), tile=96, overlap=16))


@query(f"""WITH {t.SQL_RASTER}, a AS (SELECT y, x, v, max(v) OVER (PARTITION BY y ORDER BY x ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING) AS m FROM ras),
b AS (SELECT y, x, v, max(m) OVER (PARTITION BY x ORDER BY y ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING) AS m FROM a) SELECT y, x, v FROM b WHERE v = m AND v >= 0.005""")
def nms_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stencil.local_peaks(t.raster(spark, sf_dir)).select("y", "x", "v")


@query(f"WITH {t.SQL_RASTER} SELECT kp_idx, y, x, v FROM (SELECT y, x, v, row_number() OVER (ORDER BY v DESC, y, x) - 1 AS kp_idx FROM ras) z WHERE kp_idx < 100")
def topk_keypoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stencil.top_peaks(t.raster(spark, sf_dir), 100).select(F.col("kp_idx").cast("long").alias("kp_idx"), "y", "x", "v")


SQL_TAPS = " + ".join(f"({'fx' if i else '(1 - fx)'} * {'fy' if j else '(1 - fy)'} * coalesce(r{i}{j}.v, 0))" for j in (0, 1) for i in (0, 1))


@query(f"""WITH {t.SQL_RASTER}, p AS (SELECT event_id AS idx, (user_id % 640) / 10.0::DOUBLE AS px, value AS py FROM events), q AS (SELECT idx, CAST(floor(px) AS BIGINT) AS bx, CAST(floor(py) AS BIGINT) AS by_, px - floor(px) AS fx, py - floor(py) AS fy FROM p)
SELECT idx, {R6(SQL_TAPS)} AS v FROM q """ + " ".join(f"LEFT JOIN ras r{i}{j} ON r{i}{j}.x = bx + {i} AND r{i}{j}.y = by_ + {j}" for j in (0, 1) for i in (0, 1)))
def descriptor_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    pts = t.table(spark, sf_dir, "events").select(F.lit("s").alias("image"), F.col("event_id").alias("idx"), ((F.col("user_id") % 640) / 10.0).alias("x"), F.col("value").alias("y"))
    return images.sample(t.raster(spark, sf_dir), pts).select("idx", r6("v").alias("v"))




@query(f"""WITH {t.SQL_RASTER}, l AS (SELECT y, x, pow(least(greatest(v / 255 * (0.5::DOUBLE + 1.0::DOUBLE * (x / (w - 1.0::DOUBLE))), 0), 1), 1.2::DOUBLE) AS f, x / (w - 1.0::DOUBLE) AS p FROM ras, ext)
SELECT y, x, floor(round(least(greatest(f + (-0.12::DOUBLE + 0.12::DOUBLE * p), 0), 1) * 255, 9)) AS v FROM l""")
def sun_ramp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return illumination.sun_ramp(t.raster(spark, sf_dir), 45.0).select("y", "x", "v")


# Point scores

SQL_CELLS = f"{t.SQL_EVENTS}, c AS (SELECT image, least(greatest(floor(y * 8 / 500), 0), 7) AS cy, least(greatest(floor(x * 8 / 1000), 0), 7) AS cx, count(*) AS c FROM pts GROUP BY 1, 2, 3)"


@query(f"WITH {SQL_CELLS} SELECT image, {R6('greatest(0, 1 - sqrt(greatest(sum(c * c) / 64.0::DOUBLE - pow(sum(c) / 64.0::DOUBLE, 2), 0)) / (sum(c) / 64.0::DOUBLE))')} AS uniformity FROM c GROUP BY 1")
def keypoint_uniformity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return points.uniformity(t.events(spark, sf_dir), 1000, 500).select("image", r6("uniformity").alias("uniformity"))


@query(f"WITH {SQL_CELLS} SELECT image, {R6('count(*) / 64.0::DOUBLE')} AS occupancy FROM c GROUP BY 1")
def occupancy_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return points.occupancy(t.events(spark, sf_dir), 1000, 500).select("image", r6("occupancy").alias("occupancy"))


@query(f"WITH {SQL_CELLS} SELECT image, count(*) AS cells FROM c GROUP BY 1")
def cell_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return points.occupancy(t.events(spark, sf_dir), 1000, 500).select("image", F.rint(F.col("occupancy") * 64).cast("long").alias("cells"))


@query(f"WITH {t.SQL_EVENTS} SELECT a.image, a.idx FROM pts a WHERE a.idx % 2 = 0 AND EXISTS (SELECT 1 FROM pts b WHERE b.idx % 2 = 1 AND a.image = b.image AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) < 36)")
def repeatability_range_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    pts = t.events(spark, sf_dir)
    return points.repeatable(pts.where("idx % 2 = 0"), pts.where("idx % 2 = 1")).select("image", "idx")


# Transforms


@query(f"WITH {t.SQL_TIES} SELECT pair_id, CASE WHEN greatest(max(sx) - min(sx), max(sy) - min(sy)) >= 1015 THEN 'projective' ELSE 'affine' END AS model FROM ties GROUP BY 1")
def auto_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return points.auto_model(t.ties(spark, sf_dir), 1015.0)


SQL_FIT = t.SQL_FIT
SQL_RES = "sqrt(pow(m0 * sx + m1 * sy + m2 - rx, 2) + pow(m3 * sx + m4 * sy + m5 - ry, 2))"
M6 = [f"m{k}" for k in range(6)]


@query(f"WITH {t.SQL_TIES}, {SQL_FIT.format('ties')} SELECT pair_id, n, {', '.join(f'{R6(m)} AS {m}' for m in M6)} FROM fit")
def affine_lsq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return points.affine_fit(t.ties(spark, sf_dir)).select("pair_id", "n", *[r6(m).alias(m) for m in M6])


@query(f"WITH {t.SQL_TIES}, {SQL_FIT.format('ties')} SELECT pair_id, {R6(f'sqrt(avg(pow({SQL_RES}, 2)))')} AS rmse, {R6(f'max({SQL_RES})')} AS worst FROM ties JOIN fit USING (pair_id) GROUP BY 1")
def residual_rmse(spark: SparkSession, sf_dir: str) -> DataFrame:
    ties = t.ties(spark, sf_dir)
    left = points.residuals(ties, points.affine_fit(ties))
    return left.groupBy("pair_id").agg(r6(F.sqrt(F.avg(F.col("residual") ** 2))).alias("rmse"), r6(F.max("residual")).alias("worst"))


SQL_SV = """sv AS (SELECT pair_id, m0, m1, m3, m4, sqrt(pow((m0 + m4) / 2, 2) + pow((m3 - m1) / 2, 2)) + sqrt(pow((m0 - m4) / 2, 2) + pow((m3 + m1) / 2, 2)) AS hi,
  abs(sqrt(pow((m0 + m4) / 2, 2) + pow((m3 - m1) / 2, 2)) - sqrt(pow((m0 - m4) / 2, 2) + pow((m3 + m1) / 2, 2))) AS lo FROM fit)"""
LINEAR = ("m0", "m1", "m3", "m4")


@query(f"WITH {t.SQL_TIES}, {SQL_FIT.format('ties')}, {SQL_SV} SELECT pair_id, {R6('hi / (lo + 1e-8)')} AS cond FROM sv")
def transform_condition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return points.affine_fit(t.ties(spark, sf_dir)).select("pair_id", r6(condition_number(*map(F.col, LINEAR))).alias("cond"))


@query(f"WITH {t.SQL_TIES}, {SQL_FIT.format('ties')}, {SQL_SV} SELECT pair_id, m0 * m4 - m1 * m3 > 0 AND hi <= 20 AND lo >= 0.05 AND hi / (lo + 1e-8) <= 50 AS plausible FROM sv")
def plausibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    return points.affine_fit(t.ties(spark, sf_dir)).select("pair_id", plausible(*map(F.col, LINEAR)).alias("plausible"))


def _matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("p_size").cast("double")
    m = F.array(1 + size / 100, size / 200, F.col("p_retailprice") / 10, -size / 300, 1.1 + size / 90, size, size * 1e-5, -size * 2e-5, F.lit(1.0))
    return t.table(spark, sf_dir, "part").select("p_partkey", m.alias("m"))


def _sql_inverse(m: list[str]) -> list[str]:
    at = lambda i, j: m[3 * (i % 3) + j % 3]
    cof = lambda i, j: f"({at(i + 1, j + 1)} * {at(i + 2, j + 2)} - {at(i + 1, j + 2)} * {at(i + 2, j + 1)})"
    det = "(" + " + ".join(f"{at(0, j)} * {cof(0, j)}" for j in range(3)) + ")"
    return [f"({cof(j, i)} / {det})" for i in range(3) for j in range(3)]


SQL_MATRIX = """mx AS (SELECT p_partkey, 1 + s / 100 AS a0, s / 200 AS a1, p_retailprice / 10 AS a2, -s / 300 AS a3, 1.1::DOUBLE + s / 90 AS a4, s AS a5, s * 1e-5::DOUBLE AS a6, -s * 2e-5::DOUBLE AS a7, 1.0::DOUBLE AS a8 FROM (SELECT *, CAST(p_size AS DOUBLE) AS s FROM part) q)"""
_A = [f"a{k}" for k in range(9)]


@query(f"""WITH {SQL_MATRIX}, iv AS (SELECT *, {', '.join(f'{e} AS i{k}' for k, e in enumerate(_sql_inverse(_A)))} FROM mx)
SELECT p_partkey, {R6('i0')} AS i0, {R6('i2')} AS i2, {R6('i7')} AS i7, {R6('a0 * i0 + a1 * i3 + a2 * i6')} AS one, {R6('a0 * i1 + a1 * i4 + a2 * i7')} AS zero FROM iv""")
def matrix_compose_invert(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = _matrix(spark, sf_dir).withColumn("i", invert3("m")).withColumn("p", matmul3("m", "i"))
    at = lambda m, k: r6(F.get(m, F.lit(k)))
    return both.select("p_partkey", at("i", 0).alias("i0"), at("i", 2).alias("i2"), at("i", 7).alias("i7"), at("p", 0).alias("one"), at("p", 1).alias("zero"))


SQL_GRID = "gr AS (SELECT pair_id, 1024 * (0.1::DOUBLE + i * 0.1::DOUBLE) AS x, 1024 * (0.1::DOUBLE + j * 0.1::DOUBLE) AS y, fit.* EXCLUDE (pair_id) FROM fit, (SELECT unnest(range(9)) AS i) a, (SELECT unnest(range(9)) AS j) b)"
SQL_ERROR = "sqrt(pow((m0 - 0.98::DOUBLE) * x + (m1 + 0.12::DOUBLE) * y + m2 - 15, 2) + pow((m3 - 0.11::DOUBLE) * x + (m4 - 1.02::DOUBLE) * y + m5 + 10, 2))"


@query(f"WITH {t.SQL_TIES}, {SQL_FIT.format('ties')}, {SQL_GRID} SELECT pair_id, {R6(f'avg({SQL_ERROR})')} AS mean_error, {R6(f'max({SQL_ERROR})')} AS max_error FROM gr GROUP BY 1")
def grid_point_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fitted affine against the true one on a 9 x 9 grid."""
    step = F.sequence(F.lit(0), F.lit(8))
    g = points.affine_fit(t.ties(spark, sf_dir)).withColumn("i", F.explode(step)).withColumn("j", F.explode(step))
    x, y = 1024 * (0.1 + F.col("i") * 0.1), 1024 * (0.1 + F.col("j") * 0.1)
    ex = (F.col("m0") - 0.98) * x + (F.col("m1") + 0.12) * y + F.col("m2") - 15
    ey = (F.col("m3") - 0.11) * x + (F.col("m4") - 1.02) * y + F.col("m5") + 10
    error = F.sqrt(ex * ex + ey * ey)
    return g.groupBy("pair_id").agg(r6(F.avg(error)).alias("mean_error"), r6(F.max(error)).alias("max_error"))


# Sub-pixel refinement: the raster against itself, rolled by one row and two columns

PATCH, SEARCH = 7, 3
SQL_NCC = f"""{t.SQL_RASTER}, rol AS (SELECT (y + 1) % h AS y, (x + 2) % w AS x, v FROM ras, ext),
mt AS (SELECT y AS idx, 20 + (y * 7) % 24 AS ix, y AS iy, 21 + (y * 7) % 24 AS jx, y AS jy FROM (SELECT DISTINCT y FROM ras) q),
mi AS (SELECT mt.* FROM mt, ext WHERE ix >= 3 AND ix < w - 3 AND iy >= 3 AND iy < h - 3 AND jx >= 6 AND jx < w - 6 AND jy >= 6 AND jy < h - 6),
fl AS (SELECT idx FROM mi JOIN rol ON rol.x BETWEEN jx - 6 AND jx + 6 AND rol.y BETWEEN jy - 6 AND jy + 6 GROUP BY 1 HAVING stddev_pop(v) >= 1e-4),
pt AS (SELECT mi.*, ras.y - iy AS py, ras.x - ix AS px, v AS a FROM mi JOIN fl USING (idx) JOIN ras ON ras.x BETWEEN ix - 3 AND ix + 3 AND ras.y BETWEEN iy - 3 AND iy + 3),
of AS (SELECT CAST(unnest(range(-3, 4)) AS BIGINT) AS o), pr AS (SELECT pt.*, dy.o AS dy, dx.o AS dx FROM pt, of dy, of dx),
nc AS (SELECT idx, jx, jy, dy, dx, stddev_pop(a) AS sa, CASE WHEN stddev_pop(b.v) > 0 THEN covar_pop(a, b.v) / (stddev_pop(a) * stddev_pop(b.v)) ELSE 0 END AS ncc FROM pr JOIN rol b ON b.y = jy + py + dy AND b.x = jx + px + dx GROUP BY 1, 2, 3, 4, 5 HAVING stddev_pop(a) >= 1e-4)"""


def _maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = t.raster(spark, sf_dir)
    x = 20 + (F.col("y") * 7) % 24
    matches = px.select("image", "y").distinct().select("image", F.col("y").alias("idx"), (x + 0.3).alias("sx"), (F.col("y") + 0.2).alias("sy"), (x + 1.3).alias("rx"), (F.col("y") + 0.2).alias("ry"))
    return images.ncc_map(px, t.rolled(px), matches, PATCH, SEARCH)


@query(f"WITH {SQL_NCC} SELECT idx, dy, dx, {R6('ncc')} AS ncc FROM nc")
def ncc_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _maps(spark, sf_dir).select("idx", F.col("dy").cast("long").alias("dy"), F.col("dx").cast("long").alias("dx"), r6("ncc").alias("ncc"))


SQL_REFINED = f"""{SQL_NCC}, nb AS (SELECT *, lag(ncc) OVER a AS l, lead(ncc) OVER a AS r, lag(ncc) OVER d AS u, lead(ncc) OVER d AS dn FROM nc WINDOW a AS (PARTITION BY idx, dy ORDER BY dx), d AS (PARTITION BY idx, dx ORDER BY dy)),
pk AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY idx ORDER BY round(ncc, 9) DESC, dy, dx) AS k FROM nb) z WHERE k = 1 AND ncc >= 0.7),
rf AS (SELECT idx, ncc, jx + dx + CASE WHEN abs(dx) < 3 AND abs(2 * ncc - l - r) > 1e-5 THEN (r - l) / (2 * (2 * ncc - l - r)) ELSE 0 END AS rx, jy + dy + CASE WHEN abs(dy) < 3 AND abs(2 * ncc - u - dn) > 1e-5 THEN (dn - u) / (2 * (2 * ncc - u - dn)) ELSE 0 END AS ry, 0.05 * (1 - ncc) + 0.01 AS accuracy FROM pk)"""


@query(f"WITH {SQL_REFINED} SELECT idx, {R6('rx')} AS rx, {R6('ry')} AS ry, {R6('ncc')} AS ncc FROM rf")
def subpixel_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return images.refine(_maps(spark, sf_dir), 0.7, SEARCH).select("idx", r6("rx").alias("rx"), r6("ry").alias("ry"), r6("ncc").alias("ncc"))


@query(f"WITH {SQL_REFINED} SELECT count(*) AS n, {R6('avg(accuracy)')} AS mean_accuracy, {R6('median(accuracy)')} AS median_accuracy FROM rf")
def refine_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    refined = images.refine(_maps(spark, sf_dir), 0.7, SEARCH)
    n = refined.groupBy("image").agg(F.count("*").alias("n"))
    return n.join(images.accuracy(refined), "image").select("n", r6("mean_accuracy").alias("mean_accuracy"), r6("median_accuracy").alias("median_accuracy"))


# Warping, blending, quality

MATRIX = (1.01, 0.02, 3.3, -0.015, 0.99, 1.7, 0.0, 0.0, 1.0)


def _inverse() -> list[float]:
    import numpy as np

    return np.linalg.inv(np.array(MATRIX).reshape(3, 3)).ravel().tolist()


def _sql_warp(method: str) -> str:
    i = [f"({v!r}::DOUBLE)" for v in _inverse()]
    base = (lambda c: f"round_even({c}, 0)") if method == "nearest" else (lambda c: f"floor({c})")
    a = images.BICUBIC
    near, far = (lambda s: f"((({a} + 2) * {s} - ({a} + 3)) * {s} * {s} + 1)"), (lambda s: f"((({a} * {s} - 5 * {a}) * {s} + 8 * {a}) * {s} - 4 * {a})")
    taps = {"nearest": lambda f: [(0, "1")], "bilinear": lambda f: [(0, f"(1 - {f})"), (1, f)], "bicubic": lambda f: [(-1, far(f"({f} + 1)")), (0, near(f)), (1, near(f"(1 - {f})")), (2, far(f"(2 - {f})"))],
            "lanczos": lambda f: [(k, f"(CASE WHEN abs({f} - {k}) < 1e-9 THEN 1 WHEN abs({f} - {k}) < 4 THEN sin(pi() * ({f} - {k})) / (pi() * ({f} - {k})) * sin(pi() * ({f} - {k}) / 4) / (pi() * ({f} - {k}) / 4) ELSE 0 END)") for k in range(-3, 5)]}[method]
    rows = " UNION ALL ".join(f"SELECT y, x, by_ + {dy} AS sy, bx + {dx} AS sx, CAST({wy} * {wx} AS DOUBLE) AS wt FROM q" for dy, wy in taps("fy") for dx, wx in taps("fx"))
    return f"""WITH {t.SQL_RASTER}, u AS (SELECT y, x, round(({i[0]} * x + {i[1]} * y + {i[2]}) / ({i[6]} * x + {i[7]} * y + {i[8]}), 9) AS u, round(({i[3]} * x + {i[4]} * y + {i[5]}) / ({i[6]} * x + {i[7]} * y + {i[8]}), 9) AS t FROM ras),
q AS (SELECT y, x, CAST({base('u')} AS BIGINT) AS bx, CAST({base('t')} AS BIGINT) AS by_, u - {base('u')} AS fx, t - {base('t')} AS fy FROM u), tp AS ({rows})
SELECT tp.y, tp.x, {R6('sum(wt * coalesce(ras.v, 7.0::DOUBLE))' + ' / sum(wt)' * (method == 'lanczos'))} AS v FROM tp LEFT JOIN ras ON ras.y = sy AND ras.x = sx GROUP BY 1, 2"""


def _warp(spark: SparkSession, sf_dir: str, method: str) -> DataFrame:
    px = t.raster(spark, sf_dir)
    height = px.agg(F.max("y")).first()[0] + 1
    return pixels(images.warp(px, MATRIX, height, t.WIDTH, method, 7.0))


@query(_sql_warp("nearest"))
def warp_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _warp(spark, sf_dir, "nearest")


@query(_sql_warp("bilinear"))
def warp_bilinear(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _warp(spark, sf_dir, "bilinear")


@query(_sql_warp("bicubic"))
def warp_bicubic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _warp(spark, sf_dir, "bicubic")


@query(_sql_warp("lanczos"))
def warp_lanczos(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _warp(spark, sf_dir, "lanczos")


def _blended(spark: SparkSession, sf_dir: str, mode: str) -> DataFrame:
    px = t.raster(spark, sf_dir).withColumn("v", F.greatest(F.col("v") - 110, F.lit(0.0)))
    return pixels(images.blend(px, t.mirrored(px), mode))


SQL_DIM = t.SQL_BOTH + ", dm AS (SELECT y, x, greatest(a - 110, 0) AS a, greatest(b - 110, 0) AS b FROM pairs)"


@query(f"WITH {SQL_DIM} SELECT y, x, {R6('CASE WHEN a > 0 THEN a ELSE b END')} AS v FROM dm")
def blend_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _blended(spark, sf_dir, "overlay")


@query(f"WITH {SQL_DIM} SELECT y, x, {R6('CASE WHEN a > 0 AND b > 0 THEN (a + b) / 2 WHEN a > 0 THEN a ELSE b END')} AS v FROM dm")
def blend_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _blended(spark, sf_dir, "average")


@query(f"WITH {SQL_DIM} SELECT y, x, {R6('CASE WHEN a > 0 AND b > 0 THEN abs(a - b) ELSE 0 END')} AS v FROM dm")
def blend_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _blended(spark, sf_dir, "difference")


def _aligned(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = t.raster(spark, sf_dir)
    return images.aligned(px, t.mirrored(px))


@query(f"WITH {t.SQL_BOTH} SELECT count(*) AS overlap, {R6('20 * log10(255 / sqrt(avg(pow(a - b, 2))))')} AS psnr FROM pairs WHERE a > 0 AND b > 0")
def psnr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return images.psnr(_aligned(spark, sf_dir)).select("overlap", r6("psnr").alias("psnr"))


SQL_SSIM = f"""{t.SQL_BOTH}, mm AS (SELECT y, x, a AS ma, b AS mb, a * a AS saa, b * b AS sbb, a * b AS sab FROM pairs), {t.sql_separable('mm', 'gs', ['ma', 'mb', 'saa', 'sbb', 'sab'], stencil.gaussian(11, 1.5))},
ss AS (SELECT least(greatest(avg(((2 * ma * mb + 6.5025::DOUBLE) * (2 * (sab - ma * mb) + 58.5225::DOUBLE)) / ((ma * ma + mb * mb + 6.5025::DOUBLE) * (greatest(saa - ma * ma, 0) + greatest(sbb - mb * mb, 0) + 58.5225::DOUBLE))), 0), 1) AS ssim FROM gs JOIN pairs USING (y, x) WHERE a > 0 AND b > 0)"""


@query(f"WITH {SQL_SSIM} SELECT {R6('ssim')} AS ssim FROM ss")
def ssim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return images.ssim(_aligned(spark, sf_dir)).select(r6("ssim").alias("ssim"))


def _sql_nmi(rows: str) -> str:
    return f"""ev AS (SELECT image, min(a) AS la, max(a) AS ha, min(b) AS lb, max(b) AS hb FROM {rows} GROUP BY 1),
hc AS (SELECT r.image, CASE WHEN ha > la THEN least(31, floor((a - la) / (ha - la) * 32)) ELSE 16 END AS ba, CASE WHEN hb > lb THEN least(31, floor((b - lb) / (hb - lb) * 32)) ELSE 16 END AS bb, count(*) AS c FROM {rows} r JOIN ev ON r.image = ev.image GROUP BY 1, 2, 3),
hn AS (SELECT image, sum(c)::DOUBLE AS n FROM hc GROUP BY 1), ra AS (SELECT image, ba, sum(c)::DOUBLE AS c FROM hc GROUP BY 1, 2), rb AS (SELECT image, bb, sum(c)::DOUBLE AS c FROM hc GROUP BY 1, 2),
xa AS (SELECT image, -sum(c / n * log2(c / n + 1e-12)) AS e FROM ra JOIN hn USING (image) GROUP BY 1), xb AS (SELECT image, -sum(c / n * log2(c / n + 1e-12)) AS e FROM rb JOIN hn USING (image) GROUP BY 1), xj AS (SELECT image, -sum(c / n * log2(c / n + 1e-12)) AS e FROM hc JOIN hn USING (image) GROUP BY 1),
nm AS (SELECT xa.image, least(greatest(2 * (xa.e + xb.e - xj.e) / (xa.e + xb.e + 1e-12), 0), 1) AS nmi FROM xa JOIN xb ON xa.image = xb.image JOIN xj ON xa.image = xj.image)"""


@query(f"WITH li AS (SELECT l_returnflag AS image, l_quantity AS a, l_extendedprice AS b FROM lineitem), {_sql_nmi('li')} SELECT image, {R6('nmi')} AS nmi FROM nm")
def nmi(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = t.table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("image"), F.col("l_quantity").alias("a"), F.col("l_extendedprice").alias("b"))
    return images.nmi(values).select("image", r6("nmi").alias("nmi"))


@query(f"WITH {SQL_SSIM}, pi AS (SELECT 's' AS image, a, b FROM pairs WHERE a > 0 AND b > 0), {_sql_nmi('pi')} SELECT {R6('least(greatest(0.4 * ssim + 0.4 * nmi + 0.2 * 0.75, 0), 1)')} AS q FROM ss, nm")
def q_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = _aligned(spark, sf_dir)
    parts = images.ssim(both).join(images.nmi(both.where("a > 0 and b > 0").select("image", "a", "b")), "image")
    return parts.select(r6(points.q_score(F.col("ssim"), F.col("nmi"), F.lit(0.75))).alias("q"))


@query(f"WITH {t.SQL_TIES} SELECT pair_id, {R6('count(*) FILTER (confidence >= 0.93) / count(*)::DOUBLE')} AS inlier_ratio FROM ties GROUP BY 1")
def inlier_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.ties(spark, sf_dir).groupBy("pair_id").agg(r6(F.coalesce(F.try_divide(F.count_if(F.col("confidence") >= 0.93).cast("double"), F.count("*")), F.lit(0.0))).alias("inlier_ratio"))


# Exports and jobs


@query(f"""WITH {t.SQL_TIES} SELECT pair_id, (row_number() OVER (PARTITION BY pair_id ORDER BY idx, sx, sy) - 1) || ',' || printf('%.3f', sx) || ',' || printf('%.3f', sy) || ',' || printf('%.4f', confidence) AS line FROM ties""")
def export_csv_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..sources.sinks import csv_lines

    rows = t.ties(spark, sf_dir).withColumn("order", F.struct("idx", "sx", "sy"))
    return csv_lines(rows, "order", [("sx", 3), ("sy", 3), ("confidence", 4)]).select("pair_id", "line")


@query(f"""WITH {t.SQL_TIES} SELECT pair_id, idx, 'Point' AS kind, {R6('32.5::DOUBLE + 0.0001::DOUBLE * (rx + 0.5)')} AS lon, {R6('-69.5::DOUBLE - 0.0001::DOUBLE * (ry + 0.5)')} AS lat,
  {R6('sx')} AS source_x, {R6('ry')} AS reference_y, {R6('confidence')} AS confidence FROM ties""")
def export_geojson(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The features' parts, read back from their GeoJSON text."""
    from ..sources.sinks import geojson_features

    found = geojson_features(t.ties(spark, sf_dir), (32.5, 0.0001, 0.0, -69.5, 0.0, -0.0001))
    kind = "struct<type:string,geometry:struct<type:string,coordinates:array<double>>,properties:struct<source_pixel:array<double>,reference_pixel:array<double>,confidence:double>>"
    f = found.select("pair_id", "idx", F.from_json("feature", kind).alias("f"))
    number = lambda c, i: r6(F.get(c, F.lit(i)))
    return f.select("pair_id", "idx", F.col("f.geometry.type").alias("kind"), number("f.geometry.coordinates", 0).alias("lon"), number("f.geometry.coordinates", 1).alias("lat"), number("f.properties.source_pixel", 0).alias("source_x"), number("f.properties.reference_pixel", 1).alias("reference_y"), r6("f.properties.confidence").alias("confidence"))


@query(f"WITH {t.SQL_RASTER} {PIXELS.format('ras')}")
def raster_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The raster written as a GeoTIFF by tiles of 48 pixels in many partitions, and read back by blocks of rows."""
    from ..sources import raster

    raster.register(spark)
    at = Folder(spark, "round-trip").path
    raster.save(raster.tiles_of(t.raster(spark, sf_dir), 48), at)
    return pixels(raster.pixels(spark.read.format("raster").option("path", f"{at}/s.tif").option("rows", 64).load()))


@query(f"""WITH {t.SQL_RASTER}, e AS (SELECT min(v) AS lo, max(v) AS hi FROM ras), s AS (SELECT least(1.0::DOUBLE, 50.0::DOUBLE / greatest(h, w)) AS k, h, w FROM ext), o AS (SELECT greatest(floor(h * k), 1) AS oh, greatest(floor(w * k), 1) AS ow, h, w FROM s)
SELECT CAST(least(floor(y * oh / h), oh - 1) AS BIGINT) AS y, CAST(least(floor(x * ow / w), ow - 1) AS BIGINT) AS x, floor(round(avg(CASE WHEN hi > lo THEN floor((v - lo) / (hi - lo) * 255) ELSE 0 END), 9)) AS v FROM ras, e, o GROUP BY 1, 2""")
def preview_downscale(spark: SparkSession, sf_dir: str) -> DataFrame:
    return images.preview(t.raster(spark, sf_dir), 50).select(F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x"), "v")


@query("""SELECT user_id AS job_id, event_type AS status, CASE event_type WHEN 'view' THEN 0 WHEN 'click' THEN 2 WHEN 'purchase' THEN 6 ELSE -1 END AS step FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) z WHERE k = 1""")
def job_latest_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs = t.table(spark, sf_dir, "events").select(F.col("user_id").alias("job_id"), F.col("event_type").alias("status"), "ts", "event_id")
    step = F.when(F.col("status") == "view", 0).when(F.col("status") == "click", 2).when(F.col("status") == "purchase", 6).otherwise(-1)
    return rules.latest(jobs, "job_id", "ts", ["event_id"]).select("job_id", "status", step.alias("step"))


SQL_MOVES = """st AS (SELECT CAST(user_id AS VARCHAR) AS job_id, CASE event_type WHEN 'view' THEN 'pending' WHEN 'click' THEN 'running' WHEN 'purchase' THEN 'completed' ELSE 'failed' END AS status, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
mv AS (SELECT job_id, k, status, CAST(NULL AS VARCHAR) AS previous, status = 'pending' AS valid, CASE WHEN status = 'pending' THEN status END AS now FROM st WHERE k = 1
  UNION ALL SELECT st.job_id, st.k, st.status, now, coalesce(CASE WHEN now IS NULL THEN st.status = 'pending' WHEN now = 'pending' THEN st.status = 'running' WHEN now = 'running' THEN st.status IN ('completed', 'failed') END, false),
    CASE WHEN coalesce(CASE WHEN now IS NULL THEN st.status = 'pending' WHEN now = 'pending' THEN st.status = 'running' WHEN now = 'running' THEN st.status IN ('completed', 'failed') END, false) THEN st.status ELSE now END FROM mv JOIN st ON st.job_id = mv.job_id AND st.k = mv.k + 1)"""


@query(f"WITH RECURSIVE {SQL_MOVES} SELECT job_id, status, coalesce(previous, 'none') AS previous, valid, count(*) AS n FROM mv GROUP BY 1, 2, 3, 4")
def job_state_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Job states as a stream, against the state each job has so far."""
    from ..streaming import jobs

    status = F.when(F.col("event_type") == "view", "pending").when(F.col("event_type") == "click", "running").when(F.col("event_type") == "purchase", "completed").otherwise("failed")
    states = t.table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("job_id"), status.alias("status"), F.col("ts").cast("timestamp").alias("updated"))
    moves = jobs.replay(states, Folder(spark, "jobs").path)
    return moves.groupBy("job_id", "status", F.coalesce("previous", F.lit("none")).alias("previous"), "valid").agg(F.count("*").alias("n"))


@query(f"WITH {t.SQL_TIES}, z AS (SELECT pair_id, idx, rx - sx AS ex, ry - sy AS ey, sx, sy FROM ties), l AS (SELECT *, CASE WHEN ex * ex + ey * ey > 0 THEN least(greatest(((500 - sx) * ex + (400 - sy) * ey) / (ex * ex + ey * ey), 0), 1) ELSE 0 END AS t FROM z), d AS (SELECT pair_id, idx, round(sqrt(pow(500 - (sx + t * ex), 2) + pow(400 - (sy + t * ey), 2)), 9) AS d FROM l) SELECT pair_id, idx, {R6('d')} AS distance FROM (SELECT *, row_number() OVER (PARTITION BY pair_id ORDER BY d, idx) AS k FROM d WHERE d < 15) q WHERE k = 1")
def hover_hit_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.nearest_hit(t.ties(spark, sf_dir), 500.0, 400.0).select("pair_id", "idx", r6("distance").alias("distance"))


def _catalog() -> list[tuple[str, str]]:
    from .config import METHODS

    return [(kind, name) for kind, names in METHODS.items() for name in names]


_NAMED = "CASE o_orderkey % {0} " + " ".join(f"WHEN {k} THEN '{m}'" for k, (_, m) in enumerate(_catalog())) + " ELSE 'other' END"


@query("WITH m AS (SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in _catalog()) + f""") v(kind, method)), a AS (SELECT {_NAMED.format(len(_catalog()) + 3)} AS method FROM orders)
SELECT a.method, m.kind, m.kind IS NOT NULL AS known, count(*) AS n FROM a LEFT JOIN m ON a.method = m.method GROUP BY ALL""")
def config_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each method of the settings is asked for, where every order names one; names that no setting has are not known."""
    known = spark.createDataFrame(_catalog(), "kind string, method string")
    asked = t.table(spark, sf_dir, "orders").select(F.expr(_NAMED.format(len(_catalog()) + 3)).alias("method")).groupBy("method").agg(F.count("*").alias("n"))
    return asked.join(known, "method", "left").select("method", "kind", F.col("kind").isNotNull().alias("known"), "n")


@query()
def sift_keypoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keypoints by tiles of 128 pixels, down to a quarter of the usual contrast."""
    return features.detect(t.raster(spark, sf_dir), 5000, 128, contrast=0.01).select("kp_idx", *[r6(c).alias(c) for c in ("x", "y", "scale", "orientation", "response")])


def _sql_extrema(least: float, scales: int = 3, sigma: float = 1.6) -> str:
    taps = lambda s: stencil.gaussian(2 * max(1, math.ceil(3.5 * s)) + 1, s)
    steps = [math.sqrt(sigma**2 - 0.25)] + [math.sqrt((sigma * 2 ** (s / scales)) ** 2 - (sigma * 2 ** ((s - 1) / scales)) ** 2) for s in range(1, scales + 3)]
    levels = [t.sql_separable("nz" if k == 0 else f"g{k - 1}", f"g{k}", ["v"], taps(s)) for k, s in enumerate(steps)]
    dogs = " UNION ALL ".join(f"SELECT {k} AS s, y, x, b.v - a.v AS v FROM g{k} a JOIN g{k + 1} b USING (y, x)" for k in range(scales + 2))
    return f"""WITH {t.SQL_RASTER}, nz AS (SELECT y, x, (v - (SELECT min(v) FROM ras)) / ((SELECT max(v) FROM ras) - (SELECT min(v) FROM ras)) AS v FROM ras),
{", ".join(levels)}, dg AS MATERIALIZED ({dogs}), cd AS (SELECT dg.* FROM dg, ext WHERE s BETWEEN 1 AND {scales} AND y BETWEEN 1 AND h - 2 AND x BETWEEN 1 AND w - 2 AND abs(v) > {least!r}::DOUBLE),
ne AS (SELECT cd.*, i.o AS os, j.o AS oy, k.o AS ox FROM cd, (VALUES (-1), (0), (1)) i(o), (VALUES (-1), (0), (1)) j(o), (VALUES (-1), (0), (1)) k(o) WHERE i.o <> 0 OR j.o <> 0 OR k.o <> 0)
SELECT ne.s AS level, ne.y, ne.x, {R6('ne.v')} AS v FROM ne JOIN dg ON dg.s = ne.s + os AND dg.y = ne.y + oy AND dg.x = ne.x + ox GROUP BY ne.s, ne.y, ne.x, ne.v HAVING bool_and(CASE WHEN ne.v > 0 THEN ne.v > dg.v ELSE ne.v < dg.v END)"""


@query(_sql_extrema(0.004))
def scale_space_extrema(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extrema of the first octave by tiles of 96 pixels."""
    return features.scale_space_extrema(t.raster(spark, sf_dir), 0.004, 96).select("level", "y", "x", r6("v").alias("v"))
