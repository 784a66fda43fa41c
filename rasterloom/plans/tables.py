"""The engine's inputs made from the star-schema tables: rasters, descriptors, tie points, boxes. Each reads its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

WIDTH = 64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(image, y, x, v): a row per embedding, a column per component, as whole values 0..255."""
    px = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("y"), F.posexplode("embedding").alias("x", "e"))
    return px.select(F.lit("s").alias("image"), "y", F.col("x").cast("long").alias("x"), F.floor((F.col("e").cast("double") + 1) * 127.5).cast("double").alias("v"))


def mirrored(px: DataFrame) -> DataFrame:
    return px.withColumn("x", WIDTH - 1 - F.col("x"))


def rolled(px: DataFrame) -> DataFrame:
    """Each pixel one row down and two columns on, around the edges."""
    n = px.groupBy("image").agg((F.max("y") + 1).alias("n"))
    return px.join(n, "image").select("image", ((F.col("y") + 1) % F.col("n")).alias("y"), ((F.col("x") + 2) % WIDTH).alias("x"), "v")


def ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(pair_id, idx, sx, sy, rx, ry, confidence): tie points under a known affine with small noise; those of every 13th order are 40 pixels off."""
    k, n, p = F.col("l_orderkey"), F.col("l_linenumber").cast("long"), F.col("l_partkey")
    pts = table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("pair_id"), (k * 1000 + n).alias("idx"), ((k * 37 + n * 211) % 1024).cast("double").alias("sx"), ((p * 53 + n * 17) % 1024).cast("double").alias("sy"),
        (((k * 7 + n * 3) % 21 - 10) / 50.0).alias("e1"), (((p * 5 + n) % 21 - 10) / 50.0).alias("e2"), F.when(k % 13 == 0, 40.0).otherwise(0.0).alias("off"), (1 - F.col("l_discount")).alias("confidence"),
    )
    return pts.select("pair_id", "idx", "sx", "sy", (0.98 * F.col("sx") - 0.12 * F.col("sy") + 15 + F.col("e1") + F.col("off")).alias("rx"), (0.11 * F.col("sx") + 1.02 * F.col("sy") - 10 + F.col("e2")).alias("ry"), "confidence")


def far_ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ties() with six of ten points thrown 60 to 400 pixels off, each to its own side."""
    k = F.col("idx")
    bad, far = k * 7 % 10 < 6, 60 + k * 37 % 341
    off = lambda c, turn: F.when(bad, F.when(turn, far).otherwise(-far)).otherwise(0).cast("double") + F.col(c)
    return ties(spark, sf_dir).withColumns({"rx": off("rx", k % 3 == 0), "ry": off("ry", k % 11 < 5)})


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(image, idx, x, y) of events: an image per type, 1000 wide and 500 high."""
    return table(spark, sf_dir, "events").select(F.col("event_type").alias("image"), F.col("event_id").alias("idx"), (F.col("user_id") % 1000).cast("double").alias("x"), F.col("value").alias("y"))


# The same inputs in SQL.

SQL_RASTER = f"""ras AS (SELECT e.vec_id AS y, CAST(u.i AS BIGINT) AS x, floor((CAST(e.embedding[u.i + 1] AS DOUBLE) + 1) * 127.5) AS v
  FROM embeddings e CROSS JOIN (SELECT unnest(range({WIDTH})) AS i) u),
ext AS (SELECT max(y) + 1 AS h, max(x) + 1 AS w FROM ras)"""
SQL_BOTH = SQL_RASTER + f""",
mir AS (SELECT y, {WIDTH - 1} - x AS x, v FROM ras),
pairs AS (SELECT a.y, a.x, a.v AS a, b.v AS b FROM ras a JOIN mir b ON a.y = b.y AND a.x = b.x)"""
SQL_TIES = """ties AS (SELECT l_suppkey AS pair_id, l_orderkey * 1000 + l_linenumber AS idx, sx, sy,
  0.98::DOUBLE * sx - 0.12::DOUBLE * sy + 15 + e1 + off AS rx, 0.11::DOUBLE * sx + 1.02::DOUBLE * sy - 10 + e2 AS ry, 1 - l_discount AS confidence
  FROM (SELECT *, CAST((l_orderkey * 37 + l_linenumber * 211) % 1024 AS DOUBLE) AS sx, CAST((l_partkey * 53 + l_linenumber * 17) % 1024 AS DOUBLE) AS sy,
    ((l_orderkey * 7 + l_linenumber * 3) % 21 - 10) / 50.0::DOUBLE AS e1, ((l_partkey * 5 + l_linenumber) % 21 - 10) / 50.0::DOUBLE AS e2,
    CASE WHEN l_orderkey % 13 = 0 THEN 40.0::DOUBLE ELSE 0.0::DOUBLE END AS off FROM lineitem) t)"""
SQL_FAR_TIES = f"""far AS (WITH {SQL_TIES} SELECT pair_id, idx, sx, sy, CAST(CASE WHEN idx * 7 % 10 < 6 THEN CASE WHEN idx % 3 = 0 THEN 60 + idx * 37 % 341 ELSE -(60 + idx * 37 % 341) END ELSE 0 END AS DOUBLE) + rx AS rx,
  CAST(CASE WHEN idx * 7 % 10 < 6 THEN CASE WHEN idx % 11 < 5 THEN 60 + idx * 37 % 341 ELSE -(60 + idx * 37 % 341) END ELSE 0 END AS DOUBLE) + ry AS ry, confidence FROM ties)"""
SQL_FIT = """mo AS (SELECT pair_id, count(*) AS n, avg(sx) AS ax, avg(sy) AS ay, avg(rx) AS au, avg(ry) AS av, var_pop(sx) AS vx, var_pop(sy) AS vy, covar_pop(sx, sy) AS cxy,
  covar_pop(sx, rx) AS cxu, covar_pop(sy, rx) AS cyu, covar_pop(sx, ry) AS cxv, covar_pop(sy, ry) AS cyv FROM {0} GROUP BY 1),
li AS (SELECT *, (vy * cxu - cxy * cyu) / (vx * vy - cxy * cxy) AS m0, (vx * cyu - cxy * cxu) / (vx * vy - cxy * cxy) AS m1, (vy * cxv - cxy * cyv) / (vx * vy - cxy * cxy) AS m3, (vx * cyv - cxy * cxv) / (vx * vy - cxy * cxy) AS m4 FROM mo),
fit AS (SELECT pair_id, n, m0, m1, au - m0 * ax - m1 * ay AS m2, m3, m4, av - m3 * ax - m4 * ay AS m5 FROM li)"""
SQL_EVENTS = "pts AS (SELECT event_type AS image, event_id AS idx, CAST(user_id % 1000 AS DOUBLE) AS x, value AS y FROM events)"


def sql_r6(expression: str) -> str:
    return f"round({expression}, 6) + 0.0::DOUBLE"


def sql_pad(source: str, into: str, columns: list[str], radius: int, at: str) -> str:
    other, n = ("y", "w") if at == "x" else ("x", "h")
    cols = ", ".join(columns)
    return f"""{into} AS (SELECT {other}, {at}, {cols} FROM {source}
  UNION ALL SELECT {other}, -{at}, {cols} FROM {source} WHERE {at} BETWEEN 1 AND {radius}
  UNION ALL SELECT {other}, 2 * ({n} - 1) - {at}, {cols} FROM {source}, ext WHERE {at} <= {n} - 2 AND {at} >= {n} - 1 - {radius})"""


def sql_weighted(source: str, into: str, kernels: dict[str, list[float]], at: str) -> str:
    """Correlates columns with kernels of one length along an axis."""
    radius = len(next(iter(kernels.values()))) // 2
    other, n = ("y", "w") if at == "x" else ("x", "h")
    sums = ", ".join("(" + " + ".join(f"({g!r}::DOUBLE) * coalesce(lag({c}, {radius - k}) OVER win, 0)" for k, g in enumerate(kernel)) + f") AS {c}" for c, kernel in kernels.items())
    return sql_pad(source, f"{into}_p", list(kernels), radius, at) + f""",
{into} AS (SELECT {other}, {at}, {', '.join(kernels)} FROM (SELECT {other}, {at}, {sums} FROM {into}_p WINDOW win AS (PARTITION BY {other} ORDER BY {at})) q, ext WHERE {at} >= 0 AND {at} < {n})"""


def sql_separable(source: str, into: str, columns: list[str], kernel: list[float]) -> str:
    return sql_weighted(source, f"{into}_x", {c: kernel for c in columns}, "x") + ",\n" + sql_weighted(f"{into}_x", into, {c: kernel for c in columns}, "y")


def sql_box(source: str, into: str, columns: list[str], size: int) -> str:
    r, out, last = size // 2, [], source
    for at, other, n in (("x", "y", "w"), ("y", "x", "h")):
        name = f"{into}_x" if at == "x" else into
        sums = ", ".join(f"sum({c}) OVER (PARTITION BY {other} ORDER BY {at} ROWS BETWEEN {r} PRECEDING AND {r} FOLLOWING) / {float(size)!r}::DOUBLE AS {c}" for c in columns)
        out += [sql_pad(last, f"{name}_p", columns, r, at), f"{name} AS (SELECT {other}, {at}, {', '.join(columns)} FROM (SELECT {other}, {at}, {sums} FROM {name}_p) q, ext WHERE {at} >= 0 AND {at} < {n})"]
        last = name
    return ",\n".join(out)
