"""Match exports, previews and reports."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.scalars import metric_text


def fixed_half_even(c: Column, digits: int) -> Column:
    """Fixed-point text of the exact binary value, as C's printf writes it (ties to even)."""
    exact = c.cast("decimal(38,20)")
    return F.bround(exact, digits).cast(f"decimal(30,{digits})").cast("string")


def csv_lines(matches: DataFrame, order: str, columns: Sequence[tuple[str, int]]) -> DataFrame:
    """(pair_id, line): each pair's matches numbered from 0 in order, then the columns with their decimals."""
    number = F.row_number().over(Window.partitionBy("pair_id").orderBy(order)) - 1
    return matches.select("pair_id", F.concat_ws(",", number.cast("string"), *[fixed_half_even(F.col(c), d) for c, d in columns]).alias("line"))


def write_match_csv(matches: DataFrame, path: str) -> None:
    """One folder per pair with match_id, source_x, source_y, reference_x, reference_y, confidence. No matches are an error."""
    if matches.isEmpty():
        raise ValueError("no matches to export")
    number = F.row_number().over(Window.partitionBy("pair_id").orderBy("idx")) - 1
    names = {"source_x": ("sx", 3), "source_y": ("sy", 3), "reference_x": ("rx", 3), "reference_y": ("ry", 3), "confidence": ("confidence", 4)}
    rows = matches.select("pair_id", number.alias("match_id"), *[fixed_half_even(F.col(c), d).alias(n) for n, (c, d) in names.items()])
    rows.repartition("pair_id").write.partitionBy("pair_id").option("header", True).csv(path)


def geojson_features(matches: DataFrame, geotransform: Sequence[float] | None) -> DataFrame:
    """(pair_id, idx, feature): a GeoJSON point per match at the centre of its reference pixel; without a geotransform, at the pixel's own coordinates."""
    if geotransform is None:
        gx, gy = F.col("rx"), F.col("ry")
    else:
        c, a, b, f, d, e = (float(v) for v in geotransform)
        x, y = F.col("rx") + 0.5, F.col("ry") + 0.5
        gx, gy = c + a * x + b * y, f + d * x + e * y
    feature = F.struct(
        F.lit("Feature").alias("type"), F.struct(F.lit("Point").alias("type"), F.array(gx, gy).alias("coordinates")).alias("geometry"),
        F.struct(F.array("sx", "sy").alias("source_pixel"), F.array("rx", "ry").alias("reference_pixel"), "confidence").alias("properties"),
    )
    return matches.select("pair_id", "idx", F.to_json(feature).alias("feature"))


def write_geojson(features: DataFrame, path: str) -> None:
    """A feature per line (the GeoJSON text sequence), a folder per pair; a pair of any size is written without gathering it."""
    features.select("pair_id", F.col("feature").alias("value")).write.partitionBy("pair_id").text(path)


def png_bytes(img: np.ndarray) -> bytes:
    """An 8-bit grey PNG."""
    h, w = img.shape

    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    raw = np.concatenate([np.zeros((h, 1), np.uint8), img.astype(np.uint8)], axis=1).tobytes()
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def preview_png(px: DataFrame, most: int = 1024) -> DataFrame:
    """(image, png): previews of at most ``most`` pixels a side, so of bounded size."""
    from ..operators.images import preview

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        img = np.zeros((pdf["y"].max() + 1, pdf["x"].max() + 1), np.uint8)
        img[pdf["y"], pdf["x"]] = pdf["v"]
        return pd.DataFrame({"image": pdf["image"].iloc[:1], "png": [png_bytes(img)]})

    return preview(px, most).groupBy("image").applyInPandas(run, "image string, png binary")


def report(runs: DataFrame, columns: Sequence[str]) -> str:
    """A Markdown table of a report's rows, missing values as a dash."""
    rows = runs.select("case_id", *[metric_text(F.col(c).cast("double")).alias(c) for c in columns]).orderBy("case_id").collect()
    lines = ["| case | " + " | ".join(columns) + " |", "|-" * (len(columns) + 1) + "|"]
    return "\n".join(lines + ["| " + " | ".join(map(str, r)) + " |" for r in rows])
