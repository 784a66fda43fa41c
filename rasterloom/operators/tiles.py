"""Rasters as blocks of pixels, and tiles with a halo of their neighbours' pixels.

A block is (image, y0, x0, h, w, data): a rectangle of doubles or floats, row by row. A tile (ty, tx) owns the square of ``side`` pixels from (ty * side, tx * side) on; with a halo it also sees ``halo`` pixels around, as far as the image goes.
Each block sends every tile that needs some of it one piece, so a task holds one tile and its halo, whatever the image's size.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, GroupedData, functions as F

#: Columns of blocks, and of the pieces that tiles see of them.
BLOCK = "image string, y0 long, x0 long, h int, w int, data binary"
SEEN = f"{BLOCK}, ty long, tx long"
PIECE = f"{SEEN}, height long, width long, lo double, hi double"
_ARROW = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "binary": pa.binary()}


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def _array(pdf: pd.DataFrame, fill: float) -> tuple[np.ndarray, int, int]:
    """(array, y, x of its first pixel) of a block's pixels."""
    y0, x0 = int(pdf["y"].min()), int(pdf["x"].min())
    out = np.full((int(pdf["y"].max()) - y0 + 1, int(pdf["x"].max()) - x0 + 1), float(fill))
    out[pdf["y"] - y0, pdf["x"] - x0] = pdf["v"]
    return out, y0, x0


def _seen(data: np.ndarray, y0: int, x0: int, side: int, halo: int, height: int | None = None, width: int | None = None) -> Iterator[tuple]:
    """(y0, x0, h, w, data, ty, tx): what each tile of an image of that size, if it is known, sees of a block."""
    h, w = data.shape
    last = [(at + n - 1 + halo) // side if size is None else min((at + n - 1 + halo) // side, (size - 1) // side) for at, n, size in ((y0, h, height), (x0, w, width))]
    for ty in range(max(0, (y0 - halo) // side), last[0] + 1):
        for tx in range(max(0, (x0 - halo) // side), last[1] + 1):
            y, x = max(y0, ty * side - halo), max(x0, tx * side - halo)
            part = data[y - y0: (ty + 1) * side + halo - y0, x - x0: (tx + 1) * side + halo - x0]
            if part.size:
                yield y, x, *part.shape, part.tobytes(), ty, tx


def blocks(px: DataFrame, side: int = 512, fill: float = 0.0) -> DataFrame:
    """Blocks of a pixel table (image, y, x, v) in doubles; pixels that are missing inside a block are ``fill``."""

    def make(pdf: pd.DataFrame) -> pd.DataFrame:
        out, y0, x0 = _array(pdf, fill)
        return pd.DataFrame([[pdf["image"].iloc[0], y0, x0, *out.shape, out.tobytes()]], columns=_names(BLOCK))

    return _by_block(px, side).applyInPandas(make, BLOCK)


def _by_block(px: DataFrame, side: int) -> GroupedData:
    keys = [F.floor(F.col(c) / side).alias(f"_{c}") for c in ("y", "x")]
    slim = px.select("image", F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x"), F.col("v").cast("double").alias("v"))
    return slim.groupBy("image", *keys)


def seen(px: DataFrame, side: int, halo: int, fill: float = 0.0) -> DataFrame:
    """SEEN rows: what tiles see of the blocks of a pixel table, cut where a block is made, so that a task's Python holds one block, whatever the number of blocks. Tiles beyond the image's ends that see some of it have rows, too."""

    def cut(pdf: pd.DataFrame) -> pd.DataFrame:
        image = pdf["image"].iloc[0]
        return pd.DataFrame([(image, *row) for row in _seen(*_array(pdf, fill), side, halo)], columns=_names(SEEN))

    return _by_block(px, side).applyInPandas(cut, SEEN)


def ends(px: DataFrame) -> DataFrame:
    """(image, height, width, lo, hi): sizes and the range of values."""
    return px.groupBy("image").agg((F.max("y") + 1).cast("long").alias("height"), (F.max("x") + 1).cast("long").alias("width"), F.min("v").cast("double").alias("lo"), F.max("v").cast("double").alias("hi"))


def pieces(parts: DataFrame, side: int, halo: int, dtype: str = "float64") -> DataFrame:
    """What each tile sees of each block (with the image's ends): PIECE rows."""
    size = np.dtype(dtype).itemsize

    kinds = [c.split() for c in PIECE.split(", ")]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        to = pa.schema([(c, _ARROW[kind]) for c, kind in kinds])
        for batch in batches:
            for k in range(batch.num_rows):
                # A block at a time; a batch holds many.
                b = {c: batch.column(c)[k].as_py() for c in batch.schema.names if c != "data"}
                data = np.frombuffer(batch.column("data")[k].as_buffer(), dtype, b["h"] * b["w"]).reshape(b["h"], b["w"])
                rows = [(b["image"], *row, b["height"], b["width"], b["lo"], b["hi"]) for row in _seen(data, b["y0"], b["x0"], side, halo, b["height"], b["width"])]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows), to)], schema=to) if rows else pa.RecordBatch.from_pylist([], schema=to)

    if size not in (4, 8):
        raise ValueError(f"blocks hold floats or doubles, not {dtype}")
    return parts.select("image", "y0", "x0", "h", "w", "data", "height", "width", "lo", "hi").mapInArrow(cut, PIECE)


def put_together(pdf: pd.DataFrame, dtype: str = "float64", fill: float = 0.0) -> tuple[np.ndarray, int, int]:
    """(array, y, x of its first pixel) of a tile's pieces, or of some blocks."""
    y0, x0 = int(pdf["y0"].min()), int(pdf["x0"].min())
    out = np.full((int((pdf["y0"] + pdf["h"]).max()) - y0, int((pdf["x0"] + pdf["w"]).max()) - x0), fill, dtype)
    for p in pdf.itertuples(index=False):
        out[p.y0 - y0: p.y0 - y0 + p.h, p.x0 - x0: p.x0 - x0 + p.w] = np.frombuffer(p.data, dtype, p.h * p.w).reshape(p.h, p.w)
    return out, y0, x0


def on_tiles(parts: DataFrame, run: Callable[[pd.DataFrame], pd.DataFrame], schema: str, side: int, halo: int, dtype: str = "float64") -> DataFrame:
    """run on the pieces of each tile."""
    return pieces(parts, side, halo, dtype).groupBy("image", "ty", "tx").applyInPandas(run, schema)
