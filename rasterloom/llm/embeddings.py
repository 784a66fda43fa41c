"""Exact near-duplicate join of embeddings: a metric range join over pivot cells.

Cosine at least t between unit vectors is a Euclidean distance of at most r = sqrt(2 - 2 t). Every vector belongs to the cell of its nearest pivot. A pair of
different cells a < b is found in a, to which the vector of b is copied unless a bound excludes all of a: by the triangle inequality, a vector v of b within r of a member of a has
d(v, a) <= d(v, b) + 2 r and lies within r of the distances that a's members have to their pivot; in Euclidean space it also lies within r of the plane midway between the pivots. Cells are joined independently.
Equal vectors are collapsed first. A cell's members and copies are cut into blocks of bounded size, and every pair of blocks is a task of its own, so no cell or cluster outgrows a task.

A task returns degrees and a spanning forest, no pair list. Pivots are a bounded sample (at most ``most_pivots`` vectors). In many dimensions without clusters the bounds exclude
few cells and the work nears all pairs; that is the price of exactness.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .components import Forest, connected_components
from .storage import Workspace, releasing

BLOCK = 4096
MOST_PIVOTS = 4096
#: Pivots at least (or as many as there are vectors), so that the bounds work at every size.
LEAST_PIVOTS = 16
#: Slack of the bounds, so that rounding excludes no pair.
SLACK = 1e-6


def unit_vectors(vectors: DataFrame) -> DataFrame:
    """vec_id and unit, array<double>: the vector divided by its length; null for vectors that are null, empty, zero or hold null or non-finite components."""

    def scaled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column(1)
            size = x.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            flat = x.flatten()
            value = flat.fill_null(np.nan).to_numpy(zero_copy_only=False).astype(np.float64)
            at = np.cumsum(size) - size
            unit, fit = value.copy(), np.zeros(len(size), bool)
            for d in np.unique(size[size > 0]):
                rows = np.flatnonzero(size == d)
                cell = at[rows][:, None] + np.arange(d)
                part = value[cell]
                top = np.abs(part).max(axis=1)
                ok = (top > 0) & (top < np.inf)  # NaN is neither
                part = part[ok] / top[ok, None]
                unit[cell[ok]] = part / np.sqrt(np.einsum("ij,ij->i", part, part))[:, None]
                fit[rows[ok]] = True
            offsets = pa.array(np.append(0, np.cumsum(np.where(fit, size, 0))).astype(np.int32), mask=np.append(~fit, False))
            kept = unit[np.repeat(fit, size)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(offsets, pa.array(kept))], ["vec_id", "unit"])

    x = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("x"))
    return x.mapInArrow(releasing(scaled), "vec_id long, unit array<double>")


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def _by_size(batch: pa.RecordBatch, k: int) -> Iterator[tuple[int, pa.RecordBatch]]:
    """(dimension, rows) for each length of the vectors in column k."""
    sizes = batch.column(k).value_lengths().to_numpy(zero_copy_only=False)
    for d in np.unique(sizes):
        yield int(d), batch.take(pa.array(np.flatnonzero(sizes == d)))


def _distance(x: np.ndarray, p: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0, 2 - 2 * (x @ p.T)))


def _links(classes: DataFrame, ws: Workspace, threshold: float, block: int, most_pivots: int) -> DataFrame:
    """From classes (cid, unit, n): rows (a, b, links): with b null, class a has links to so many other rows; else a and b are of one component."""
    radius = math.sqrt(max(0.0, 2 - 2 * threshold))
    n = classes.count()
    wanted = min(most_pivots, max(LEAST_PIVOTS, round(n / block)))
    some = classes.orderBy(F.xxhash64("cid"), "cid").limit(wanted).select("unit").toPandas()  # most_pivots vectors at most
    pivots: dict[int, np.ndarray] = {}
    for row in some["unit"]:
        pivots.setdefault(len(row), []).append(row)
    pivots = {d: np.array(v, np.float64) for d, v in pivots.items()}
    first, count = {}, 0
    for d in sorted(pivots):
        first[d], count = count, count + len(pivots[d])
    # A dimension without a pivot has one cell, around its first axis.
    sizes = [d for (d,) in classes.select(F.size("unit")).distinct().limit(MOST_PIVOTS + 1).collect()]
    if len(sizes) > MOST_PIVOTS:
        raise ValueError(f"vectors of more than {MOST_PIVOTS} lengths")
    others = [d for d in sizes if d not in pivots]
    for d in sorted(others):
        pivots[d], first[d], count = np.eye(1, d), count, count + 1

    def home(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for d, b in _by_size(whole, 1):
                for k in range(0, b.num_rows, 2048):
                    part = b.slice(k, 2048)
                    far = _distance(_matrix(part.column(1)), pivots[d])
                    at = far.argmin(axis=1)
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(at + first[d], pa.int64()), pa.array(far[np.arange(len(at)), at])], ["cid", "unit", "n", "cell", "far"])

    at_home = ws.save(classes.select("cid", "unit", "n").mapInArrow(home, "cid long, unit array<double>, n long, cell long, far double"), "home")
    low, high, members = np.full(count, np.inf), np.full(count, -np.inf), np.zeros(count, np.int64)
    for cell, lo, hi, m in at_home.groupBy("cell").agg(F.min("far"), F.max("far"), F.count("*")).collect():  # one row per pivot
        low[cell], high[cell], members[cell] = lo, hi, m

    def copies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each row at home (copy false) and in the lower cells that may hold a partner."""
        for whole in batches:
            for d, b in _by_size(whole, 1):
                for k in range(0, b.num_rows, 2048):
                    part = b.slice(k, 2048)
                    own = part.column(3).to_numpy() - first[d]
                    far = _distance(_matrix(part.column(1)), pivots[d])
                    mine = part.column(4).to_numpy()[:, None]
                    cells = slice(first[d], first[d] + len(pivots[d]))
                    near = (far <= mine + 2 * radius + SLACK) & (far <= high[cells] + radius + SLACK) & (far >= low[cells] - radius - SLACK)
                    near &= far**2 - mine**2 <= 2 * _distance(pivots[d][own], pivots[d]) * (radius + SLACK)
                    near &= np.arange(far.shape[1]) < own[:, None]
                    row, cell = np.nonzero(near)
                    row, cell, copy = np.concatenate([np.arange(len(own)), row]), np.concatenate([own, cell]) + first[d], np.repeat([False, True], [len(own), len(row)])
                    yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row)), pa.array(cell, pa.int64()), pa.array(copy)], ["cid", "cell", "copy"])

    placed = ws.save(at_home.mapInArrow(copies, "cid long, cell long, copy boolean"), "placed")
    copied = np.zeros(count, np.int64)
    for cell, m in placed.where("copy").groupBy("cell").count().collect():  # one row per pivot
        copied[cell] = m
    own_blocks, copy_blocks = -(-members // block), -(-copied // block)

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Each row goes to every pair of blocks (x of the cell's members, y of members or copies) that its block is in."""
        for pdf in batches:
            cell, copy = pdf["cell"].to_numpy(), pdf["copy"].to_numpy()
            mixed = (pdf["cid"].to_numpy().astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64)
            mine = np.where(copy, own_blocks[cell] + mixed % np.maximum(1, copy_blocks[cell]), mixed % np.maximum(1, own_blocks[cell]))
            many = np.where(copy, own_blocks[cell], own_blocks[cell] + copy_blocks[cell])
            at = np.repeat(np.arange(len(pdf)), many)
            other = np.arange(len(at)) - np.repeat(np.cumsum(many) - many, many)
            x, y = np.minimum(mine[at], other), np.maximum(mine[at], other)
            yield pd.DataFrame({"cid": pdf["cid"].to_numpy()[at], "cell": cell[at], "x": x, "y": y, "in_x": mine[at] == x})

    def join(table: pa.Table) -> pa.Table:
        cid, n = table.column("cid").to_numpy(), table.column("n").to_numpy().astype(np.float64)
        unit, in_x = _matrix(table.column("unit").combine_chunks()), table.column("in_x").to_numpy()
        same = table.column("x")[0].as_py() == table.column("y")[0].as_py()
        a = np.flatnonzero(in_x)
        b = a if same else np.flatnonzero(~in_x)
        links, forest = np.zeros(len(cid)), Forest(len(cid))
        for k in range(0, len(a), 512):
            rows = a[k: k + 512]
            near = unit[rows] @ unit[b].T >= threshold
            if same:
                near[np.arange(len(rows)), np.arange(k, k + len(rows))] = False
            i, j = np.nonzero(near)
            if len(i):
                links[rows] += np.bincount(i, n[b[j]], len(rows))
                if not same:
                    links += np.bincount(b[j], n[rows[i]], len(cid))
                forest.add(rows[i], b[j])
        some = np.flatnonzero(links)
        child = np.flatnonzero(forest.root != np.arange(len(cid)))
        nothing = pa.nulls(len(some), pa.int64())
        return pa.table({
            "a": pa.array(np.concatenate([cid[some], cid[child]]), pa.int64()), "b": pa.concat_arrays([nothing, pa.array(cid[forest.root[child]], pa.int64())]),
            "links": pa.array(np.concatenate([links[some], np.zeros(len(child))]).astype(np.int64), pa.int64()),
        })

    dealt = placed.mapInPandas(deal, "cid long, cell long, x long, y long, in_x boolean").join(at_home.select("cid", "unit", "n"), "cid")
    return ws.save(dealt.groupBy("cell", "x", "y").applyInArrow(join, "a long, b long, links long"), "links")


def near_duplicates(vectors: DataFrame, threshold: float = 0.95, block: int = BLOCK, most_pivots: int = MOST_PIVOTS) -> DataFrame:
    """One row per row of vectors (vec_id, embedding: an array of numbers): vec_id, n_links, component_id, kept.

    n_links counts the other rows with cosine at least ``threshold`` (0 < threshold <= 1), in double precision; component_id is the smallest vec_id reachable by links, kept whether it is the row's own. Vectors
    that are null, empty, zero or hold null or non-finite components link with nothing; vectors of different lengths don't link, and long vectors are compared whole. Repeated rows are vectors each. Null vec_ids are counted as
    partners but name no component and are not kept. Other columns are not looked at; no rows give no rows.
    """
    ws = Workspace(vectors.sparkSession, "embeddings")
    rows = ws.save(unit_vectors(vectors), "rows")
    classes = rows.where("unit is not null").groupBy("unit").agg(F.count("*").alias("n"), F.min("vec_id").alias("least"))
    classes = ws.save(classes.withColumn("cid", F.monotonically_increasing_id()), "classes")
    found = _links(classes, ws, threshold, block, most_pivots)
    links = found.where("b is null").groupBy("a").agg(F.sum("links").alias("links")).withColumnRenamed("a", "cid")
    roots = connected_components(found.where("b is not null").select(F.col("a").alias("u"), F.col("b").alias("v")), ws)
    of = classes.join(links, "cid", "left").join(roots, F.col("cid") == F.col("node"), "left")
    of = ws.save(of.select("unit", "least", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("root", "cid").alias("root")), "found")
    least = of.groupBy("root").agg(F.min("least").alias("component_id"))
    named = of.join(least, "root").select(F.col("unit").alias("_unit"), "n_links", "component_id")
    out = rows.join(named, rows["unit"] == named["_unit"], "left")
    component = F.when(F.col("unit").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
