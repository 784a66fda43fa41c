"""Connected components of a link table, without gathering all links anywhere.

Each partition first replaces its links by a spanning star forest. Rounds of large-star and
small-star (Kiveris et al., "Connected Components in MapReduce and Beyond", 2014) follow, as joins and
partial aggregates over tables in the shared folder, until no link changes. Once at most ``in_task`` links
are left (a fixed bound, whatever the input), one task finishes them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .storage import Workspace, shuffle_partitions

IN_TASK = 200_000


class Forest:
    """Union-find over the nodes 0..n-1, in numpy; a root is its tree's smallest node."""

    def __init__(self, n: int):
        self.root = np.arange(n, dtype=np.int64)

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        root = self.root
        while True:
            ra, rb = root[a], root[b]
            differ = ra != rb
            if not differ.any():
                return
            a, b, ra, rb = a[differ], b[differ], ra[differ], rb[differ]
            np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
            while True:
                up = root[root]
                if np.array_equal(up, root):
                    break
                root[:] = up


    def links(self) -> tuple[np.ndarray, np.ndarray]:
        """(node, its root) of the nodes that aren't roots."""
        child = np.flatnonzero(self.root != np.arange(len(self.root)))
        return child, self.root[child]


class ClosestForest:
    """A spanning forest of least distances (small whole numbers) over the nodes 0..n-1, of links that come in runs; between runs only the forest is held."""

    def __init__(self, n: int, held: int = 2_000_000):
        self.n, self.most, self.size = n, held, 0
        self.runs: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def add(self, a: np.ndarray, b: np.ndarray, apart: np.ndarray) -> None:
        self.runs.append((a, b, apart))
        self.size += len(a)
        if self.size > max(self.most, 4 * self.n):
            self._reduce()

    def _reduce(self) -> None:
        a, b, apart = (np.concatenate([r[k] for r in self.runs] or [np.zeros(0, np.int64)]) for k in range(3))
        root, kept = np.arange(self.n, dtype=np.int64), []
        for d in np.unique(apart):
            at = np.flatnonzero(apart == d)
            while len(at):
                ra, rb = root[a[at]], root[b[at]]
                at, ra, rb = (x[ra != rb] for x in (at, ra, rb))
                if not len(at):
                    break
                high, low = np.maximum(ra, rb), np.minimum(ra, rb)
                high, first = np.unique(high, return_index=True)  # each root is hooked below a smaller one by one link
                kept.append(at[first])
                root[high] = low[first]
                while not np.array_equal(up := root[root], root):
                    root = up
        kept = np.concatenate(kept) if kept else np.zeros(0, np.int64)
        self.runs, self.size = [(a[kept], b[kept], apart[kept])], len(kept)

    def links(self) -> tuple[np.ndarray, np.ndarray]:
        self._reduce()
        return self.runs[0][0], self.runs[0][1]


def star_forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (node, smallest node of its component), fewer than there are nodes."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    forest = Forest(len(nodes))
    forest.add(at[: len(a)], at[len(a):])
    child = np.flatnonzero(forest.root != np.arange(len(nodes)))
    return nodes[child], nodes[forest.root[child]]


def _local(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Star forests of runs of links; memory is bounded by the run's length."""
    kept: list[tuple[np.ndarray, np.ndarray]] = []
    held = 0
    for pdf in batches:
        kept.append((pdf["u"].to_numpy(np.int64), pdf["v"].to_numpy(np.int64)))
        held += len(pdf)
        if held > 2_000_000:
            u, v = star_forest(np.concatenate([x for x, _ in kept]), np.concatenate([y for _, y in kept]))
            if len(u) > 1_000_000:
                yield pd.DataFrame({"u": u, "v": v})
                kept, held = [], 0
            else:
                kept, held = [(u, v)], len(u)
    if held:
        u, v = star_forest(np.concatenate([x for x, _ in kept]), np.concatenate([y for _, y in kept]))
        yield pd.DataFrame({"u": u, "v": v})


def _state(links: DataFrame) -> tuple[int, int]:
    """Count and order-free digest of the links."""
    row = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return int(row[0]), int(row[1] or 0)


def connected_components(links: DataFrame, ws: Workspace, in_task: int = IN_TASK, name: str = "cc") -> DataFrame:
    """(node, root) of each node in ``links`` (columns u, v, long) that is not its own root; root is the smallest node
    of its component. Nulls and self-links are left out; repeated links count once; no links give no rows."""
    links = links.where("u is not null and v is not null and u <> v").select("u", "v")
    edges = ws.save(links.mapInPandas(_local, "u long, v long"), f"{name}0")
    count, before = _state(edges)
    k = 0
    while count > in_task:
        k += 1
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = ws.save(large, f"{name}{k}a")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = small.select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        small = ws.save(small, f"{name}{k}b")
        count, after = _state(small)
        ws.drop(f"{name}{k}a")
        ws.drop(f"{name}{k - 1}{'b' if k > 1 else ''}")
        edges = small
        if after == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = after
    # A fixed number of links at most: one task.
    done = edges.repartition(1).mapInPandas(_local, "u long, v long") if count else edges
    return done.select(F.col("u").alias("node"), F.col("v").alias("root"))


__all__ = ["ClosestForest", "Forest", "connected_components", "star_forest", "shuffle_partitions"]
