"""Packing of token sequences into fixed windows: best fit, then a swap-based local search.

Documents become pieces of at most ``capacity`` ids. Full pieces are sequences already. The others are dealt by a hash into groups of bounded
size, each packed in one task: best fit in decreasing length, then exchanges between underfull bins (one for one, two for
one, or a move), each of which increases the sum of squared fills, so the search ends and fills drift from emptier bins to fuller ones until bins
are empty. A group leaves one or two bins underfull, which is all that grouping costs.
"""

from __future__ import annotations

import bisect
import zlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import islice
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .storage import Workspace, releasing
from .tokenizers_public import default_path, encode_with_added, encoding_with_added

#: Pieces packed in one task, about.
GROUP = 50_000


class Effort(NamedTuple):
    """How far the local search looks; it bounds the time of a group, never the pieces. rounds: passes, of which each ends the search if it changes nothing. donors: emptiest bins that give in a pass
    (or twice the bins that could be saved, if more). two: a donor's longest items that are tried in pairs. lengths, holders: shorter lengths tried for an exchange, and items of each."""

    rounds: int = 8
    donors: int = 200
    two: int = 8
    lengths: int = 100
    holders: int = 8


class Bins:
    """Bins of item lengths; items are numbers, only lengths matter."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.items: list[list[int]] = []
        self.fill: list[int] = []
        self.by_fill: dict[int, set[int]] = defaultdict(set)
        self.fills: list[int] = []  # sorted fills of underfull bins

    def _leave(self, b: int) -> None:
        at = self.by_fill[self.fill[b]]
        at.discard(b)
        if not at and 0 < self.fill[b] < self.capacity:
            del self.fills[bisect.bisect_left(self.fills, self.fill[b])]

    def _enter(self, b: int) -> None:
        at = self.by_fill[self.fill[b]]
        if not at and 0 < self.fill[b] < self.capacity:
            bisect.insort(self.fills, self.fill[b])
        at.add(b)

    def change(self, b: int, out: list[int], into: list[int], length) -> None:
        self._leave(b)
        for i in out:
            self.items[b].remove(i)
        self.items[b] += into
        self.fill[b] += sum(int(length[i]) for i in into) - sum(int(length[i]) for i in out)
        self._enter(b)

    def best_fit(self, i: int, length) -> None:
        n = int(length[i])
        k = bisect.bisect_right(self.fills, self.capacity - n) - 1
        if k >= 0:
            b = min(self.by_fill[self.fills[k]])
        else:
            b = len(self.items)
            self.items.append([])
            self.fill.append(0)
        self.change(b, [], [i], length)


def pack(length: np.ndarray, capacity: int, effort: Effort = Effort()) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each item; lengths from 1 to capacity. The same lengths in the same order give the same bins."""
    bins = Bins(capacity)
    for i in np.argsort(-length, kind="stable"):
        bins.best_fit(int(i), length)
    for _ in range(effort.rounds):
        if not _improve(bins, length, effort):
            break
    where, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
    for b, items in enumerate(bins.items):
        at = 0
        for i in items:
            where[i], offset[i] = b, at
            at += int(length[i])
    return where, offset


def _improve(bins: Bins, length, effort: Effort) -> bool:
    """One pass: the emptiest bins give to fuller ones, which lengthens the fuller ones by at most their gap."""
    low = sum(bins.fill[b] for f in bins.fills for b in bins.by_fill[f])
    open_bins = sorted((b for f in bins.fills for b in bins.by_fill[f]), key=lambda b: (bins.fill[b], b))
    if len(open_bins) < 2 or -(-low // bins.capacity) >= len(open_bins):
        return False  # no bin can become empty
    spare = len(open_bins) + low // -bins.capacity
    holders: dict[int, dict[tuple[int, int], None]] = defaultdict(dict)  # length -> (bin, item) of bins that may be lengthened
    for b in open_bins:
        for i in bins.items[b]:
            holders[int(length[i])][b, i] = None
    lengths = sorted(holders)
    moved = False

    def changed(b: int, out: list[int], into: list[int]) -> None:
        for i in out:
            holders[int(length[i])].pop((b, i), None)
        bins.change(b, out, into, length)
        for i in into:
            n = int(length[i])
            if n not in holders:
                bisect.insort(lengths, n)
            holders[n][b, i] = None

    for donor in open_bins[: max(2 * spare + 2, effort.donors)]:
        for x in sorted(bins.items[donor], key=lambda i: -length[i]):
            if x not in bins.items[donor]:
                continue
            n = int(length[x])
            # A move: the fullest bin that takes x.
            k = bisect.bisect_right(bins.fills, bins.capacity - n) - 1
            to = next((b for f in reversed(bins.fills[max(0, k - 3): k + 1]) for b in sorted(bins.by_fill[f]) if b != donor and bins.fill[b] + n > bins.fill[donor]), None) if k >= 0 else None
            if to is not None:
                changed(donor, [x], [])
                changed(to, [], [x])
                moved = True
                continue
            if _swap(bins, holders, lengths, changed, donor, [x], n, length, effort):
                moved = True
        inside = sorted(bins.items[donor], key=lambda i: -length[i])[: effort.two]
        for k, x in enumerate(inside):  # two for one
            for y in inside[k + 1:]:
                if x in bins.items[donor] and y in bins.items[donor]:
                    moved |= _swap(bins, holders, lengths, changed, donor, [x, y], int(length[x] + length[y]), length, effort)
    return moved


def _swap(bins: Bins, holders: dict, lengths: list[int], changed, donor: int, out: list[int], n: int, length, effort: Effort) -> bool:
    """Gives ``out`` (n ids together) for one shorter item of a bin that has room for the difference and ends up fuller than the donor was."""
    k = bisect.bisect_left(lengths, n) - 1
    for m in reversed(lengths[max(0, k - effort.lengths): k + 1]):
        for b, i in islice(holders[m], effort.holders):
            gain = n - m
            if b != donor and bins.fill[b] + gain <= bins.capacity and bins.fill[b] + gain > bins.fill[donor]:
                changed(donor, out, [])
                changed(b, [i], out)
                changed(donor, [], [i])
                return True
    return False


def pieces_of(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids: the first takes what is left over."""
    head = n % capacity or min(n, capacity)
    return [(0, head), *((at, capacity) for at in range(head, n, capacity))] if n else []


def tokenize(docs: DataFrame, path: str, capacity: int, end_id: int) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of each piece of docs (doc_id, text); each document's ids end in ``end_id``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end = encoding_with_added(path), np.array([end_id], "<u4")
        for b in batches:
            rows = []
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1)):
                ids = np.concatenate([encode_with_added(enc, text.as_py()).astype("<u4"), end])
                rows += [(doc_id, k, s, n, zlib.crc32(ids[s: s + n].tobytes())) for k, (s, n) in enumerate(pieces_of(len(ids), capacity))]
            cols = list(zip(*rows)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], ["doc_id", "piece", "start", "length", "ids_crc32"])

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return slim.mapInArrow(releasing(run), "doc_id long, piece int, start long, length long, ids_crc32 long")


def best_fit_pack(docs: DataFrame, path: str | None = None, capacity: int = 2048, end_id: int = 0, group: int = GROUP, effort: Effort = Effort()) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: where each piece of docs (doc_id, text) stands.

    Null and empty texts are the end id alone; long ones are tokenized whole and cut into pieces of ``capacity``. Repeated rows are packed each; null doc_ids stay null; other columns are not looked at; no rows give no rows.
    sequence_id is unique over all groups: group number times 2**32, plus the bin.
    """
    path = path or default_path("byte_bpe_50k.json")
    ws = Workspace(docs.sparkSession, "packing")
    pieces = ws.save(tokenize(docs, path, capacity, end_id), "pieces")
    groups = max(1, round(pieces.count() / group))

    def place(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "doc_id", "piece", "start", "ids_crc32"], kind="stable").reset_index(drop=True)
        where, offset = pack(pdf["length"].to_numpy(np.int64), capacity, effort)
        return pdf.assign(sequence_id=(int(key[0]) << 32) + where, offset=offset)

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, g long, sequence_id long, offset long"
    dealt = pieces.withColumn("g", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", F.monotonically_increasing_id()), F.lit(groups)))
    return dealt.groupBy("g").applyInPandas(place, schema).drop("g")
