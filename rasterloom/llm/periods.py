"""Periodic runs of words: stretches that repeat themselves with a smallest period, found exactly in every document.

A period p holds at word i if words i and i + p are equal. A run of period p and ``exponent`` repetitions or more is a stretch in which p holds at (exponent - 1) * p neighbouring words at
least, so it covers a whole block of a grid with half that step: the grids of all periods have about n ln n blocks together (a harmonic sum). A block whose first, middle and last words
agree with those p later is extended both ways by longest common extensions.

Extensions come from a difference cover modulo 31: a set of six residues such that any two places reach, by one common shift of at most 30 words, places of the set. Only suffixes that begin at such places are sorted, by blocks of 31
words and doubling; the common prefixes of neighbours in that order lie in a sparse table. An extension compares the words up to the shift and asks the table for the rest.

How it scales: documents are independent, so nothing is shuffled. A document's memory grows with its own words (about 60 bytes a word where it has candidates, of which there are few in prose).
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from .storage import Packed, releasing

#: A difference cover (fixed values): every residue modulo CYCLE is a difference of two of these.
CYCLE, COVER = 31, np.array([0, 1, 3, 8, 12, 18])
#: Grid blocks looked at, and extensions asked for, at once.
GRID_STEP, ASK_STEP = 1 << 21, 1 << 15
#: Rows of a batch are worked on in parts of about so much text.
SLICE_BYTES = 4 << 20
RUNS = ArrayType(StructType([StructField("start", LongType()), StructField("length", LongType()), StructField("period", LongType())]))


def _shifts() -> np.ndarray:
    """shift[a, b]: the least h such that a + h and b + h are both in the cover."""
    out = np.full((CYCLE, CYCLE), CYCLE, np.int64)
    for h in range(CYCLE - 1, -1, -1):
        a = (COVER - h) % CYCLE
        out[np.ix_(a, a)] = h
    return out


SHIFT = _shifts()
SLOT = np.full(CYCLE, -1, np.int64)
SLOT[COVER] = np.arange(len(COVER))


class Extensions:
    """Longest common extensions to the right of two places i < j of one array of word numbers."""

    def __init__(self, ids: np.ndarray):
        self.n = n = len(ids)
        self.ids = np.concatenate([ids.astype(np.int32) + 1, np.zeros(2 * CYCLE, np.int32)])
        whole = (np.arange(-(-n // CYCLE))[:, None] * CYCLE + COVER[None, :]).ravel()  # sampled places; those beyond the end are empty suffixes
        m = len(whole)
        blocks = np.lib.stride_tricks.sliding_window_view(np.append(self.ids, np.zeros(CYCLE, np.int32)), CYCLE)[np.minimum(whole, n)]
        rank = np.unique(np.ascontiguousarray(blocks.astype(">u4")).view(f"S{4 * CYCLE}").ravel(), return_inverse=True)[1].astype(np.int64)
        ranks, step = [rank], len(COVER)
        real = whole < n
        while step < m and len(np.unique(rank[real])) < real.sum():
            later = np.zeros(m, np.int64)
            later[:-step] = rank[step:] + 1
            rank = np.unique((rank << 32) | later, return_inverse=True)[1].astype(np.int64)
            ranks.append(rank)
            step *= 2
        order = np.argsort(rank, kind="stable")
        self.rank = np.empty(m, np.int64)
        self.rank[order] = np.arange(m)
        common = self._neighbours(order[:-1], order[1:], ranks, whole)
        self.table = [common.astype(np.int32)]
        size = 1
        while 2 * size <= len(common):
            last = self.table[-1]
            self.table.append(np.minimum(last[:-size], last[size:]))
            size *= 2

    def _neighbours(self, a: np.ndarray, b: np.ndarray, ranks: list[np.ndarray], whole: np.ndarray) -> np.ndarray:
        """Words that neighbours in the order of sampled suffixes have in common."""
        m, out = len(whole), np.zeros(len(a), np.int64)
        a, b = a.copy(), b.copy()
        for k in range(len(ranks) - 1, -1, -1):
            inside = np.flatnonzero((a < m) & (b < m))
            same = inside[(ranks[k][a[inside]] == ranks[k][b[inside]]) & (whole[a[inside]] < self.n) & (whole[b[inside]] < self.n)]
            out[same] += CYCLE << k
            a[same] += len(COVER) << k
            b[same] += len(COVER) << k
        place = np.append(whole, np.full(len(COVER) << len(ranks), self.n))
        return out + self._few(np.minimum(place[a], self.n), np.minimum(place[b], self.n), np.full(len(a), CYCLE))

    def _few(self, i: np.ndarray, j: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Equal words from i and j on, at most ``most`` (up to CYCLE)."""
        out = np.zeros(len(i), np.int64)
        live = np.flatnonzero(most > 0)
        for t in range(CYCLE):
            live = live[self.ids[i[live] + t] == self.ids[j[live] + t]]
            live = live[(i[live] + t < self.n) & (j[live] + t < self.n)]
            out[live] += 1
            live = live[most[live] > t + 1]
            if not len(live):
                break
        return out

    def at(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """The extension of each pair i < j; places at or beyond the end have none."""
        parts = [self._at(i[k: k + ASK_STEP], j[k: k + ASK_STEP]) for k in range(0, len(i), ASK_STEP)]
        return np.concatenate(parts) if parts else np.zeros(0, np.int64)

    def _at(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        shift = SHIFT[i % CYCLE, j % CYCLE]
        out = self._few(np.minimum(i, self.n), np.minimum(j, self.n), shift)
        on = np.flatnonzero((out == shift) & (j + shift < self.n))
        at = [self.rank[x // CYCLE * len(COVER) + SLOT[x % CYCLE]] for x in ((i + shift)[on], (j + shift)[on])]
        low, high = np.minimum(*at), np.maximum(*at)
        level = np.frexp((high - low).astype(float))[1] - 1
        rest = np.zeros(len(on), np.int64)
        for k in np.unique(level):
            mine = level == k
            rest[mine] = np.minimum(self.table[k][low[mine]], self.table[k][high[mine] - (1 << k)])
        out[on] += rest
        return out


class _Sides:
    """Extensions of one array; the table is built when a pair has CYCLE equal words."""

    def __init__(self, ids: np.ndarray):
        self.ids, self.n, self.table = ids, len(ids), None

    def at(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        out = np.zeros(len(i), np.int64)
        live = np.arange(len(i))
        for t in range(CYCLE):
            live = live[j[live] + t < self.n]
            live = live[self.ids[i[live] + t] == self.ids[j[live] + t]]
            if not len(live):
                return out
            out[live] += 1
        self.table = self.table or Extensions(self.ids)
        out[live] += self.table.at(i[live] + CYCLE, j[live] + CYCLE)
        return out


def _blocks(ids: np.ndarray, exponent: int, least: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(period, place, step) of grid blocks whose first, middle and last words agree with those one period later, in parts."""
    n = len(ids)
    period = np.arange(1, n // exponent + 1)
    step = np.maximum((np.maximum(least, exponent * period) - period) // 2, 1)
    count = np.maximum((n - period) // step, 0)
    ends = np.cumsum(count)
    k = 0
    while k < len(period):
        to = max(k + 1, int(np.searchsorted(ends, (ends[k - 1] if k else 0) + GRID_STEP, "right")))
        p, g = np.repeat(period[k:to], count[k:to]), np.repeat(step[k:to], count[k:to])
        i = (np.arange(len(p)) - np.repeat(ends[k:to] - count[k:to] - (ends[k - 1] if k else 0), count[k:to])) * g
        for offset in (lambda g: 0, lambda g: g - 1, lambda g: g // 2):
            at = i + offset(g)
            ok = ids[at] == ids[at + p]
            p, g, i = p[ok], g[ok], i[ok]
        if len(p):
            yield p, i, g
        k = to


def find_runs(ids: np.ndarray, exponent: int = 4, least: int = 6) -> np.ndarray:
    """(start, length, period) of every maximal stretch of word numbers ``ids`` with its smallest period, at least ``least`` words and ``exponent`` periods long, by start, then period."""
    if exponent < 2:
        raise ValueError("exponent is at least 2: shorter runs aren't found by whole blocks")
    n = len(ids)
    none = np.zeros((0, 3), np.int64)
    if n < max(least, exponent):
        return none
    right, left = _Sides(ids), _Sides(ids[::-1])
    found = [none]
    for p, i, g in _blocks(ids, exponent, least):
        # Neighbouring blocks of a period are asked from left to right: those that an extension reaches lie in the same stretch.
        ends = np.append(np.flatnonzero((p[1:] != p[:-1]) | (i[1:] != i[:-1] + g[1:])), len(p) - 1)
        at, stop = np.concatenate([[0], ends[:-1] + 1]), ends
        asked = []
        while len(at):
            ahead = right.at(i[at], i[at] + p[at])
            asked.append(np.column_stack([at, ahead])[ahead >= g[at]])
            at = at + ahead // g[at] + 1
            at, stop = at[at <= stop], stop[at <= stop]
        at, ahead = np.concatenate(asked).T
        p, i = p[at], i[at]
        if not len(p):
            continue
        back = left.at(n - i - p, n - i)  # the words before i and i + p, from the other end
        start, length = i - back, back + ahead + p
        long = length >= np.maximum(least, exponent * p)
        found.append(np.column_stack([start, length, p])[long])
    runs = np.concatenate(found)
    runs = runs[np.lexsort((runs[:, 2], runs[:, 1], runs[:, 0]))]
    first = np.ones(len(runs), bool)  # multiples of a stretch's smallest period hold on it as well
    first[1:] = (runs[1:, :2] != runs[:-1, :2]).any(1)
    runs = runs[first]
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def _numbers(words: list[bytes]) -> np.ndarray:
    """Equal numbers for equal words."""
    number = {w: k for k, w in enumerate(dict.fromkeys(words))}
    return np.fromiter(map(number.__getitem__, words), np.int32, len(words))


def _parts(batch: pa.RecordBatch, text: int) -> Iterator[pa.RecordBatch]:
    sizes = np.cumsum(np.concatenate([[0], [len(x.as_buffer()) if x.is_valid else 0 for x in batch.column(text)]]))
    k = 0
    while k < batch.num_rows:
        end = max(k + 1, int(np.searchsorted(sizes, sizes[k] + SLICE_BYTES)))
        yield batch.slice(k, end - k)
        k = end


def collapse_runs(docs: DataFrame, exponent: int = 4, least: int = 6, keep_spacing: bool = True) -> DataFrame:
    """docs (any columns, among them text) with each run of words cut to its first period, plus n_words and runs, array<struct<start, length, period>> by start, then period.

    Words are runs of characters other than space and U+0009 to U+000D. A run is a stretch of words with smallest period q that holds ``exponent`` periods and ``least`` words at least and that no neighbouring word extends; a word goes if a
    run contains it after that run's first q words. The text left is its words joined by one space; keep_spacing: a text that loses nothing stays as it is.

    Null texts have no words and stay null; empty ones and those of fewer words than ``least`` have no run. Long texts are searched whole, in one task each. Repeated rows are documents each. No rows give no rows. Of two runs of one
    start, that with the smaller period comes first. Other columns may have any names; those named n_words or runs are replaced.
    """
    docs = docs.drop("n_words", "runs")
    packed = Packed(docs, "text")
    slim = docs.select(F.col("text").cast("string").alias("text"), packed.rest())
    schema = StructType([*slim.schema.fields, StructField("n_words", LongType()), StructField("runs", RUNS)])
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _parts(batch, 0):
                left, counts, found = [], [], []
                for x in part.column(0):
                    raw = x.as_buffer().to_pybytes() if x.is_valid else b""
                    words = raw.split()
                    runs = find_runs(_numbers(words), exponent, least)
                    if len(runs):
                        step = np.zeros(len(words) + 1, np.int64)
                        np.add.at(step, runs[:, 0] + runs[:, 2], 1)
                        np.add.at(step, runs[:, 0] + runs[:, 1], -1)
                        words = [words[k] for k in np.flatnonzero(np.cumsum(step[:-1]) == 0)]
                    counts.append(len(step) - 1 if len(runs) else len(words))
                    text = raw if keep_spacing and not len(runs) else b" ".join(words)
                    left.append(text.decode() if x.is_valid else None)
                    found.append([{"start": s, "length": n, "period": q} for s, n, q in runs.tolist()])
                yield pa.RecordBatch.from_arrays([pa.array(left, pa.string()), part.column(1), pa.array(counts, pa.int64()), pa.array(found, kind)], ["text", "rest", "n_words", "runs"])

    return slim.mapInArrow(releasing(run), schema).select(*packed.columns(), "n_words", "runs")


def with_periodic_tails(docs: DataFrame) -> DataFrame:
    """(doc_id, text): with h the CRC-32 of doc_id in decimal and g = h // 10, texts of n > 0 words with h % 10 = 0 repeat from word a = g % n on with period
    1 + (n - a) // (3 + g % 8), their words joined by one space; other texts, and those without doc_id, stay as they are."""
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _parts(batch, 1):
                texts = []
                for i, x in zip(part.column(0).to_pylist(), part.column(1)):
                    h = 1 if i is None else zlib.crc32(str(i).encode())
                    words = x.as_py().encode().split() if x.is_valid and h % 10 == 0 else []
                    if words:
                        g, n = h // 10, len(words)
                        a = g % n
                        p = 1 + (n - a) // (3 + g % 8)
                        texts.append(b" ".join(words[:a] + [words[a + k % p] for k in range(n - a)]).decode())
                    else:
                        texts.append(x.as_py())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return slim.mapInArrow(releasing(run), "doc_id long, text string")
