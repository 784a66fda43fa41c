"""Substring dedup: words covered by a window of words that occurs anywhere else.

A window has ``window`` words. Its method is fixed-block anchors: each document is cut into non-overlapping reference blocks of
``(window + 1) // 2`` words, so that every window holds exactly one whole block of its own document. All rolling word windows of that length probe the index of blocks. A
block that is hit from elsewhere is an anchor, on both sides; every window through an anchor is a candidate. Hits are then extended: each candidate is compared in full length,
by a 128-bit hash of all its words, and what occurs twice is a repeat. Runs of repeated windows are the maximal exact repeats.

How it scales: documents are stored once, in runs of about ``chunk_bytes`` that bear a label. A run's probes leave as one sorted, delta-coded list without repetitions for each range of hashes (about 2 to 3 bytes
a probe), so a passage that all documents share is one entry per run. A range's task finds the anchors and returns to each run those that it holds. Texts are never shuffled. What returns to
a run lies in one file of the shared folder, named after the run; tasks that read the run open it, and fail if it isn't there. Writing such a file is atomic and its content depends on the input alone, so a repeated task does no harm.

A word's hash is its 128-bit XXH3 with a seed that is drawn anew for each call, so that no text can be made to fit it; its halves are joined along the window by two different functions. Both halves go with a candidate, come back to its run, and decide what is removed: with n candidate windows the chance of
any false repeat is about n**2 / 2**128.
"""

from __future__ import annotations

import hashlib
import math
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

from .storage import Packed, Workspace, open_fs, releasing, shuffle_partitions

CHUNK_BYTES = 16 << 20
SPANS = ArrayType(StructType([StructField("begin", IntegerType()), StructField("stop", IntegerType())]))
#: Text hashed at once.
SLICE_BYTES = 1 << 20
_U = np.uint64
#: Odd factors of the two halves of a window's hash: for what comes first, and for a hash that is added to others.
_FACTORS = ((_U(0x9FB21C651E98DF25), _U(0xA0761D6478BD642F)), (_U(0xD6E8FEB86659FD93), _U(0xE7037ED1A0B428DB)))


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers, in place."""
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x ^= x >> _U(shift)
        x *= _U(factor)
    x ^= x >> _U(31)
    return x


def word_hashes(texts: list[bytes], seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(halves of each word's 128-bit XXH3, one row a half; bounds of each text's words)."""
    split = [t.split() for t in texts]
    bounds = np.cumsum([0, *map(len, split)])
    digests = b"".join([xxhash.xxh3_128_digest(w, seed) for words in split for w in words])
    return np.ascontiguousarray(np.frombuffer(digests, np.uint64).reshape(-1, 2).T), bounds


def rolling(halves: np.ndarray, n: int, half: int) -> np.ndarray:
    """That half of the hash of the n words from each word on; near the end (fewer than n words left) it means nothing.

    Hashes of 1, 2, 4, ... words are joined pair by pair, and mixed at each step, so that no arrangement of words cancels out as in a sum of powers."""
    first, more = _FACTORS[half]
    run, total, at, size = halves[half].copy(), None, 0, 1

    def shifted(x: np.ndarray, k: int) -> np.ndarray:
        out = np.zeros_like(x)
        if k < len(x):
            out[: len(x) - k] = x[k:]
        return out

    while n:
        if n & 1:
            part = shifted(run, at)
            total = part if total is None else _mix(total * more ^ part)
            at += size
        n >>= 1
        if n:
            run = _mix(run * first ^ shifted(run, size))
            size *= 2
    return _mix(total)


def encode_sorted(values: np.ndarray) -> bytes:
    """Ascending distinct values as gaps of as few bytes as suit their mean; a gap that is too large takes several entries."""
    gaps = np.diff(values.astype(np.int64), prepend=-1) - 1
    mean = float(gaps.mean()) + 1 if len(gaps) else 1.0
    # Gaps of hashes are about exponential: a width's cost is its bytes times the entries that a gap takes on average.
    width = min(range(1, 5), key=lambda w: w / -math.expm1(-((1 << 8 * w) - 1) / mean))
    top = (1 << 8 * width) - 1
    more = gaps // top
    flat = np.full(int(more.sum()) + len(gaps), top, np.uint32)
    flat[np.cumsum(more + 1) - 1] = gaps - more * top
    return bytes([width]) + flat.view(np.uint8).reshape(-1, 4)[:, :width].tobytes()


def decode_sorted(blob: bytes) -> np.ndarray:
    width = blob[0]
    raw = np.frombuffer(blob, np.uint8, offset=1).reshape(-1, width)
    flat = np.zeros((len(raw), 4), np.uint8)
    flat[:, :width] = raw
    flat = flat.view(np.uint32)[:, 0].astype(np.int64)
    real = flat != (1 << 8 * width) - 1
    return (np.cumsum(flat + real) - 1)[real]


def _slices(batch: pa.RecordBatch, text: int) -> Iterator[pa.RecordBatch]:
    """Parts of the batch with about SLICE_BYTES of text."""
    sizes = np.cumsum(np.concatenate([[0], [len(x.as_buffer()) if x.is_valid else 0 for x in batch.column(text)]]))
    k = 0
    while k < batch.num_rows:
        end = max(k + 1, int(np.searchsorted(sizes, sizes[k] + SLICE_BYTES)))
        yield batch.slice(k, end - k)
        k = end


def _texts(batch: pa.RecordBatch, text: int) -> list[bytes]:
    """The bytes of the text column; null: none."""
    return [x.as_buffer().to_pybytes() if x.is_valid else b"" for x in batch.column(text)]


class Words:
    """Hashes of the words of some documents."""

    def __init__(self, batch: pa.RecordBatch, text: int, window: int, seed: int):
        self.window, self.block = window, (window + 1) // 2
        self.hash, self.bounds = word_hashes(_texts(batch, text), seed)
        self.n = self.hash.shape[1]
        size = np.diff(self.bounds)
        doc = np.repeat(np.arange(len(size)), size)
        self.place = np.arange(self.n) - self.bounds[:-1][doc]
        self.left = size[doc] - self.place  # words from here to the document's end
        self.long = size[doc] >= window

    def probes(self, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(places, hashes of ``bits`` bits, whether a reference block) of the rolling windows of block length."""
        at = np.flatnonzero((self.left >= self.block) & self.long)
        return at, rolling(self.hash, self.block, 0)[at] >> _U(64 - bits), self.place[at] % self.block == 0

    def candidates(self, anchors: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(places, both halves of the hashes) of the windows that hold an anchor; anchors: ascending hashes of ``bits`` bits."""
        at, h, _ = self.probes(bits)
        held = np.zeros(self.n + 1, np.int64)
        held[at[_among(h.astype(np.int64), anchors)] + 1] = 1
        held = np.cumsum(held)
        place = np.flatnonzero(self.left >= self.window)
        place = place[held[place + self.window - self.block + 1] > held[place]]
        return place, rolling(self.hash, self.window, 0)[place], rolling(self.hash, self.window, 1)[place]

    def covered(self, places: np.ndarray) -> np.ndarray:
        """Whether each word lies in a window that begins at one of the places."""
        step = np.zeros(self.n + 1, np.int64)
        step[places] += 1
        step[places + self.window] -= 1
        return np.cumsum(step)[:-1] > 0


def _among(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    if not len(known):
        return np.zeros(len(values), bool)
    at = np.searchsorted(known, values)
    at[at == len(known)] = 0
    return known[at] == values


def _pairs_among(h: np.ndarray, g: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Whether each pair (h, g) is a row of known, which ascends by both columns."""
    out = np.zeros(len(h), bool)
    if not len(known):
        return out
    first, second = np.ascontiguousarray(known[:, 0]), known[:, 1]
    at = np.searchsorted(first, h)
    live = np.flatnonzero(at < len(first))
    while len(live := live[first[at[live]] == h[live]]):  # more than once only where different windows share the first half
        out[live] |= second[at[live]] == g[live]
        at[live] += 1
        live = live[at[live] < len(first)]
    return out


def _unique_pairs(h: np.ndarray, g: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(pairs in ascending order, each once, as two arrays; how often each is there)."""
    order = np.lexsort((g, h))
    h, g = h[order], g[order]
    first = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (g[1:] != g[:-1])]))
    return h[first], g[first], np.diff(np.append(first, len(h)))


def _runs(batches: Iterator[pa.RecordBatch], label: int) -> Iterator[tuple[int, pa.RecordBatch]]:
    """(run's label, rows) in parts."""
    for b in batches:
        labels = b.column(label).to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(np.diff(labels)) + 1), b.num_rows]
        for s, e in zip(cuts, cuts[1:]):
            if e > s:
                yield int(labels[s]), b.slice(s, e - s)


class _Files:
    """What came back to the runs: one file of int64 or uint64 values a run."""

    def __init__(self, folder: str):
        self.folder = folder

    def put(self, label: int, values: np.ndarray) -> None:
        fs, root = open_fs(self.folder)
        fs.create_dir(root, recursive=True)
        with fs.open_output_stream(part := f"{root}/.{uuid.uuid4().hex}") as f:
            f.write(values.tobytes())
        fs.move(part, f"{root}/{label}")

    def get(self, label: int, kind: type) -> np.ndarray:
        fs, root = open_fs(self.folder)
        with fs.open_input_file(f"{root}/{label}") as f:
            return np.frombuffer(f.read(), kind)


def _label(docs: DataFrame, chunk_bytes: int) -> DataFrame:
    """docs with a column _run: rows of about chunk_bytes of text that follow one another share a label."""
    names = docs.columns
    text = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        label, held = uuid.uuid4().int >> 65, 0
        for b in batches:
            labels = []
            for x in b.column(text):
                if held >= chunk_bytes:
                    label, held = uuid.uuid4().int >> 65, 0
                labels.append(label)
                held += 64 + (len(x.as_buffer()) if x.is_valid else 0)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(labels, pa.int64())], [*names, "_run"])

    return docs.mapInArrow(releasing(run), StructType([*docs.schema.fields, StructField("_run", LongType())]))


def find_repeats(runs: DataFrame, ws: Workspace, window: int, chunk_bytes: int, total_bytes: int, seed: int) -> _Files:
    """Files with the hashes of the repeated windows of each run of ``runs`` (text, _run)."""
    bits = min(56, max(16, math.ceil(math.log2(max(2, total_bytes / 6))) + 6))
    buckets = 1 << max(3, math.ceil(math.log2(max(1, total_bytes / chunk_bytes, shuffle_partitions(runs.sparkSession)))))
    shift = bits - (buckets.bit_length() - 1)
    slim = runs.select("text", "_run")

    def send(held: list[np.ndarray], label: int) -> pa.RecordBatch:
        """A run's probes: value (hash, then whether any is a block), each once, and whether it is repeated in the run."""
        keys = np.sort(np.concatenate(held))
        h = keys >> _U(1)
        first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        last = np.append(first[1:], len(h)) - 1
        block, many, h = (keys[last] & _U(1)).astype(bool), last > first, h[first].astype(np.int64)
        cuts = np.searchsorted(h, np.arange(buckets + 1, dtype=np.int64) << shift)
        rows = [(k, label, encode_sorted(h[s:e] - (k << shift)), np.packbits(np.concatenate([block[s:e], many[s:e]])).tobytes()) for k, (s, e) in enumerate(zip(cuts, cuts[1:])) if e > s]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.int64(), pa.binary(), pa.binary()))], ["bucket", "_run", "h", "flags"])

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        now = None
        for label, rows in _runs(batches, 1):
            if label != now and held:
                yield send(held, now)
                held = []
            now = label
            for part in _slices(rows, 0):
                _, h, block = Words(part, 0, window, seed).probes(bits)
                if len(h):
                    held.append(h << _U(1) | block.astype(np.uint64))
        if held:
            yield send(held, now)

    def anchors(pdf: pd.DataFrame) -> pd.DataFrame:
        """Per run: the hashes of this range that stand for a block and stand in two places at least."""
        lists = [decode_sorted(b) for b in pdf["h"]]
        flags = [np.unpackbits(np.frombuffer(f, np.uint8), count=2 * len(x)).astype(bool).reshape(2, -1) for f, x in zip(pdf["flags"], lists)]
        h, block, many = np.concatenate(lists), np.concatenate([f[0] for f in flags]), np.concatenate([f[1] for f in flags])
        found = _twice(h, many, block)
        out = [(int(run), encode_sorted(x[_among(x, found)])) for run, x in zip(pdf["_run"], lists) if len(found) and _among(x, found).any()]
        return pd.DataFrame(out, columns=["_run", "h"]).assign(bucket=pdf["bucket"].iloc[0] if len(pdf) else 0)

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, known = None, np.zeros(0, np.int64)
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def done() -> pa.RecordBatch:
            keys, second, n = _unique_pairs(*(np.concatenate(x) for x in zip(*held)))
            top = (keys >> _U(64 - buckets.bit_length() + 1)).astype(np.int64)
            cuts = np.searchsorted(top, np.arange(buckets + 1))
            rows = [(k, now, keys[s:e].tobytes(), second[s:e].tobytes(), np.packbits(n[s:e] > 1).tobytes()) for k, (s, e) in enumerate(zip(cuts, cuts[1:])) if e > s]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary()))], ["bucket", "_run", "h", "second", "flags"])

        for label, rows in _runs(batches, 1):
            if label != now:
                if held:
                    yield done()
                now, known, held = label, anchor_files.get(label, np.int64), []
            if len(known):
                for part in _slices(rows, 0):
                    _, h, second = Words(part, 0, window, seed).candidates(known, bits)
                    if len(h):
                        held.append((h, second))
        if held:
            yield done()

    def repeats(pdf: pd.DataFrame) -> pd.DataFrame:
        """Per run: the hashes (both halves) of this range whose windows stand in two places at least."""
        lists, second = ([np.frombuffer(b, np.uint64) for b in pdf[c]] for c in ("h", "second"))
        many = np.concatenate([np.unpackbits(np.frombuffer(f, np.uint8), count=len(x)).astype(bool) for f, x in zip(pdf["flags"], lists)])
        h, g, run = np.concatenate(lists), np.concatenate(second), np.repeat(pdf["_run"].to_numpy(), [len(x) for x in lists])
        order = np.lexsort((g, h))
        h, g, run, many = h[order], g[order], run[order], many[order]
        same = (h[1:] == h[:-1]) & (g[1:] == g[:-1])
        ok = many | np.append(same, False) | np.append(False, same)
        h, g, run = h[ok], g[ok], run[ok]
        order = np.argsort(run, kind="stable")
        pairs, run = np.column_stack([h, g])[order], run[order]
        cuts = [0, *(np.flatnonzero(np.diff(run)) + 1), len(run)]
        out = [(int(run[s]), pairs[s:e].tobytes()) for s, e in zip(cuts, cuts[1:]) if e > s]
        return pd.DataFrame(out, columns=["_run", "h"]).assign(bucket=pdf["bucket"].iloc[0] if len(pdf) else 0)

    def store(files: _Files, coded: bool):
        def put(pdf: pd.DataFrame) -> pd.DataFrame:
            label, pdf = int(pdf["_run"].iloc[0]), pdf[pdf["bucket"] >= 0].sort_values("bucket")
            # Ranges ascend, and so do the hashes in each.
            parts = [decode_sorted(h) + (int(k) << shift) if coded else np.frombuffer(h, np.uint64) for k, h in zip(pdf["bucket"], pdf["h"])]
            files.put(label, np.concatenate(parts) if parts else np.zeros(0, np.uint64))
            return pd.DataFrame({"_run": [label]})

        return put

    sent, back = "bucket int, _run long, h binary, flags binary", "_run long, h binary, bucket int"
    sent_windows = "bucket int, _run long, h binary, second binary, flags binary"
    anchor_files, repeat_files = _Files(f"{ws.path}/anchors"), _Files(f"{ws.path}/repeats")
    for made, schema, reduce, files, coded in ((probe, sent, anchors, anchor_files, True), (windows, sent_windows, repeats, repeat_files, False)):
        found = slim.mapInArrow(releasing(made), schema).groupBy("bucket").applyInPandas(reduce, back)
        each = slim.select("_run").distinct().select("_run", F.lit(b"").alias("h"), F.lit(-1).alias("bucket"))  # a run to which nothing returns has an empty file
        found.unionByName(each).groupBy("_run").applyInPandas(store(files, coded), "_run long").count()
    ws.drop("anchors")
    return repeat_files


def _twice(h: np.ndarray, many: np.ndarray, needed: np.ndarray | None) -> np.ndarray:
    """The ascending values of h that stand in two places (two entries, or one marked many), one of them marked needed."""
    if not len(h):
        return h
    order = np.argsort(h, kind="stable")
    h = h[order]
    first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
    ok = (np.diff(np.append(first, len(h))) > 1) | np.logical_or.reduceat(many[order], first)
    if needed is not None:
        ok &= np.logical_or.reduceat(needed[order], first)
    return h[first[ok]]


def remove_repeats(docs: DataFrame, window: int = 35, chunk_bytes: int = CHUNK_BYTES, digest: bool = False, keep_spacing: bool = True, counts: bool = True) -> DataFrame:
    """docs (any columns, among them text) without the words that a repeated window covers, plus n_words, n_removed and spans, array<struct<begin int, stop int>>: the removed
    runs of words, the maximal exact repeats (overlapping ones merged). The text left is its words joined by one space; keep_spacing: a text that loses nothing stays as it is.
    digest: instead of docs' columns, doc_id, n_words, n_removed, kept_sha256 (of the kept words joined by one space).

    Words are runs of characters other than space and U+0009 to U+000D. Null texts have no words and stay null; empty and short ones lose nothing. Long texts are worked on whole, by one task each, with about 30 bytes a byte of text. Repeated rows are documents each, so they lose
    what they share. No rows give no rows. Other columns may have any names; those named n_words, n_removed or spans are replaced. counts: False leaves docs' columns as they are and adds none; n_chars, if
    it is there, follows the text then.
    """
    ws = Workspace(docs.sparkSession, "substrings")
    docs = docs.drop("n_words", "n_removed", "spans") if counts else docs
    packed = Packed(docs, "text")
    kept = docs.select(F.col("text").cast("string").alias("text"), packed.rest())
    if digest:
        kept = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    runs = ws.save(_label(kept, chunk_bytes).withColumn("_bytes", F.octet_length("text")), "runs")
    total = runs.agg(F.sum("_bytes")).first()[0] or 0
    seed = uuid.uuid4().int >> 65
    files = find_repeats(runs, ws, window, chunk_bytes, total, seed)
    names = kept.columns
    text = names.index("text")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, known = None, np.zeros((0, 2), np.uint64)
        for label, rows in _runs(batches, len(names)):
            if label != now:
                now, known = label, files.get(label, np.uint64).reshape(-1, 2)
            for part in _slices(rows, text):
                yield _finish(part, known)

    def _finish(part: pa.RecordBatch, known: np.ndarray) -> pa.RecordBatch:
        gone, bounds = None, None
        if len(known):
            words = Words(part, text, window, seed)
            place = np.flatnonzero(words.left >= window)
            place = place[_pairs_among(rolling(words.hash, window, 0)[place], rolling(words.hash, window, 1)[place], known)]
            gone, bounds = words.covered(place), words.bounds
            lost = np.add.reduceat(np.append(gone, False).astype(np.int64), bounds[:-1]) * (np.diff(bounds) > 0)
        n, removed, out, spans = [], [], [], []
        for k, x in enumerate(part.column(text)):
            raw = x.as_buffer().to_pybytes() if x.is_valid else b""
            split = raw.split()
            took = int(lost[k]) if gone is not None else 0
            n.append(len(split))
            removed.append(took)
            spans.append([])
            if took:
                mine = gone[bounds[k]: bounds[k + 1]]
                edges = np.flatnonzero(np.diff(np.concatenate([[0], mine.view(np.int8), [0]])))
                spans[-1] = [{"begin": int(s), "stop": int(e)} for s, e in zip(edges[::2], edges[1::2])]
                split = [w for w, g in zip(split, mine.tolist()) if not g]
            left = b" ".join(split) if digest or took or not keep_spacing else raw
            out.append(hashlib.sha256(left).hexdigest() if digest else left.decode() if x.is_valid else None)
        counts = [pa.array(n, pa.int64()), pa.array(removed, pa.int64())]
        if digest:
            return pa.RecordBatch.from_arrays([part.column(0), *counts, pa.array(out, pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256"])
        columns = [pa.array(out, pa.string()) if k == text else part.column(k) for k in range(len(names))]
        kind = pa.list_(pa.struct([("begin", pa.int32()), ("stop", pa.int32())]))
        return pa.RecordBatch.from_arrays([*columns, *counts, pa.array(spans, kind)], [*names, "n_words", "n_removed", "spans"])

    if digest:
        schema = "doc_id long, n_words long, n_removed long, kept_sha256 string"
    else:
        schema = StructType([*kept.schema.fields]).add("n_words", "long").add("n_removed", "long").add("spans", SPANS)
    found = runs.select(*names, "_run").mapInArrow(releasing(cut), schema)
    if digest:
        return found
    if counts:
        return found.select(*packed.columns(), "n_words", "n_removed", "spans")
    if "n_chars" not in docs.columns:
        return found.select(*packed.columns())
    at = F.col(f"rest.c{packed.others.index('n_chars')}")
    length = F.when(F.col("n_removed") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(at)
    return found.select(*[length.alias(c) if c == "n_chars" else x for c, x in zip(packed.names, packed.columns())])
