"""SimHash near-duplicates: fingerprints linked by a binary trie self-join.

A fingerprint's bit is set if more than half of the document's word shingles have it set in their hash (XXH64; further words of a longer fingerprint mix that hash).
Distinct fingerprints (copies meet first, by a partial aggregate) form a binary trie. Node pairs of the trie are traversed together; differing bits add up, and a pair
is pruned once they exceed the budget of its depth.

An ``Order`` is a sequence of the bits and a budget for each depth. Two sets of orders are used:

* ``ring_orders`` lose nothing: ``budget`` errors in a ring of ``budget + 1`` blocks of bits leave a block from which on the first block has no error, the first two at most one,
  and so on. So one order begins at each block, with budgets 0, 1, 2, ... by block.
* ``sampled_orders`` are for long fingerprints and wide budgets, where no exact order prunes: each is a random sequence of bits whose first bits must agree. There are so many of them that
  two fingerprints that differ in a given share of bits miss all with a stated chance; their number grows with a small power of the rows.

The first bits of an order split its trie among tasks. A task joins two trie nodes within the budget; a node with more than ``node_rows`` fingerprints is cut into
blocks, and every pair of blocks gets a task, so no group outgrows a task and no link is lost. The table of node sizes has at most 2**MAX_DEPTH rows an order.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .components import ClosestForest, Forest, connected_components
from .storage import Packed, Workspace, releasing

#: Shingles whose bits are counted at once.
RUN = 200_000
MAX_DEPTH = 18
#: Pairs of a trie node pair that are compared at once rather than split further.
LEAF = 12


def _shingle_hashes(text: str | None, shingle: int, seed: int) -> list[int]:
    import xxhash

    xxh = xxhash.xxh64_intdigest
    words = (text or "").encode("utf-8", "replace").lower().split()  # bytes: A-Z only; splits at \x20 \x09-\x0D
    if not words:
        return []
    joined = b" ".join(words)
    if len(words) <= shingle:
        return [xxh(joined, seed)]
    gaps = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    starts = [0, *(gaps[: len(words) - shingle] + 1).tolist()]
    ends = [*gaps[shingle - 1:].tolist(), len(joined)]
    return [xxh(joined[s:e], seed) for s, e in zip(starts, ends)]


def _bit_counts(hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Per run of hashes that begins at starts: how often each of the 64 bits is set."""
    lanes = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").view(np.uint64)
    sizes = np.diff(np.append(starts, len(hashes)))
    pieces = -(-sizes // 255)  # a byte lane holds 255 at most
    first = np.repeat(np.cumsum(pieces) - pieces, pieces)
    cuts = np.repeat(starts, pieces) + 255 * (np.arange(pieces.sum()) - first)
    part = np.add.reduceat(lanes, cuts, axis=0).view(np.uint8).reshape(len(cuts), 64).astype(np.int64)
    return np.add.reduceat(part, np.cumsum(pieces) - pieces, axis=0)


def _word(hashes: np.ndarray, k: int) -> np.ndarray:
    """The k-th 64 bits that a shingle's hash stands for; the first are the hash itself."""
    if not k:
        return hashes
    x = hashes + np.uint64(k * 0x9E3779B97F4A7C15 % 2**64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def fingerprints_of(each: Iterator[np.ndarray], n: int, words: int = 1) -> np.ndarray:
    """The fingerprints (n, words) as uint64 of n documents' shingle hashes; no shingles give 0."""
    out = np.zeros((n, words), np.uint64)
    weights = (np.uint64(1) << np.arange(64, dtype=np.uint64))
    held: list[np.ndarray] = []
    who: list[int] = []
    total = 0

    def flush() -> None:
        nonlocal total
        if who:
            sizes, all_of = np.array([len(h) for h in held]), np.concatenate(held)
            for k in range(words):
                counts = _bit_counts(_word(all_of, k), np.cumsum(sizes) - sizes)
                out[who, k] = ((2 * counts > sizes[:, None]) * weights).sum(axis=1, dtype=np.uint64)
        held.clear()
        who.clear()
        total = 0

    for i, hashes in enumerate(each):
        if len(hashes) > RUN:  # a very long text: its runs are summed
            for w in range(words):
                counts = sum(_bit_counts(_word(hashes[k: k + RUN], w), np.array([0]))[0] for k in range(0, len(hashes), RUN))
                out[i, w] = ((2 * counts > len(hashes)) * weights).sum(dtype=np.uint64)
        elif len(hashes):
            held.append(hashes)
            who.append(i)
            total += len(hashes)
            if total >= RUN:
                flush()
    flush()
    return out


def fingerprints(texts: list[str | None], shingle: int = 4, seed: int = 42) -> np.ndarray:
    """The texts' fingerprints of 64 bits as uint64, from all shingles, repeats included; no words give 0."""
    each = (np.array(_shingle_hashes(t, shingle, seed), np.uint64) for t in texts)
    return fingerprints_of(each, len(texts))[:, 0]


def add_fingerprint(docs: DataFrame, shingle: int = 4, seed: int = 42) -> DataFrame:
    """(doc_id, fp long) of each row of docs (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = fingerprints(b.column(1).to_pylist(), shingle, seed).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp)], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(releasing(run), "doc_id long, fp long")


@dataclass(frozen=True)
class Order:
    """bits: the first 64 of the fingerprint's bits in this order (bit 0 is the highest of the first word). limit: by depth 0..64, how many of the bits so far may differ."""

    bits: tuple[int, ...]
    limit: tuple[int, ...]

    def words(self, fp: np.ndarray) -> np.ndarray:
        """The bits of fingerprints (n, words) as one uint64 each, the order's first bit highest."""
        if fp.shape[1] == 1 and self.bits == tuple((self.bits[0] + k) % 64 for k in range(64)):
            k = np.uint64(self.bits[0])
            return fp[:, 0] if not k else (fp[:, 0] << k) | (fp[:, 0] >> (np.uint64(64) - k))
        flat = np.unpackbits(np.ascontiguousarray(fp.astype(">u8")).view(np.uint8).reshape(len(fp), -1), axis=1)
        return np.ascontiguousarray(np.packbits(flat[:, list(self.bits)], axis=1)).view(">u8")[:, 0].astype(np.uint64)

    def masks(self, depth: int) -> list[int]:
        """The differences in the first ``depth`` bits that the limits allow."""
        found = [(0, 0)]
        for d in range(depth):
            found = [(m << 1 | x, n + x) for m, n in found for x in (0, 1) if n + x <= self.limit[d + 1]]
        return [m for m, _ in found]


def ring_orders(budget: int) -> list[Order]:
    """For 64 bits: every pair that differs in at most ``budget`` (under 64) bits is within the limits of one order at least."""
    cuts = [64 * k // (budget + 1) for k in range(budget + 2)]
    out = []
    for first in range(budget + 1):
        blocks = [(first + k) % (budget + 1) for k in range(budget + 1)]
        bits = [b for k in blocks for b in range(cuts[k], cuts[k + 1])]
        out.append(Order(tuple(bits), (0, *[n for n, k in enumerate(blocks) for _ in range(cuts[k], cuts[k + 1])])))
    return out


def share_apart(similarity: float) -> float:
    """The share of bits in which the fingerprints of two sets of equal size and this Jaccard likeness differ on average: their angle."""
    return math.acos(2 * similarity / (1 + similarity)) / math.pi


def sampled_orders(bits: int, rows: int, apart: float, budget: int, miss: float = 0.01, node: int = 256, seed: int = 7) -> list[Order]:
    """Orders whose first bits, so many that a node of ``rows`` holds about ``node``, must agree; below, each 16 bits' limit leaves ``apart`` 3.6 standard deviations.
    A pair that differs in the share ``apart`` of its bits agrees in no order's first bits with chance ``miss``."""
    agree = max(0, math.ceil(math.log2(max(1, rows / node))))
    n = 1 if not agree else math.ceil(math.log(miss) / math.log1p(-((1 - apart) ** agree)))
    rng = np.random.default_rng(seed)
    limit = [0 if d <= agree else min(budget, math.floor(e * apart + 3.6 * math.sqrt(e * apart * (1 - apart)))) for d in range(65) for e in [-(-d // 16) * 16]]
    return [Order(tuple(rng.permutation(bits)[:64].tolist()), tuple(limit)) for _ in range(n)]


def trie_pairs(a: np.ndarray, b: np.ndarray | None, limit: tuple[int, ...], leaf: int = LEAF) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (index in a, index in b) of sorted uint64 arrays within the limits by depth; b None: pairs within a. A pair that is over a limit may be given if it keeps to limit[64]. Runs of bounded length."""
    same = b is None
    b = a if same else b
    if not len(a) or not len(b):
        return
    ones_of: dict[tuple[int, int], np.ndarray] = {}

    def ones(side: int, d: int) -> np.ndarray:
        if (side, d) not in ones_of:
            bits = ((a if side == 0 else b) >> np.uint64(63 - d)) & np.uint64(1)
            ones_of[side, d] = np.concatenate([[0], np.cumsum(bits.astype(np.int64))])
        return ones_of[side, d]

    def compared(part: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        width = part[:, 3] - part[:, 2]
        n = (part[:, 1] - part[:, 0]) * width
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        w = np.repeat(width, n)
        i, j = np.repeat(part[:, 0], n) + at // w, np.repeat(part[:, 2], n) + at % w
        ok = np.bitwise_count(a[i] ^ b[j]) <= limit[64]
        if same:
            ok &= i < j
        if ok.any():
            yield i[ok], j[ok]

    stack = [(0, np.array([[0, len(a), 0, len(b), 0]], np.int64))]
    while stack:
        d, node = stack.pop()
        pairs = (node[:, 1] - node[:, 0]) * (node[:, 3] - node[:, 2])
        small = (pairs <= leaf) | (d >= 64)
        ends = node[small]
        if len(ends):
            run = (np.cumsum(pairs[small]) - 1) // 1_000_000
            for big in np.split(ends, np.flatnonzero(np.diff(run)) + 1):
                if (big[:, 1] - big[:, 0]).max() * (big[:, 3] - big[:, 2]).max() <= 4_000_000:
                    yield from compared(big)
                else:  # very many equal words: by rows
                    for lo, hi, x, y, n in big.tolist():
                        step = max(1, 1_000_000 // (y - x))
                        for k in range(lo, hi, step):
                            yield from compared(np.array([[k, min(hi, k + step), x, y, n]]))
        node = node[~small]
        if not len(node):
            continue
        if len(node) > 400_000:
            stack += [(d, node[k: k + 200_000]) for k in range(0, len(node), 200_000)]
            continue
        ca = ones(0, d)
        cb = ca if same else ones(1, d)
        ma = node[:, 1] - (ca[node[:, 1]] - ca[node[:, 0]])
        mb = node[:, 3] - (cb[node[:, 3]] - cb[node[:, 2]])
        out = []
        for x in (0, 1):
            for y in (0, 1):
                child = np.stack([ma if x else node[:, 0], node[:, 1] if x else ma, mb if y else node[:, 2], node[:, 3] if y else mb, node[:, 4] + (x != y)], axis=1)
                keep = (child[:, 1] > child[:, 0]) & (child[:, 3] > child[:, 2]) & (child[:, 4] <= limit[d + 1])
                if same and x > y:  # (0, 1) of a node with itself has these pairs
                    keep &= ~((node[:, 0] == node[:, 2]) & (node[:, 1] == node[:, 3]))
                out.append(child[keep])
        out = np.concatenate(out)
        if len(out):
            stack.append((d + 1, out))


def link_fingerprints(classes: DataFrame, ws: Workspace, orders: list[Order], budget: int, node_rows: int = 4096, closest: bool = False, leaf: int = LEAF) -> DataFrame:
    """Links (u, v) of classes (id long, fp binary: big-endian words) whose fingerprints differ in at most ``budget`` bits: each task gives a spanning forest of those that it finds, no pair list.
    closest: the forest with the least differences."""
    n = classes.count()
    route = min([MAX_DEPTH, max(3, math.ceil(math.log2(max(1, n / node_rows))))])

    def fps(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
        return np.frombuffer(b"".join(column.to_pylist()), ">u8").astype(np.uint64).reshape(len(column), -1)

    def nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                fp = fps(b.column(0))
                for o, order in enumerate(orders):
                    p, count = np.unique(order.words(fp) >> np.uint64(64 - route), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(p), o, np.int32)), pa.array(p.astype(np.int64)), pa.array(count)], ["o", "p", "n"])

    # Only nodes that are cut into blocks are gathered: at most rows / node_rows an order.
    sizes = classes.select("fp").mapInArrow(releasing(nodes), "o int, p long, n long").groupBy("o", "p").agg(F.sum("n").alias("n"))
    hot = {(r.o, r.p): -(-r.n // node_rows) for r in sizes.where(F.col("n") > node_rows).collect()}
    known = sorted({o for o, _ in hot})
    hot_of = {o: (np.array(sorted(p for q, p in hot if q == o), np.int64)) for o in known}
    many_of = {o: np.array([hot[o, p] for p in hot_of[o].tolist()], np.int64) for o in known}

    def blocks(o: int, p: np.ndarray) -> np.ndarray:
        """How many blocks the nodes are cut into."""
        out = np.ones(len(p), np.int64)
        if o in hot_of:
            at = np.minimum(np.searchsorted(hot_of[o], p), len(hot_of[o]) - 1)
            out = np.where(hot_of[o][at] == p, many_of[o][at], 1)
        return out

    def own_block(ids: np.ndarray, many: np.ndarray) -> np.ndarray:
        return ((ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64) % many

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each class goes to every pair of blocks (of its node and of a node within the limits) that its block is in: key p << 20 | block."""
        for whole in batches:
            for s in range(0, whole.num_rows, 4096):
                b = whole.slice(s, 4096)
                ids, fp = b.column(0).to_numpy(), fps(b.column(1))
                for o, order in enumerate(orders):
                    p = (order.words(fp) >> np.uint64(64 - route)).astype(np.int64)
                    own = p << 20 | own_block(ids, blocks(o, p))
                    for mask in order.masks(route):
                        many = blocks(o, p ^ mask)
                        at = np.repeat(np.arange(len(p)), many)
                        other = (p ^ mask)[at] << 20 | np.arange(len(at)) - np.repeat(np.cumsum(many) - many, many)
                        mine, take = own[at], pa.array(at)
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), o, np.int32)), pa.array(np.minimum(mine, other)), pa.array(np.maximum(mine, other)), pa.array(mine <= other), b.column(0).take(take), b.column(1).take(take)], ["o", "x", "y", "low", "id", "fp"])

    def join(table: pa.Table) -> pa.Table:
        order, same = orders[table.column("o")[0].as_py()], table.column("x")[0].as_py() == table.column("y")[0].as_py()
        fp, ids, low = fps(table.column("fp")), table.column("id").to_numpy(), table.column("low").to_numpy()
        word = order.words(fp)
        sides = [np.flatnonzero(low)] if same else [np.flatnonzero(low), np.flatnonzero(~low)]
        sides = [s[np.argsort(word[s], kind="stable")] for s in sides]
        forest = ClosestForest(len(ids)) if closest else Forest(len(ids))
        for i, j in trie_pairs(word[sides[0]], None if same else word[sides[1]], order.limit, leaf):
            i, j = sides[0][i], sides[-1][j]
            apart = np.bitwise_count(fp[i] ^ fp[j]).sum(axis=1)
            ok = apart <= budget
            forest.add(i[ok], j[ok], *([apart[ok]] if closest else []))
        u, v = forest.links()
        return pa.table({"u": pa.array(ids[u], pa.int64()), "v": pa.array(ids[v], pa.int64())})

    dealt = classes.select("id", "fp").mapInArrow(releasing(deal), "o int, x long, y long, low boolean, id long, fp binary")
    return dealt.groupBy("o", "x", "y").applyInArrow(join, "u long, v long")


def near_duplicates(docs: DataFrame, shingle: int = 4, seed: int = 42, budget: int = 4, node_rows: int = 4096, in_task: int | None = None) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, fp long, component_id (the smallest doc_id reachable by links), root (a fingerprint that names the component).

    Null, empty and blank texts have fingerprint zero and are linked like any other. All shingles of a long text count. Repeated rows each give a row.
    Rows with a null doc_id get their component's smallest doc_id, null where it has none. Other columns are not
    looked at; no rows give no rows.
    """
    ws = Workspace(docs.sparkSession, "simhash")
    rows = ws.save(add_fingerprint(docs, shingle, seed), "fp")
    classes = ws.save(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "classes")
    links = link_fingerprints(classes.select(F.col("fp").alias("id"), F.unhex(F.lpad(F.hex("fp"), 16, "0")).alias("fp")), ws, ring_orders(budget), budget, node_rows)
    roots = connected_components(links, ws, **({} if in_task is None else {"in_task": in_task}))
    of = classes.join(roots, classes["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    of = ws.save(of, "roots")
    least = of.groupBy("root").agg(F.min("least").alias("component_id"))
    return rows.join(of.join(least, "root").select("fp", "root", "component_id"), "fp").select("doc_id", "fp", "component_id", "root")


# --- groups of documents by likeness: long fingerprints, sampled orders, links checked by whole shingle sets ---


def shingle_set(text: str | None, shingle: int = 5, seed: int = 42) -> np.ndarray:
    """Distinct shingle hashes in ascending order; fewer words than a shingle are one shingle, no words none."""
    return np.unique(np.array(_shingle_hashes(text, shingle, seed), np.uint64))


def alike(x: np.ndarray, y: np.ndarray, num: int, den: int) -> bool:
    """Whether two sets (ascending) have a Jaccard likeness of num / den or more, in whole numbers."""
    if min(len(x), len(y)) * den < max(len(x), len(y)) * num:
        return False
    shared = len(np.intersect1d(x, y, assume_unique=True))
    return shared * (num + den) >= (len(x) + len(y)) * num


def _class_of(hashes: np.ndarray) -> int:
    import xxhash

    found = xxhash.xxh64_intdigest(hashes.tobytes(), 42)
    return found - (1 << 64 if found >> 63 else 0)


#: Shingles that go last in every prefix at most; they are counted in every SHARE-th document, or in COUNTED where that is more.
COMMON, SHARE, COUNTED = 1_000_000, 8, 4096


def _common(docs: DataFrame, ws: Workspace, rows: int, shingle: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes (ascending, uint64) of shingles in three or more of the documents of different text that are counted, the most frequent, at most COMMON of them; and how common each is (log2 of its documents).
    They only order prefixes: any choice gives the same links. As the share of documents is fixed, a shingle that is left out is in some two dozen documents at most, whatever the input, and pairs that
    meet by it grow with the documents, not with their square."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for t in b.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(shingle_set(t, shingle, seed).view(np.int64))], ["s"])

    some = docs.where(F.pmod(F.xxhash64("digest"), F.lit(max(1, min(SHARE, rows // COUNTED)))) == 0).dropDuplicates(["digest"])
    counts = ws.save(some.select("text").mapInArrow(releasing(read), "s long").groupBy("s").agg(F.count("*").alias("n")).where("n >= 3"), "common")
    left, least = COMMON, None
    for r in counts.groupBy("n").agg(F.count("*").alias("many")).orderBy(F.desc("n")).collect():
        left -= r.many
        if left < 0:
            break
        least = r.n
    got = counts.where(F.col("n") >= least).toArrow() if least else pa.table({"s": pa.array([], pa.int64()), "n": pa.array([], pa.int64())})
    ws.drop("common")
    s, n = got.column("s").to_numpy().view(np.uint64), got.column("n").to_numpy()
    at = np.argsort(s)
    return s[at], np.log2(n[at]).astype(np.uint8)


def prefix(hashes: np.ndarray, common: tuple[np.ndarray, np.ndarray], num: int, den: int) -> np.ndarray:
    """The first elements of a set (ascending) in an order of all hashes, common ones last: so many that two sets of a likeness of num / den or more share one of them."""
    n, (known, tier) = len(hashes), common
    if len(known) and n:
        at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
        hashes = hashes[np.argsort(np.where(known[at] == hashes, tier[at], 0), kind="stable")]
    return hashes[: n - -(-n * num // den) + 1] if n else hashes


def parities(hashes: np.ndarray) -> bytes:
    """At least 64 bits, a power of two, and two to four for each element: whether an odd number of the set's hashes end with that number. Two sets' bits differ in no more places than the sets do in elements."""
    size = max(64, 1 << (2 * len(hashes) - 1).bit_length()) if len(hashes) else 64
    return np.packbits((np.bincount((hashes & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1).astype(np.uint8)).tobytes()


def parities_apart(x: bytes, y: bytes) -> int:
    """In how many places the parities of two sets differ; the longer are folded to the shorter's length first."""
    a, b = sorted((np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)), key=len)
    while len(b) > len(a):
        b = b[: len(b) // 2] ^ b[len(b) // 2:]
    return int(np.bitwise_count(a ^ b).sum(dtype=np.int64))


#: So many elements more than one must two prefixes share, where they are that long.
MORE = 2


def _met(met: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs (u, v, both) of classes of different roots, from rows (s, id, root, n, p) of the elements of their prefixes, that can share as many elements as the likeness asks for; both: their elements.

    Two sets that must share o elements share one of their first n - o + 1, and so one more for each place more. What two sets share in these places is counted (k), at most MORE places further;
    what else they share comes after the last of it in either set, and is outside the places of one of them, that whose places end first. All places would make more rows of groups that are almost alike."""
    a, b = (met.select("s", *[F.col(c).alias(f"{c}_{k}") for c in ("id", "root", "n", "p")]) for k in "ab")
    asked = f">= (n_a + n_b) * {num}"
    rows = a.join(b.hint("merge"), "s").where(f"id_a < id_b AND root_a <> root_b AND least(n_a, n_b) * {den} >= greatest(n_a, n_b) * {num} AND (least(n_a - p_a, n_b - p_b) + {MORE}) * {num + den} {asked}")
    pairs = rows.groupBy("id_a", "id_b", "n_a", "n_b").agg(F.count("*").alias("k"), F.max("p_a").alias("p_a"), F.max("p_b").alias("p_b"))
    least = f"((n_a + n_b) * {num} + {num + den - 1}) div {num + den}"  # o
    beyond = f"greatest((n_a * {num} + {den - 1}) div {den}, (n_b * {num} + {den - 1}) div {den}, {least} - {MORE}) - 1"
    after = "least(n_a - p_a, n_b - p_b) - 1"
    pairs = pairs.where(f"(k + least({beyond}, {after})) * {num + den} {asked}")
    return pairs.select(F.col("id_a").alias("u"), F.col("id_b").alias("v"), (F.col("n_a") + F.col("n_b")).alias("both"))


def _across(classes: DataFrame, roots: DataFrame, ws: Workspace, num: int, den: int) -> DataFrame:
    """Pairs (u, v) of classes (id, n, prefix, odd) of different components that share as much of their prefixes as the likeness asks for, and whose parities allow it: all links that are left are among them."""

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            apart = np.array([parities_apart(x, y) for x, y in zip(b.column(3).to_pylist(), b.column(4).to_pylist())], np.int64)  # of n elements in both, at most (n - apart) / 2 are shared
            n = b.column(2).to_numpy()
            yield b.select(["u", "v"]).filter(pa.array((n - apart) * (num + den) >= 2 * n * num))

    of = classes.join(roots, classes["id"] == roots["node"], "left").select("id", F.coalesce("root", "id").alias("root"), "n", F.posexplode("prefix").alias("p", "s"))
    same = Window.partitionBy("s")
    met = of.withColumn("mixed", F.min("root").over(same) < F.max("root").over(same)).where("mixed").drop("mixed")
    pairs = _met(ws.save(met, "met"), num, den)
    odd = classes.select("id", "odd")
    return pairs.join(odd.toDF("u", "x"), "u").join(odd.toDF("v", "y"), "v").select("u", "v", "both", "x", "y").mapInArrow(releasing(near), "u long, v long")


def _checked(links: DataFrame, docs: DataFrame, classes: DataFrame, ws: Workspace, shingle: int, seed: int, num: int, den: int, name: str = "sets") -> DataFrame:
    """The links (u, v) whose shingle sets are alike; the sets are made anew from one document of each class."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            each = [shingle_set(t, shingle, seed) for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([_class_of(h) for h in each], pa.int64()), pa.array([h.view(np.int64) for h in each], pa.list_(pa.int64()))], ["id", "hashes"])

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = [alike(x.values.to_numpy().view(np.uint64), y.values.to_numpy().view(np.uint64), num, den) for x, y in zip(b.column(2), b.column(3))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["u", "v"]).filter(pa.array(ok, pa.bool_()))

    needed = classes.join(links.select(F.explode(F.array("u", "v")).alias("id")).distinct(), "id", "left_semi").select("least.doc_id", "least.digest")
    sets = docs.join(needed, ["doc_id", "digest"], "left_semi").select("text").mapInArrow(releasing(read), "id long, hashes array<long>")
    sets = ws.save(sets.dropDuplicates(["id"]), name)
    both = links.join(sets.toDF("u", "x"), "u").join(sets.toDF("v", "y"), "v")
    return both.select("u", "v", "x", "y").mapInArrow(releasing(test), "u long, v long")


def near_groups(docs: DataFrame, ws: Workspace, shingle: int = 5, likeness: tuple[int, int] = (4, 5), bits: int = 256, miss: float = 0.01, node_rows: int = 4096, seed: int = 42) -> tuple[DataFrame, DataFrame, DataFrame]:
    """From docs (doc_id, digest, text): rows (doc_id, digest, id), their classes (id: of a shingle set, fp, least struct<doc_id, digest>), and (node, root) of classes that aren't their own component's root.

    Classes are linked where their fingerprints of ``bits`` bits, of distinct shingles, differ by so few bits that a likeness of num / den is in reach (4 standard deviations over its mean; few
    shingles spread more than many), and their sets'
    Jaccard likeness is num / den at least. Of the links that a task finds, it gives the closest spanning forest to be checked: two sets that are alike are connected by it through pairs that
    are at least as close by fingerprint. What the orders missed, or a forest left to pairs that aren't alike, is found exactly: classes of different components whose prefixes meet are checked
    too (``_across``), so that no link is lost. ``miss`` only says how much is left to that."""
    num, den = likeness
    words = bits // 64

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, 512):
                b = whole.slice(k, 512)
                each = [shingle_set(t, shingle, seed) for t in b.column(2).to_pylist()]
                fp = fingerprints_of(iter(each), len(each), words).astype(">u8")
                first = [prefix(h, common, num, den).view(np.int64) for h in each]
                made = [pa.array([_class_of(h) for h in each], pa.int64()), pa.array([x.tobytes() for x in fp], pa.binary()), pa.array([len(h) for h in each], pa.int64()), pa.array(first, pa.list_(pa.int64())), pa.array([parities(h) for h in each], pa.binary())]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *made], ["doc_id", "digest", "id", "fp", "n", "prefix", "odd"])

    common = _common(docs, ws, docs.count(), shingle, seed)
    read_all = ws.save(docs.select("doc_id", "digest", "text").mapInArrow(releasing(read), "doc_id long, digest long, id long, fp binary, n long, prefix array<long>, odd binary"), "rows")
    classes = ws.save(read_all.groupBy("id").agg(F.min(F.struct("doc_id", "digest")).alias("least"), *[F.first(c).alias(c) for c in ("fp", "n", "prefix", "odd")]), "classes")
    # Prefixes and parities are a large part of the texts: they go once they are read.
    rows = ws.save(read_all.select("doc_id", "digest", "id"), "named")
    ws.drop("rows")
    apart = share_apart(num / den)
    budget = math.floor(bits * apart + 4 * math.sqrt(bits * apart * (1 - apart)))
    orders = sampled_orders(bits, classes.count(), apart, budget, miss)
    links = link_fingerprints(classes.select("id", "fp"), ws, orders, budget, node_rows, closest=True, leaf=1024)
    links = ws.save(links.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "near")
    alike_links = ws.save(_checked(links, docs, classes, ws, shingle, seed, num, den), "alike")
    ws.drop("near")
    ws.drop("sets")
    left = _across(classes, connected_components(alike_links, ws), ws, num, den)
    left = ws.save(left, "left")
    ws.drop("met")
    slim = ws.save(classes.select("id", "fp", "least"), "slim")
    ws.drop("classes")
    found = _checked(left, docs, slim, ws, shingle, seed, num, den, "sets_left")
    roots = connected_components(alike_links.unionByName(found), ws, name="all")
    for name in ("sets_left", "left", "alike"):
        ws.drop(name)
    return rows, slim, roots


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """docs (doc_id, text, any others) without all but one row of each group that is linked by likeness (``near_groups``): the one with the smallest doc_id stays; if the group has several
    rows of it, one of them. Texts without a word are one group; rows with a null doc_id can't be named and stay. Keeps docs' columns."""
    ws = Workspace(docs.sparkSession, "simhash")
    packed = Packed(docs, "doc_id", "text")
    docs = docs.select("doc_id", "text", packed.rest())
    digest = F.xxhash64(F.col("text").cast("string"))
    slim = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), digest.alias("digest"), F.col("text").cast("string").alias("text"))
    rows, classes, roots = near_groups(slim, ws, **options)
    named = classes.join(roots, classes["id"] == roots["node"], "left").select("least", F.coalesce("root", "id").alias("root"))
    kept = named.groupBy("root").agg(F.min("least").alias("least")).select(F.col("least.doc_id").alias("of"), F.col("least.digest").alias("of_digest"))
    again = rows.groupBy("doc_id", "digest").agg(F.count("*").alias("many"))
    kept = ws.save(kept.join(again, (kept["of"] == again["doc_id"]) & (kept["of_digest"] == again["digest"])).select("of", "of_digest", "many"), "kept")
    on = (F.col("doc_id").cast("long") == F.col("of")) & (digest == F.col("of_digest"))
    out = docs.join(kept.where("many = 1"), on, "left_semi").unionByName(docs.where("doc_id is null"))
    many = kept.where("many > 1")
    if not many.isEmpty():
        out = out.unionByName(docs.join(many, on).dropDuplicates(["of", "of_digest"]).select("doc_id", "text", "rest"))
    return out.select(*packed.columns())
