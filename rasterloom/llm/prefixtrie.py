"""Conversation prefix trie: the distinct beginnings of all conversations as nodes, with what sharing them saves.

A turn becomes a key of 32 bytes (24 bytes of the SHA-256 of role and text, 8 bytes with the text's length in code points), a conversation the keys of its turns end to end; texts never move. Equal
conversations are one sequence with a count; the ids that end in it are hashed in ascending order, from pieces of at most 65536 ids.

Sequences are range-partitioned by key, so a shard is a stretch of the trie in depth-first order, wherever a first turn or any other prefix is common. A shard's trie is balanced parentheses: one
opening bracket a node in preorder. The excess (openings minus closings) is kept with the minimum of each block of 64 brackets and a tree of minima above the blocks; the bracket that closes a node (``findclose``) delimits
its subtree, the rank of pairs ``()`` counts leaves, and differences of cumulative arrays give members and savings.

Only nodes on the path of a shard's first or last sequence can stand in another shard as well: its spine. All other nodes are final where they are. The spine of a shard is two paths, with what hangs off each of their nodes summed
up; the paths of all shards are merged by the same trie in a second step, whose size follows the number of shards (two paths each), not the conversations. Nodes right below a spine get their parent's name
from there, by a join on the shard.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .storage import Workspace, releasing, shuffle_partitions

WIDTH = 32
#: Bytes of keys in a shard, and the least for which another shard is made.
SHARD_BYTES, LEAST_BYTES = 32 << 20, 1 << 20
ID_PIECE = 16  # bits: ids that share all higher bits are hashed from one piece
NO_ID = np.iinfo(np.int64).max
EMPTY_HASH = hashlib.sha256(b"").hexdigest()
NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
PATH = "shard long, side int, at int, key binary, members array<long>, least array<long>, leaves array<long>, saved array<long>, children array<long>, ends array<string>"


class Excess:
    """The excess of a bracket sequence (+1, -1), with minima of blocks and a tree over them."""

    BLOCK = 64

    def __init__(self, brackets: np.ndarray):
        self.excess = np.cumsum(brackets, dtype=np.int64)
        n = len(brackets)
        blocks = max(1, -(-n // self.BLOCK))
        self.leaves = 1 << (blocks - 1).bit_length()
        padded = np.full(self.leaves * self.BLOCK, np.iinfo(np.int64).max)
        padded[:n] = self.excess
        self.tree = np.empty(2 * self.leaves, np.int64)
        self.tree[self.leaves:] = padded.reshape(-1, self.BLOCK).min(1)
        size = self.leaves
        while size > 1:
            self.tree[size // 2: size] = self.tree[size: 2 * size].reshape(-1, 2).min(1)
            size //= 2
        self.padded = padded

    def find_close(self, opens: np.ndarray) -> np.ndarray:
        """The place of the bracket that closes each of these opening ones."""
        target = self.excess[opens] - 1
        out = np.full(len(opens), -1)
        same_block = np.flatnonzero((opens + 1) % self.BLOCK != 0)
        self._scan(opens[same_block] + 1, target[same_block], same_block, out)
        open_still = np.flatnonzero(out < 0)
        at = opens[open_still] // self.BLOCK + self.leaves
        want = target[open_still]
        climbing = np.ones(len(at), bool)
        while climbing.any():  # to the next subtree on the right that goes low enough
            k = np.flatnonzero(climbing)
            here = at[k]
            right = (here & 1) == 0
            low = np.zeros(len(k), bool)
            low[right] = self.tree[here[right] + 1] <= want[k[right]]
            at[k] = np.where(low, here + 1, here >> 1)
            climbing[k[low]] = False
        while len(k := np.flatnonzero(at < self.leaves)):  # and down to its first such block
            child = at[k] * 2
            at[k] = np.where(self.tree[child] <= want[k], child, child + 1)
        self._scan((at - self.leaves) * self.BLOCK, want, open_still, out)
        return out

    def _scan(self, start: np.ndarray, target: np.ndarray, slots: np.ndarray, out: np.ndarray) -> None:
        """Looks from each start to the end of its block for the target excess."""
        live, at = np.arange(len(start)), start.copy()
        while len(live):
            hit = self.padded[at[live]] <= target[live]
            out[slots[live[hit]]] = at[live[hit]]
            live = live[~hit]
            at[live] += 1
            live = live[at[live] % self.BLOCK != 0]


def range_min(values: np.ndarray, begin: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """The least of values[begin:stop] for each of these stretches (none is empty), by a tree of minima."""
    size = 1 << max(0, len(values) - 1).bit_length()
    tree = np.full(2 * size, NO_ID)
    tree[size: size + len(values)] = values
    k = size
    while k > 1:
        tree[k // 2: k] = tree[k: 2 * k].reshape(-1, 2).min(1)
        k //= 2
    low, high, out = begin + size, stop + size, np.full(len(begin), NO_ID)
    while len(k := np.flatnonzero(low < high)):
        odd = k[low[k] & 1 == 1]
        out[odd] = np.minimum(out[odd], tree[low[odd]])
        low[odd] += 1
        odd = k[high[k] & 1 == 1]
        high[odd] -= 1
        out[odd] = np.minimum(out[odd], tree[high[odd]])
        low[k] >>= 1
        high[k] >>= 1
    return out


class Trie:
    """The trie of ascending sequences (bytes of WIDTH a turn); node 0 is the root."""

    def __init__(self, keys: list[bytes]):
        entries = np.frombuffer(b"".join(keys), ">u8").reshape(-1, WIDTH // 8)
        depth = np.array([len(k) // WIDTH for k in keys])
        first = np.cumsum(depth) - depth
        common = np.zeros(len(keys), np.int64)  # with the sequence before
        common[:1] = -1
        live, k = np.arange(1, len(keys)), 0
        while len(live := live[(depth[live] > k) & (depth[live - 1] > k)]):
            live = live[(entries[first[live] + k] == entries[first[live - 1] + k]).all(1)]
            k += 1
            common[live] = k
        new = depth - common  # nodes that a sequence is the first to have
        self.sequence_depth, self.common = depth, common
        row = np.repeat(np.arange(len(keys)), new)
        self.first_new = np.cumsum(new) - new
        self.depth = np.arange(len(row)) - self.first_new[row] + common[row] + 1
        self.length = np.zeros(len(row), np.int64)
        below = self.depth > 0
        self.length[below] = entries[(first[row] + self.depth - 1)[below], -1].astype(np.int64)
        n = len(row)
        # Closings before a sequence's openings, and all that are left at the end.
        closes = np.append(depth[:-1] - common[1:], depth[-1] + 1)
        steps = np.empty(2 * len(keys), np.int64)
        steps[0::2], steps[1::2] = new, closes
        brackets = np.repeat(np.tile(np.array([1, -1], np.int8), len(keys)), steps)
        self.opens = 2 * np.arange(n) - self.depth
        self.closes = Excess(brackets).find_close(self.opens)
        self.stop = np.arange(n) + (self.closes - self.opens + 1) // 2  # one past the subtree in preorder
        leaf = np.zeros(len(brackets), np.int64)
        leaf[:-1] = (brackets[:-1] == 1) & (brackets[1:] == -1)
        rank = np.concatenate([[0], np.cumsum(leaf)])
        self.leaf = leaf[self.opens] == 1
        self.leaves = rank[self.closes + 1] - rank[self.opens]
        # The parent is the last node before of one depth less.
        code = np.sort(self.depth * n + np.arange(n))
        parent = code[np.searchsorted(code, np.maximum(self.depth - 1, 0) * n + np.arange(n), "right") - 1] % n
        self.parent = np.where(self.depth > 0, parent, -1)
        self.children = np.bincount(self.parent[1:], minlength=n)

    def ends(self) -> np.ndarray:
        """The node in which each sequence ends."""
        out = self.first_new + self.sequence_depth - self.common - 1
        again = np.flatnonzero(self.sequence_depth == self.common)
        for r in again:  # it was there before
            out[r] = out[r - 1]
            while self.depth[out[r]] > self.sequence_depth[r]:
                out[r] = self.parent[out[r]]
        return out

    def path(self, node: int) -> np.ndarray:
        """The nodes from the root to this one."""
        out = np.empty(self.depth[node] + 1, np.int64)
        while node >= 0:
            out[self.depth[node]] = node
            node = self.parent[node]
        return out

    def sums(self, values: np.ndarray) -> np.ndarray:
        """Totals over subtrees, by one cumulative array."""
        up = np.concatenate([[0], np.cumsum(values)])
        return up[self.stop] - up[np.arange(len(values))]

    def lowest(self, values: np.ndarray) -> np.ndarray:
        return range_min(values, np.arange(len(values)), self.stop)


def _nodes(which: np.ndarray, trie: Trie, total: dict[str, np.ndarray], ends: np.ndarray, parents: np.ndarray, shard: int, side: np.ndarray) -> pa.RecordBatch:
    """Rows of these nodes; side and depth say where on the shard's spine the parent is that isn't known yet (side -1: it is)."""
    known = trie.parent[which] >= 0
    parent = np.where(known, parents[trie.parent[which]], 0)
    columns = {
        "conv_id": total["least"][which], "depth": trie.depth[which], "parent_conv_id": pa.array(parent, pa.int64(), mask=~known | (side >= 0)), "n_convs": total["members"][which], "n_children": total["children"][which],
        "n_leaves": total["leaves"][which], "saved_tokens": total["saved"][which], "ends_sha256": pa.array(ends[which].tolist(), pa.string()),
    }
    empty = pa.nulls(len(which))
    rest = [pa.array(np.full(len(which), shard), pa.int64()), pa.array(side, pa.int32()), pa.array(trie.depth[which] - 1, pa.int32()), empty.cast(pa.binary()), *[empty.cast(pa.list_(pa.int64()))] * 5, empty.cast(pa.list_(pa.string()))]
    return pa.RecordBatch.from_arrays([*[x if isinstance(x, pa.Array) else pa.array(x, pa.int64()) for x in columns.values()], *rest], _NAMES)


_NAMES = [c.split()[0] for c in f"{NODE}, {PATH}".split(", ")]


def _paths(rows: list[dict]) -> pa.RecordBatch:
    kinds = [pa.int64()] * 7 + [pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), *[pa.list_(pa.int64())] * 5, pa.list_(pa.string())]
    return pa.RecordBatch.from_arrays([pa.array([r.get(c) for r in rows], k) for c, k in zip(_NAMES, kinds)], _NAMES)


def _shard(keys: list[bytes], members: np.ndarray, least: np.ndarray, ends: list[str], shard: int) -> Iterator[pa.RecordBatch]:
    """A shard's final nodes, and the two paths of its spine."""
    trie = Trie(keys)
    n = len(trie.depth)
    at = trie.ends()
    own, own_least, own_ends = np.zeros(n, np.int64), np.full(n, NO_ID), np.full(n, EMPTY_HASH, object)
    own[at], own_least[at], own_ends[at] = members, least, ends
    first, last = trie.path(at[0]), trie.path(at[-1])
    spine = np.zeros(n, bool)
    spine[first] = spine[last] = True
    total = {"members": trie.sums(own), "least": trie.lowest(own_least), "leaves": trie.leaves, "children": trie.children}
    value = np.where(spine, 0, (total["members"] - 1) * trie.length)
    total["saved"] = trie.sums(value)
    which = np.flatnonzero(~spine)
    # A node below the spine learns its parent's name later; a node of both paths counts as one of the first.
    shared = int((first[: min(len(first), len(last))] == last[: min(len(first), len(last))]).sum())
    below = spine[trie.parent[which]]
    side = np.where(below, np.where(trie.parent[which] == first[np.minimum(trie.depth[which] - 1, len(first) - 1)], 0, 1), -1)
    for k in range(0, len(which), 1 << 16):
        yield _nodes(which[k: k + (1 << 16)], trie, total, own_ends, total["least"], shard, side[k: k + (1 << 16)])
    # What hangs off each node of the spine.
    hung = which[below]
    up = trie.parent[hung]
    sums = {c: np.zeros(n, np.int64) for c in ("members", "leaves", "saved", "children")}
    for c in ("members", "leaves", "saved"):
        np.add.at(sums[c], up, total[c][hung])
    np.add.at(sums["children"], up, 1)
    sums["members"] += own
    lowest = own_least.copy()
    np.minimum.at(lowest, up, total["least"][hung])
    for s, path, key in ((0, first, keys[0]), (1, last, keys[-1])):
        mine = np.arange(len(path)) >= (shared if s else 0)
        row = {"shard": shard, "side": s, "key": key, "least": np.where(mine, lowest[path], NO_ID).tolist()}
        row |= {c: np.where(mine, v[path], 0).tolist() for c, v in sums.items()}
        row["ends"] = [own_ends[k] if m and own[k] else None for k, m in zip(path.tolist(), mine.tolist())]
        yield _paths([row])


def _merge(rows: list[dict]) -> Iterator[pa.RecordBatch]:
    """The spines' nodes, and for each path the conv_id of its nodes, as ``least``."""
    rows.sort(key=lambda r: (r["key"], r["shard"], r["side"]))
    trie = Trie([r["key"] for r in rows])
    n = len(trie.depth)
    sums = {c: np.zeros(n, np.int64) for c in ("members", "leaves", "saved", "children")}
    lowest, ends = np.full(n, NO_ID), np.full(n, EMPTY_HASH, object)
    paths = []
    for r, end in zip(rows, trie.ends().tolist()):
        path = trie.path(end)
        paths.append(path)
        for c, v in sums.items():
            v[path] += np.array(r[c])
        lowest[path] = np.minimum(lowest[path], np.array(r["least"]))
        for k, x in zip(path.tolist(), r["ends"]):
            if x is not None:
                ends[k] = x
    alone = trie.leaf & (sums["children"] == 0)
    total = {"members": trie.sums(sums["members"]), "least": trie.lowest(lowest), "children": trie.children + sums["children"]}
    total["leaves"] = trie.sums(sums["leaves"]) + trie.leaves - trie.sums((trie.leaf & ~alone).astype(np.int64))
    total["saved"] = trie.sums(sums["saved"] + (total["members"] - 1) * trie.length)
    yield _nodes(np.arange(n), trie, total, ends, total["least"], -1, np.full(n, -1))
    yield from (_paths([{"shard": r["shard"], "side": r["side"], "least": total["least"][p].tolist(), "key": r["key"]}]) for r, p in zip(rows, paths))


def turn_key(role: Column, text: Column) -> Column:
    """A turn's key, as 64 hex digits; null counts as empty."""
    role, text = (F.coalesce(c.cast("string"), F.lit("")) for c in (role, text))
    digest = F.sha2(F.encode(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), "UTF-8"), 256)
    return F.concat(F.upper(F.substring(digest, 1, 48)), F.lpad(F.hex(F.length(text).cast("long")), 16, "0"))


def sequences(conversations: DataFrame) -> DataFrame:
    """(conv_id, keys): the keys of each conversation's turns, 64 hex digits each, in the order of turn (null first), equal turns by key. Rows without conv_id belong to no conversation."""
    turns = conversations.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), F.struct(F.col("turn"), turn_key(F.col("role"), F.col("text")).alias("key")).alias("t"))
    each = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    return each.select("conv_id", F.array_join(F.transform("t", lambda x: x["key"]), "").alias("keys"))


def with_shared_heads(convs: DataFrame) -> DataFrame:
    """sequences() rebuilt: with h the CRC-32 of conv_id in decimal modulo 6, the first h turns are those of conversation conv_id - conv_id % 100 (none where there is no such), the rest are the conversation's own after its first h."""
    heads = convs.where("conv_id % 100 = 0").select(F.col("conv_id").alias("base"), F.substring("keys", 1, 5 * 64).alias("head"))
    both = convs.withColumn("base", F.expr("conv_id - conv_id % 100")).join(heads, "base", "left")
    size = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 6 * 64).cast("int")
    return both.withColumn("h", size).select("conv_id", F.concat(F.coalesce(F.expr("substring(head, 1, h)"), F.lit("")), F.expr("substring(keys, h + 1)")).alias("keys"))


def _distinct(convs: DataFrame, ws: Workspace) -> DataFrame:
    """(key, members, least, ends): each distinct sequence once, with the SHA-256 of its ascending ids."""
    piece = F.expr(f"shiftright(conv_id, {ID_PIECE})")
    pieces = convs.withColumns({"seq": F.sha2(F.col("keys").cast("binary"), 256), "piece": piece}).groupBy("seq", "piece").agg(F.sort_array(F.collect_list("conv_id")).alias("ids"), F.first("keys").alias("keys"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = None
        names = ["key", "members", "least", "ends"]

        def row() -> tuple:
            return bytes.fromhex(keys), members, least, digest.hexdigest()

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.binary(), pa.int64(), pa.int64(), pa.string()))], names)

        for b in batches:
            done = []
            for seq, text, least_id, count, k in zip(*(b.column(c).to_pylist() for c in range(5))):
                if seq != now:
                    if now is not None:
                        done.append(row())
                    now, keys, members, least, digest = seq, k, count, least_id, hashlib.sha256(text.encode())
                else:
                    members += count
                    digest.update(b"," + text.encode())
            if done:
                yield batch(done)
        if now is not None:
            yield batch([row()])

    ready = pieces.select("seq", "piece", F.array_join("ids", ",").alias("text"), F.col("ids")[0].alias("least"), F.size("ids").cast("long").alias("members"), "keys")
    ready = ready.repartition("seq").sortWithinPartitions("seq", "piece").drop("piece")
    return ws.save(ready.mapInArrow(releasing(run), "key binary, members long, least long, ends string"), "sequences")


def prefix_trie(convs: DataFrame, shard_bytes: int = SHARD_BYTES, shards: int | None = None) -> DataFrame:
    """One row per node of the trie of ``convs``, as sequences() gives them (conv_id once each): conv_id, the smallest member; depth; parent_conv_id; n_convs; n_children; n_leaves; saved_tokens, over the
    subtree, (n_convs - 1) times the code points of each node's last text; ends_sha256, of the conv_ids that end there, ascending and comma-joined.

    shards: how many stretches the trie is cut into (default: about ``shard_bytes`` of keys each, as many as there are shuffle partitions where that leaves LEAST_BYTES). Conversations without a turn end in the root; no conversations give no nodes.
    Equal conversations share all nodes. Texts of any length count by their hash and length. A conversation is one row of 32 bytes a turn.
    """
    spark = convs.sparkSession
    ws = Workspace(spark, "prefixtrie")
    found = _distinct(convs, ws)
    if shards is None:
        total = found.agg(F.sum(F.octet_length("key") + WIDTH)).first()[0] or 0
        shards = max(1, math.ceil(total / shard_bytes), min(shuffle_partitions(spark), total // LEAST_BYTES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        table = pa.Table.from_batches(list(batches))
        if table.num_rows:
            numbers = [table.column(c).combine_chunks().to_numpy(zero_copy_only=False) for c in ("members", "least")]
            yield from _shard(table.column("key").to_pylist(), *numbers, table.column("ends").to_pylist(), TaskContext.get().partitionId())

    dealt = found.repartitionByRange(shards, "key").sortWithinPartitions("key")
    made = ws.save(dealt.mapInArrow(releasing(run), f"{NODE}, {PATH}"), "shards")

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for b in batches for r in b.to_pylist()]
        if rows:
            yield from _merge(rows)

    merged = ws.save(made.where("key IS NOT NULL").select(*[c.split()[0] for c in PATH.split(", ")]).coalesce(1).mapInArrow(merge, f"{NODE}, {PATH}"), "spine")
    names = [c.split()[0] for c in NODE.split(", ")]
    nodes = made.where("key IS NULL")
    parents = merged.where("key IS NOT NULL").select("shard", "side", F.col("least").alias("up"))
    below = nodes.where("side >= 0").drop("parent_conv_id").join(parents, ["shard", "side"]).withColumn("parent_conv_id", F.expr("up[at]"))
    return nodes.where("side < 0").select(names).unionByName(below.select(names)).unionByName(merged.where("key IS NULL").select(names))
