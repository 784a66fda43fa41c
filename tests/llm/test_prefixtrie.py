"""Conversation prefix trie against brute force."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from rasterloom.llm import prefixtrie, queries


def trie_of(sequences):
    """Nodes of {conv_id: turns} by listing every prefix."""
    members, children = defaultdict(list), defaultdict(set)
    for i, s in sequences.items():
        for d in range(len(s) + 1):
            members[s[:d]].append(i)
            if d:
                children[s[: d - 1]].add(s[:d])
    below = defaultdict(list)
    for q in members:
        for d in range(len(q) + 1):
            below[q[:d]].append(q)
    out = []
    for p, m in members.items():
        ends = ",".join(map(str, sorted(i for i in m if len(sequences[i]) == len(p))))
        saved = sum((len(members[q]) - 1) * len(q[-1][1]) for q in below[p] if q)
        out.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(children[p]), sum(not children[q] for q in below[p]), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def rebuilt(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, prefix_key(role or "", text or ""), (role or "", text or "")))
    own = {c: [t[3] for t in sorted(ts)] for c, ts in own.items()}
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = own.get(c - int(np.fmod(c, 100)), [])
        out[c] = tuple(base[:h] + turns[h:])
    return out


def prefix_key(role, text):
    return hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()[:48]


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def table(seed=1):
    rng = random.Random(seed)
    words = ["", "hi", "é𝄞", "the same first turn", "yes"]
    rows = []
    for c in [*range(130), 200, 250, 255, -3, -150, 1 << 40]:
        for k in range(rng.randrange(9)):
            rows.append((c, k, rng.choice(["user", "assistant", None]), rng.choice([*words, None, f"own {c}"])))
    rows += [(7, None, "system", "first"), (7, 3, "user", "tie"), (7, 3, "user", "another"), (8, 1, "user", "twice"), (8, 1, "user", "twice"), (None, 1, "user", "nobody's")]
    rows += [(140, k, "user", f"long {k}" * 20) for k in range(300)] + [(141, 0, "user", "x" * 1_000_000)]
    rng.shuffle(rows)
    return rows


def test_query_equals_brute_force(spark, tmp_path):
    rows = table()
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3).write.parquet(f"{tmp_path}/conversations.parquet")
    found = queries.op12_conversation_trie(spark, str(tmp_path))
    assert found.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert {t for _, t in found.dtypes} == {"bigint", "string"}
    assert rows_of(found) == trie_of(rebuilt(rows))


@pytest.mark.parametrize("shards", [1, 3, 40])
def test_shards_merge(spark, shards):
    rng = random.Random(shards)
    rows, sequences = [], {}
    for c in range(-5, 300):
        kind = rng.random()
        turns = [("u", "common")] * rng.randrange(1, 4) if kind < 0.4 else [("u", rng.choice("abc")) for _ in range(rng.randrange(1, 6))]
        rows += [(c, k, role, text, "extra") for k, (role, text) in enumerate(turns)]
        sequences[c] = tuple(turns)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, depth string")
    assert rows_of(prefixtrie.prefix_trie(prefixtrie.sequences(df), shards=shards)) == trie_of(sequences)


def test_ids_in_pieces(spark):
    """Equal conversations whose ids lie in several pieces are hashed in one order."""
    ids = [-70_000, -1, 0, 5, 65_535, 65_536, 200_000, 1 << 40]
    df = spark.createDataFrame([(i, 0, "u", "same") for i in ids], "conv_id long, turn long, role string, text string")
    assert rows_of(prefixtrie.prefix_trie(prefixtrie.sequences(df))) == trie_of({i: (("u", "same"),) for i in ids})


def test_empty(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert prefixtrie.prefix_trie(prefixtrie.with_shared_heads(prefixtrie.sequences(df))).count() == 0


def test_find_close_and_range_min():
    rng = random.Random(4)
    for n in (1, 5, 200, 3000):
        brackets, open_now = [1], 1
        for _ in range(2 * n):
            up = open_now == 1 or rng.random() < 0.5
            brackets.append(1 if up else -1)
            open_now += 1 if up else -1
        brackets += [-1] * open_now
        stack, wanted = [], {}
        for k, b in enumerate(brackets):
            if b == 1:
                stack.append(k)
            else:
                wanted[stack.pop()] = k
        opens = np.array(sorted(wanted))
        assert prefixtrie.Excess(np.array(brackets, np.int8)).find_close(opens).tolist() == [wanted[k] for k in opens]
        values = np.array([rng.randrange(99) for _ in range(n)])
        begin = np.array([rng.randrange(n) for _ in range(50)])
        stop = np.array([rng.randrange(b + 1, n + 1) for b in begin])
        assert prefixtrie.range_min(values, begin, stop).tolist() == [values[b:s].min() for b, s in zip(begin, stop)]
