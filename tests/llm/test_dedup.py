"""Substring, line, SimHash and embedding dedup against brute force."""

import hashlib
import math
import time
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from rasterloom.llm import components, embeddings, linededup, simhash, substrings
from rasterloom.llm.storage import Workspace

from .helpers import WORD, components as brute_components, documents


def ordered(rows):
    return sorted((tuple(r) for r in rows), key=str)


def words_of(text):
    return WORD.findall(text or "")


def repeats(rows, window):
    each = [words_of(t) for _, t in rows]
    count = Counter(tuple(w[k: k + window]) for w in each for k in range(len(w) - window + 1))
    out = []
    for (i, _), w in zip(rows, each):
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if count[tuple(w[k: k + window])] > 1:
                gone[k: k + window] = [True] * window
        out.append((i, w, gone))
    return out


@pytest.mark.parametrize("window", [2, 5, 8, 35])
def test_substrings(spark, window):
    rows, docs = documents(spark)
    wanted = [(i, len(w), sum(g), hashlib.sha256(" ".join(x for x, y in zip(w, g) if not y).encode()).hexdigest()) for i, w, g in repeats(rows, window)]
    assert ordered(substrings.remove_repeats(docs, window=window, chunk_bytes=2000, digest=True).collect()) == ordered(wanted)


def test_substrings_keep_columns_and_spans(spark):
    rows, docs = documents(spark)
    found = substrings.remove_repeats(docs, window=5, chunk_bytes=900)
    assert found.columns == [*docs.columns[: docs.columns.index("n_chars") + 1], *docs.columns[docs.columns.index("n_chars") + 1:], "n_words", "n_removed", "spans"]
    wanted = Counter()
    for (i, t), (_, w, gone) in zip(rows, repeats(rows, 5)):
        cut = [k for k in range(len(w) + 1) if (gone[k] if k < len(w) else False) != (gone[k - 1] if k else False)]
        kept = " ".join(x for x, g in zip(w, gone) if not g) if any(gone) else t
        wanted[(i, kept, tuple(zip(cut[::2], cut[1::2])))] += 1
    assert Counter((r.doc_id, r.text, tuple((s.begin, s.stop) for s in r.spans)) for r in found.collect()) == wanted
    assert substrings.remove_repeats(docs.limit(0), digest=True).count() == 0


def test_substrings_names_and_lost_files(spark):
    names = ["_run", "_bytes", "h", "flags", "bucket", "second", "rest", "c0", "n_words", "n_removed", "spans", "a.b"]
    passage = " ".join(f"p{k}" for k in range(60))
    rows = [(k, f"start{k} {passage} end{k}", 999, *[f"{n}{k}" for n in names]) for k in range(3)]
    docs = spark.createDataFrame(rows, ["doc_id", "text", "n_chars", *names])
    found = substrings.remove_repeats(docs, counts=False)
    assert found.columns == docs.columns
    assert ordered(found.collect()) == ordered((k, f"start{k} end{k}", len(f"start{k} end{k}"), *[f"{n}{k}" for n in names]) for k in range(3))
    with pytest.raises(FileNotFoundError):
        substrings._Files(f"{Workspace(spark, 'test').path}/none").get(1, np.uint64)


def test_substrings_long_text(spark):
    text = " ".join(f"word{k}" for k in range(300_000))
    rows = [(1, text), (2, "x " + " ".join(text.split()[1000:1100]) + " y")]
    found = {r.doc_id: r.n_removed for r in substrings.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), digest=True).collect()}
    assert found == {1: 100, 2: 100}


def test_different_words_that_sums_of_powers_confuse(spark):
    """Thue-Morse orders and their complements have equal polynomial hashes modulo 2**64, as letters of a word and as words of a window."""
    order = [bin(k).count("1") % 2 for k in range(2048)]
    words = ["".join("ab"[(b + flip) % 2] for b in order[:1024]) for flip in (0, 1)]
    rest = " ".join(f"w{k}" for k in range(34))
    turned = [" ".join(("yes", "no")[(b + flip) % 2] for b in order) for flip in (0, 1)]
    rows = [(k, f"{w} {rest}") for k, w in enumerate(words)]
    found = substrings.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), digest=True)
    assert [r.n_removed for r in found.collect()] == [0, 0]
    rows = list(enumerate(turned))
    found = substrings.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), window=2048, digest=True)
    assert [r.n_removed for r in found.collect()] == [0, 0]


def test_windows_that_share_half_a_hash():
    """Pairs are compared by both halves, also where several windows share the first."""
    known = np.array([[1, 5], [3, 2], [3, 7], [3, 9], [8, 1]], np.uint64)
    h, g = np.array([1, 1, 3, 3, 3, 3, 8, 9, 0], np.uint64), np.array([5, 6, 2, 9, 7, 8, 1, 1, 0], np.uint64)
    assert substrings._pairs_among(h, g, known).tolist() == [True, False, True, True, True, False, True, False, False]
    assert [x.tolist() for x in substrings._unique_pairs(np.array([3, 1, 3, 3], np.uint64), np.array([9, 5, 2, 9], np.uint64))] == [[1, 3, 3], [5, 2, 9], [1, 1, 2]]


def test_sorted_lists_round_trip():
    rng = np.random.default_rng(3)
    for values in ([0], [5], [], [0, 1, 2, 700, 70_000, 10**12], np.unique(rng.integers(0, 1 << 40, 1000)), np.unique(rng.integers(0, 3000, 2000))):
        values = np.array(values, np.int64)
        assert substrings.decode_sorted(substrings.encode_sorted(values)).tolist() == values.tolist()


def lines_by_hand(rows, every):
    """Removed chunks by the definition; rows that repeat doc_id and text are one document."""

    def chunks(text):
        lines, out, start = text.split("\n"), [], 0
        h = [int(hashlib.md5(x.encode()).hexdigest()[:8], 16) for x in lines]
        ended = False
        for k in range(len(lines)):
            proposed = (7919 * h[k] + 104729 * (h[k - 1] if k else 0)) % 1000003 % every == 0 or (k > 0 and lines[k] == lines[k - 1])
            ended = proposed and not ended
            if k == len(lines) - 1 or ended:
                out.append(lines[start: k + 1])
                start = k + 1
        return out

    signed = lambda t: (x := xxhash.xxh64_intdigest(t.encode(), 42)) - (1 << 64 if x >> 63 else 0)
    first, count = {}, Counter()
    for i, t in rows:
        for place, c in enumerate(chunks(t) if t is not None else []):
            if sum(x.strip(" ") != "" for x in c) > 1:
                key = (i is not None, i or 0, signed(t), place)
                first["\n".join(c)] = min(first.get("\n".join(c), key), key)
                count["\n".join(c)] += 1
    out = []
    for i, t in rows:
        if t is None:
            out.append((i, None, 0, 0))
            continue
        left, gone = [], 0
        for place, c in enumerate(chunks(t)):
            if count["\n".join(c)] > 1 and first["\n".join(c)] != (i is not None, i or 0, signed(t), place):
                gone += len(c)
            else:
                left += c
        out.append((i, "\n".join(left), t.count("\n") + 1, gone))
    return out


@pytest.mark.parametrize("every", [1, 3, 4])
def test_line_dedup(spark, every):
    rows, docs = documents(spark)
    found = linededup.remove_repeated_lines(docs, every, count=True)
    wanted = lines_by_hand(rows, every)
    assert every == 1 or any(w[3] for w in wanted)
    assert ordered(found.select("doc_id", "text", "n_lines", "n_removed").collect()) == ordered(wanted)
    few = linededup.remove_repeated_lines(docs, every, count=True, bits=4)  # hashes that many texts share
    assert ordered(few.select("doc_id", "text", "n_lines", "n_removed").collect()) == ordered(wanted)
    assert linededup.remove_repeated_lines(docs).columns == docs.columns
    assert linededup.remove_repeated_lines(docs.limit(0)).count() == 0


def test_line_dedup_runs_of_equal_lines(spark):
    """All lines of a run but its first two and an odd last one go, wherever the run stands."""
    rows = [(1, "\n".join(["head of one", *["same line"] * 41, "tail of one"])), (2, "\n".join(["head of two", *["same line"] * 30]))]
    found = linededup.remove_repeated_lines(spark.createDataFrame(rows, "doc_id long, text string"), count=True).orderBy("doc_id").collect()
    assert [r.n_removed >= n - 5 for r, n in zip(found, (41, 30))] == [True, True]
    assert found[0].text.startswith("head of one") and found[0].text.endswith("tail of one")


def test_line_dedup_names(spark):
    """Columns with the operator's own names come back as they were."""
    names = ["_n", "_id", "_digest", "_removed", "digest", "of", "of_digest", "removed", "rest", "chunks", "lines", "kept", "left", "n_lines", "c0", "a.b"]
    rows = [(k, "one\ntwo\nthree\nfour\nfive\nsix\nseven\neight", *[f"{n}{k}" for n in names]) for k in range(3)]
    docs = spark.createDataFrame(rows, ["doc_id", "text", *names])
    found = linededup.remove_repeated_lines(docs)
    assert found.columns == docs.columns
    assert sorted(tuple(r)[2:] for r in found.collect()) == sorted(r[2:] for r in rows)


def test_line_dedup_long_text(spark):
    """Several megabytes in one document."""
    text = "\n".join(f"line {k} of a long text with a few words" for k in range(120_000))
    rows = [(1, text), (2, "a\nb\n" + text)]
    found = linededup.remove_repeated_lines(spark.createDataFrame(rows, "doc_id long, text string"), count=True).orderBy("doc_id").collect()
    assert found[0].text == text and found[1].n_removed > 119_000


def test_line_dedup_updates_length(spark):
    rows = [(k, "one\ntwo\nthree\nfour\nfive\nsix\nseven\neight" + str(k) * (k > 1), "en", 40) for k in range(4)]
    found = linededup.remove_repeated_lines(spark.createDataFrame(rows, "doc_id long, text string, lang string, n_chars int")).collect()
    assert any(r.text != t for r, (_, t, _, _) in zip(sorted(found), rows))
    assert all(r.n_chars == (len(r.text) if r.text != rows[r.doc_id][1] else 40) for r in found)


def simhash_by_hand(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = WORD.findall(low)
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[k: k + 4]).encode(), 42) for k in range(max(1, len(w) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash(spark):
    rows, docs = documents(spark)
    fps = [simhash_by_hand(t) for _, t in rows]
    links = [(a, b) for a in range(len(rows)) for b in range(a) if (fps[a] ^ fps[b]).bit_count() <= 4]
    root = brute_components(len(rows), links)
    least = defaultdict(list)
    for (i, _), r in zip(rows, root):
        if i is not None:
            least[r].append(i)
    wanted = [(i, fp, min(least[r], default=None)) for (i, _), fp, r in zip(rows, fps, root)]
    for options in ({}, {"node_rows": 3}, {"node_rows": 5, "in_task": 0}):
        found = simhash.near_duplicates(docs, **options).collect()
        assert ordered((r.doc_id, r.fp & (1 << 64) - 1, r.component_id) for r in found) == ordered(wanted)
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def shingles_by_hand(text):
    w = words_of("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[k: k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def families(rng, n=40):
    """Texts that share a passage, with copies from no to many edits."""
    passage, rows = [f"p{k}" for k in range(30)], []
    for k in range(n):
        base = [f"w{x}" for x in rng.integers(0, 3000, rng.integers(5, 300))] + passage
        for edits in (0, 1, 2, 3, 5):
            w = list(base)
            for at in rng.integers(0, len(w), edits):
                w[at] = f"e{rng.integers(0, 9999)}"
            rows.append((1000 + 10 * k + edits, " ".join(w).upper() if edits == 1 else " ".join(w)))
    return rows


@pytest.mark.parametrize("node_rows", [4096, 40])
def test_near_dedup_by_likeness(spark, node_rows):
    rows, _ = documents(spark)
    rows += families(np.random.default_rng(8))
    rows += [(7, rows[9][1]), (2000, rows[-3][1])]  # a doc_id of two groups
    sets = [shingles_by_hand(t) for _, t in rows]
    named = [k for k, (i, _) in enumerate(rows) if i is not None]
    likeness = {(a, b): 1 if sets[a] == sets[b] else len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a in named for b in named if b < a}
    exact = brute_components(len(rows), [p for p, x in likeness.items() if x >= 0.8])
    docs = spark.createDataFrame([(i, t, *["x"] * 6) for i, t in rows], "doc_id long, text string, root string, of string, of_digest string, many string, digest string, rest string").repartition(3)
    kept = simhash.keep_one(docs, node_rows=node_rows) if node_rows != 4096 else corpus_pipeline.near_dedup(spark, docs, "")
    assert kept.columns == docs.columns
    found = Counter((r.doc_id, r.text) for r in kept.collect())
    assert not found - Counter(rows)  # whole rows only
    groups = defaultdict(list)
    for k in named:
        groups[exact[k]].append(rows[k])
    left = [sum(n for x, n in found.items() if x in g) for g in groups.values()]
    assert all(n >= 1 for n in left)  # no group is lost
    assert sum(n - 1 for n in left) <= 0.02 * sum(len(g) - 1 for g in groups.values())  # and hardly a member is left over
    assert simhash.keep_one(docs.limit(0)).count() == 0


def test_keep_one_matches_rows_of_a_repeated_doc_id(spark):
    words = " ".join(f"w{k}" for k in range(40))
    docs = spark.createDataFrame([(1, words), (5, words), (5, "something else that stands alone here")], "doc_id long, text string")
    assert {tuple(r) for r in simhash.keep_one(docs).collect()} == {(1, words), (5, "something else that stands alone here")}


def test_a_large_group_of_near_copies_is_one(spark):
    rng = np.random.default_rng(4)
    base = [f"w{x}" for x in range(200)]
    rows = []
    for k in range(900):
        w = list(base)
        w[int(rng.integers(0, 200))] = f"e{k}"
        rows.append((k, " ".join(w)))
    rows += [(5000 + k, " ".join(f"v{x}" for x in rng.integers(0, 10**6, 60))) for k in range(900)]
    kept = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string"), node_rows=200)
    assert sorted(r.doc_id for r in kept.collect()) == [0, *range(5000, 5900)]


def test_simhash_long_text(spark):
    text = " ".join(f"word{k % 9973}" for k in range(400_000))
    docs = spark.createDataFrame([(1, text), (2, text + " end"), (3, "short")], "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in simhash.near_duplicates(docs).collect()} == {1: 1, 2: 1, 3: 3}
    assert sorted(r.doc_id for r in simhash.keep_one(docs).collect()) == [1, 3]


@pytest.mark.parametrize("budget", [0, 1, 4, 7])
def test_ring_orders_find_all_pairs(budget):
    rng = np.random.default_rng(1)
    x = rng.integers(0, 1 << 63, 400, dtype=np.uint64)
    for _ in range(3):
        x = np.concatenate([x, x ^ (np.uint64(1) << rng.integers(0, 64, len(x)).astype(np.uint64))])[:1500]
    x = np.unique(x)
    wanted = {(i, j) for i, j in np.argwhere(np.triu(np.bitwise_count(x[:, None] ^ x[None]) <= budget, 1)).tolist()}
    found = set()
    for order in simhash.ring_orders(budget):
        word = order.words(x[:, None])
        at = np.argsort(word)
        for leaf in (12, 1):
            found |= {tuple(sorted(p)) for i, j in simhash.trie_pairs(word[at], None, order.limit, leaf) for p in zip(at[i].tolist(), at[j].tolist())}
    assert found == wanted


@pytest.mark.parametrize("budget", [0, 1, 3, 4, 7])
def test_links_cover_the_budget(spark, budget):
    rng = np.random.default_rng(budget)
    x = np.unique(np.concatenate([b ^ rng.integers(0, 1 << 10, 30, dtype=np.uint64) << rng.integers(0, 54, 30).astype(np.uint64) for b in rng.integers(0, 1 << 63, 12, dtype=np.uint64)]))
    links = np.argwhere(np.triu(np.bitwise_count(x[:, None] ^ x[None]) <= budget, 1))
    ws = Workspace(spark, "test")
    distinct = spark.createDataFrame([(int(v), bytearray(int(w).to_bytes(8, "big"))) for v, w in zip(x.view(np.int64), x)], "id long, fp binary")
    at = {int(v): k for k, v in enumerate(x.view(np.int64))}
    same = lambda r: {frozenset(k for k in range(len(x)) if r[k] == g) for g in set(r)}
    for closest in (False, True):
        got = simhash.link_fingerprints(distinct, ws, simhash.ring_orders(budget), budget, node_rows=10, closest=closest).collect()
        assert same(brute_components(len(x), links)) == same(brute_components(len(x), [(at[u], at[v]) for u, v in got]))


def test_closest_forest():
    rng = np.random.default_rng(6)
    a, b, d = rng.integers(0, 200, 3000), rng.integers(0, 200, 3000), rng.integers(0, 50, 3000)
    forest = components.ClosestForest(200, held=500)
    for k in range(0, 3000, 300):
        forest.add(a[k: k + 300], b[k: k + 300], d[k: k + 300])
    u, v = forest.links()
    root, total = list(range(200)), 0
    for k in np.argsort(d, kind="stable"):  # Kruskal
        if root[a[k]] != root[b[k]]:
            old, new = root[a[k]], root[b[k]]
            root = [new if r == old else r for r in root]
            total += int(d[k])
    weight = {}
    for x, y, z in zip(a.tolist(), b.tolist(), d.tolist()):
        weight[x, y] = weight[y, x] = min(z, weight.get((x, y), z))
    assert sum(weight[x, y] for x, y in zip(u.tolist(), v.tolist())) == total and len(u) == len(set(range(200))) - len(set(root))


def test_connected_components(spark):
    rng = np.random.default_rng(5)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(k, k + 1) for k in range(1000, 1080)] + [(5000, k) for k in range(5001, 5100)] + [(7, 7)]
    df = spark.createDataFrame(links + [(None, 3), (4, None)], "u long, v long").repartition(5)
    nodes = sorted({x for p in links for x in p})
    at = {x: k for k, x in enumerate(nodes)}
    root = brute_components(len(nodes), [(at[a], at[b]) for a, b in links])
    least = {}
    for x, r in zip(nodes, root):
        least[r] = min(least.get(r, x), x)
    wanted = {x: least[r] for x, r in zip(nodes, root) if least[r] != x}
    for bound in (10_000, 0):
        found = components.connected_components(df, Workspace(spark, "test"), in_task=bound).collect()
        assert len(found) == len(wanted) and {r.node: r.root for r in found} == wanted
    assert components.connected_components(df.limit(0), Workspace(spark, "test")).count() == 0


def embeddings_by_hand(ids, vectors, threshold):
    unit = []
    for x in vectors:
        ok = x is not None and len(x) and all(v is not None and math.isfinite(v) for v in x) and any(x)
        unit.append(np.array(x) / max(map(abs, x)) if ok else None)
    unit = [None if u is None else u / np.linalg.norm(u) for u in unit]
    links = [(a, b) for a in range(len(ids)) for b in range(a) if unit[a] is not None and unit[b] is not None and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= threshold]
    degree = Counter(x for p in links for x in p)
    root = brute_components(len(ids), links)
    least = defaultdict(list)
    for i, r in zip(ids, root):
        if i is not None:
            least[r].append(i)
    out = []
    for k, (i, r) in enumerate(zip(ids, root)):
        c = min(least[r], default=None)
        out.append((i, degree[k], c, i is not None and i == c))
    return out


def test_embeddings(spark):
    rng = np.random.default_rng(2)
    vectors = [(b + rng.normal(size=5) * 0.25).tolist() for b in rng.normal(size=(30, 5)) for _ in range(9)]
    vectors += [None, [], [0.0] * 5, [1.0, None, 2.0, 0.0, 0.0], [math.nan, 1.0, 1.0, 1.0, 1.0], [math.inf, 1.0, 1.0, 1.0, 1.0], [1.0, 2.0], [2.0, 4.0], [1e200, 2e200], [-1.0, -2.0], vectors[3], vectors[3], (np.array(vectors[3]) * 7).tolist()]
    ids = [*range(len(vectors) - 2), 3, None]
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in zip(ids, vectors)], "vec_id long, embedding array<double>, label string, n int").repartition(3)
    wanted = ordered(embeddings_by_hand(ids, vectors, 0.95))
    for block, pivots in ((4096, 4096), (40, 4096), (7, 20), (20, 1)):
        assert ordered(embeddings.near_duplicates(df, block=block, most_pivots=pivots).collect()) == wanted
    assert embeddings.near_duplicates(df.limit(0)).count() == 0


@pytest.mark.parametrize("miss", [0.01, 0.9])
def test_keep_one_loses_no_pair_at_the_likeness(spark, miss):
    """1500 pairs of 4 / 5 exactly, or just above: what the sampled orders miss is found by prefixes. Pairs just below aren't linked."""
    rng = np.random.default_rng(11)
    rows = []
    for k in range(1500):
        words = [f"{k}x{x}" for x in rng.integers(0, 10**9, 76)]
        # 72 shingles each; from t words on, all differ: shared s, union 144 - s, and 64 / 80 is 4 / 5.
        t = [68, 69, 67][k % 3]
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(words[:t] + [f"{w}y" for w in words[t:]]))]
    kept = {r.doc_id for r in simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), miss=miss).collect()}
    wanted = {2 * k for k in range(1500)} | {2 * k + 1 for k in range(1500) if k % 3 == 2}
    assert kept == wanted


def test_near_groups_drops_prefixes_before_sets_are_checked(spark, monkeypatch):
    """Prefixes, parities and sets are not on the disk beside what is read after them; groups are as before."""
    ws, seen, checked = Workspace(spark, "test"), [], simhash._checked
    root = Path(ws.path.removeprefix("file:"))

    def watched(*args):
        out = checked(*args)
        seen.append({p.name for p in root.iterdir()})
        return out

    monkeypatch.setattr(simhash, "_checked", watched)
    text = " ".join(f"w{k}" for k in range(60))
    docs = spark.createDataFrame([(1, 1, text), (2, 2, text + " end"), (3, 3, "another text of no likeness at all"), (4, 1, text)], "doc_id long, digest long, text string")
    rows, classes, roots = simhash.near_groups(docs, ws)
    assert [names & {"rows", "classes", "met", "near"} for names in seen] == [{"classes", "near"}, set()]
    assert not {"sets", "sets_left", "left", "alike", "rows", "classes"} & {p.name for p in root.iterdir()}
    root_of = {r.node: r.root for r in roots.collect()}
    group = {r.doc_id: root_of.get(r.id, r.id) for r in rows.collect()}
    assert group[1] == group[2] == group[4] != group[3] and classes.count() == 3


def test_saved_tables_leave_no_shuffles(spark):
    """A saved table's shuffle files go when it is written, not when the driver collects its garbage; the session's setting is as before."""
    files = lambda: {f.getName() for f in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().getAllFiles()) if f.getName().startswith("shuffle_")}
    before, ws, key = files(), Workspace(spark, "test"), "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was = spark.conf.get(key, None)
    counts = spark.range(20_000).groupBy((F.col("id") % 1000).alias("k")).agg(F.count("*").alias("n"))
    joined = counts.join(counts.hint("merge").select("k", F.col("n").alias("m")), "k")
    assert ws.save(joined, "a").agg(F.sum("n"), F.sum("m")).first() == (20_000, 20_000) and spark.conf.get(key, None) == was
    ends = time.time() + 20
    while files() - before and time.time() < ends:
        time.sleep(0.1)
    assert len(files() - before) <= 2 * 4  # of the sum just now
    assert joined.count() == 1000


def test_parities_follow_the_sets_size():
    """Differing bits never exceed differing elements, whatever the two sizes; unrelated sets are told apart however large they are."""
    rng = np.random.default_rng(8)
    draw = lambda n: np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
    for n in (0, 1, 20, 31, 32, 33, 300, 5000, 60_000):
        x = draw(n)
        for kept, more in ((n, 1), (n * 9 // 10, 0), (n * 9 // 10, n // 5), (n * 2 // 3, n // 3)):
            y = np.union1d(x[rng.permutation(n)[:kept]], draw(more))
            assert simhash.parities_apart(simhash.parities(x), simhash.parities(y)) <= len(np.setxor1d(x, y))
        if n > 200:
            both = 2 * n
            assert (both - simhash.parities_apart(simhash.parities(x), simhash.parities(draw(n)))) * 9 < 2 * both * 4
    assert len(simhash.parities(draw(300))) <= 300


@pytest.mark.parametrize("tiers", [False, True])
def test_prefixes_that_meet_by_chance_are_no_pairs(spark, tiers):
    """Every pair at the likeness is given, sizes apart or not, with any order of the elements; sets of one size that share a few elements of their prefixes aren't."""
    rng = np.random.default_rng(9)
    sets, draw = [], lambda n: rng.integers(0, 1 << 63, n, dtype=np.uint64)
    for k in range(200):
        n = int(rng.integers(1, 90))
        base = draw(n)
        more = int(rng.integers(0, n // 6 + 2))
        sets += [np.sort(base), np.union1d(base[rng.permutation(n)[: n - int(rng.integers(0, n // 6 + 1))]], draw(more))]
    shared = draw(2) >> np.uint64(30)  # the first elements of many sets
    lone = len(sets)
    sets += [np.union1d(draw(200), shared) for _ in range(40)]
    some = np.unique(np.concatenate(sets[:lone:4])) if tiers else np.zeros(0, np.uint64)
    common = some, rng.integers(1, 4, len(some)).astype(np.uint8)
    of = [(k, k, len(x), [int(v) for v in simhash.prefix(x, common, 4, 5).view(np.int64)]) for k, x in enumerate(sets)]
    met = spark.createDataFrame(of, "id long, root long, n long, prefix array<long>").select("id", "root", "n", F.posexplode("prefix").alias("p", "s"))
    found = {(r.u, r.v) for r in simhash._met(met, 4, 5).collect()}
    same = lambda x, y: np.array_equal(x, y)
    wanted = {(a, b) for b in range(len(sets)) for a in range(b) if simhash.alike(sets[a], sets[b], 4, 5) and not same(sets[a], sets[b])}
    assert len(wanted) > 50 and wanted <= found
    assert not [p for p in found if p[0] >= lone]
