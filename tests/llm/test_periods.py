"""Periodic runs against brute force."""

import hashlib
import random
import zlib

import numpy as np
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from rasterloom.llm import periods, queries

from .helpers import WORD, documents


def runs_of(x, exponent=4, least=6):
    """Every stretch in which a period holds, by trying all periods at all words."""
    n, found = len(x), {}
    for p in range(1, n // exponent + 1):
        begin = None
        for i in range(n - p + 1):
            holds = i < n - p and x[i] == x[i + p]
            if holds and begin is None:
                begin = i
            if not holds and begin is not None:
                if i + p - begin >= max(least, exponent * p):
                    found.setdefault((begin, i + p - begin), p)
                begin = None
    return sorted(((s, n, p) for (s, n), p in found.items()), key=lambda r: (r[0], r[2]))


def collapsed(words, runs):
    return [w for k, w in enumerate(words) if not any(s + q <= k < s + n for s, n, q in runs)]


def tailed(i, words):
    h = zlib.crc32(str(i).encode()) if i is not None else 1
    if h % 10 or not words:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w if k < a else words[a + (k - a) % p] for k, w in enumerate(words)]


def test_cover():
    assert {(a - b) % periods.CYCLE for a in periods.COVER for b in periods.COVER} == set(range(periods.CYCLE))
    assert periods.SHIFT.max() < periods.CYCLE


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=90), st.integers(1, 20), st.integers(0, 90), st.sampled_from([(4, 6), (2, 2), (3, 10)]))
def test_runs_equal_brute_force(head, period, tail, limits):
    x = head + [(head or [0])[k % min(period, max(1, len(head)))] for k in range(tail)]
    assert [tuple(r) for r in periods.find_runs(np.array(x, np.int64), *limits).tolist()] == runs_of(x, *limits)


def test_extensions_equal_words():
    rng = random.Random(2)
    for n in (3, 31, 32, 200, 500):
        for width in (1, 2, 40):
            x = [rng.randrange(width) for _ in range(n)]
            i = np.array([rng.randrange(n - 1) for _ in range(60)])
            j = np.array([rng.randrange(a + 1, n) for a in i])
            wanted = [next((t for t in range(n - b) if x[a + t] != x[b + t]), n - b) for a, b in zip(i, j)]
            assert periods.Extensions(np.array(x)).at(i, j).tolist() == wanted


def test_long_texts():
    n = 400_000
    assert periods.find_runs(np.arange(n) % 1234).tolist() == [[0, n, 1234]]
    assert periods.find_runs(np.zeros(n, np.int64)).tolist() == [[0, n, 1]]
    assert len(periods.find_runs(np.arange(n))) == 0


def test_collapse(spark):
    rows, df = documents(spark)
    loud = [(500, "a b c " * 30 + "end"), (501, "x" * 2_000_000 + " y" * 9), (502, "no no no no no no"), (503, "  spaced\t\tout  ")]
    kinds = df.schema
    df = df.unionByName(spark.createDataFrame([(i, t, *[None] * (len(kinds) - 2)) for i, t in loud], kinds)).withColumnRenamed("h", "runs")
    rows += loud
    found = periods.collapse_runs(df)
    assert found.columns == [c for c in df.columns if c != "runs"] + ["n_words", "runs"]
    wanted = []
    for i, t in rows:
        words = WORD.findall(t or "")
        runs = runs_of(words) if len(words) < 3000 else [tuple(r) for r in periods.find_runs(periods._numbers([w.encode() for w in words])).tolist()]
        wanted.append((i, " ".join(collapsed(words, runs)) if runs else t, len(words), runs))
    assert sorted(((r.doc_id, r.text, r.n_words, [tuple(x) for x in r.runs]) for r in found.collect()), key=str) == sorted(wanted, key=str)
    assert periods.collapse_runs(df.limit(0)).count() == 0


def test_query_equals_brute_force(spark, tmp_path):
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choice("ab") if i % 3 else f"w{rng.randrange(50)}" for _ in range(rng.randrange(150)))) for i in range(150)]
    rows += [(None, None), (None, "a a a a a a a"), (20, None), (20, ""), (30, "one"), (30, "one")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    wanted = []
    for i, t in rows:
        words = tailed(i, WORD.findall(t or ""))
        runs = runs_of(words)
        top = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
        best = (None,) * 4 if top is None else (*top, 1000 * top[1] // top[2])
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        wanted.append((i, len(runs), *best, sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(" ".join(collapsed(words, runs)))))
    found = queries.op13_periodic_runs(spark, str(tmp_path))
    assert found.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert [t for c, t in found.dtypes if c in ("n_runs", "start", "length", "period", "exponent_milli")] == ["bigint"] * 5
    assert sorted((tuple(r) for r in found.collect()), key=str) == sorted(wanted, key=str)
    assert found.where(F.col("n_runs") > 0).count() > 20
