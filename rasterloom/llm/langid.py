"""Language ID by n-gram filters that hold a bitmask of languages.

The filter is a bit-sliced Bloom filter: one row of bits per slot, one bit per language, so a look-up of an n-gram (the
``and`` of its slots) returns every language that contains it. A text's n-grams are looked up together; per language, the
hits are counted and corrected for the share that the filter's own fill would hit by chance. The language with the largest corrected share
of the text's n-grams is predicted, and that share is the score.

N-grams are 4-byte windows of the text in lower case, with ASCII that is no letter turned into a space. The model is of bounded size
(``slots`` rows; ``grams`` n-grams for each language) and is sent to the tasks.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .storage import quoted, release_memory, releasing

UNKNOWN = "und"
#: Bytes whose n-grams are looked up at once.
RUN = 1 << 20
#: Languages that a filter can hold.
LANGUAGES = 1024
_PLAIN = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))


def grams_of(data: bytes) -> np.ndarray:
    """The 4-byte windows of the normalised bytes, spaces around them, as uint32; windows with two spaces side by side are left out."""
    b = np.frombuffer(b" " + data + b" ", np.uint8).astype(np.uint32)
    if len(b) < 4:
        b = np.concatenate([b, np.full(4 - len(b), 32, np.uint32)])
    found = b[:-3] | b[1:-2] << 8 | b[2:-1] << 16 | b[3:] << 24
    space = b == 32
    double = space[:-1] & space[1:]
    kept = found[~(double[:-2] | double[1:-1] | double[2:])]
    return kept if len(kept) else found[:1]


def normalised(text: str) -> bytes:
    return text.lower().encode("utf-8", "replace").translate(_PLAIN)


#: Four bytes without two spaces side by side.
_APART = re.compile(rb"(?s)(?!  ).(?!  ).(?!  )..")


def can_judge(text: str | None) -> bool:
    """Whether the text has an n-gram without two spaces side by side; others are in no longer text's n-grams."""
    return _APART.search(b" " + normalised(text or "") + b" ") is not None


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


@dataclass
class LanguageFilter:
    """languages in ascending order; rows: uint64 masks, (slots, words); chance: each language's share of false hits."""

    languages: list[str]
    rows: np.ndarray
    chance: np.ndarray
    hashes: int

    @staticmethod
    def _slots(grams: np.ndarray, slots: int, hashes: int) -> Iterator[np.ndarray]:
        x = grams.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(29)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        low, step = x >> np.uint64(40), (x & np.uint64(0xFFFFFF)) | np.uint64(1)
        for k in range(hashes):
            yield ((low + np.uint64(k) * step) & np.uint64(slots - 1)).astype(np.int64)

    @classmethod
    def build(cls, grams: dict[str, np.ndarray], slots: int, hashes: int) -> LanguageFilter:
        languages = sorted(grams)
        rows = np.zeros((slots, max(1, -(-len(languages) // 64))), np.uint64)
        for k, name in enumerate(languages):
            for at in cls._slots(grams[name], slots, hashes):
                rows[at, k // 64] |= np.uint64(1) << np.uint64(k % 64)
        fill = np.array([((rows[:, k // 64] >> np.uint64(k % 64)) & np.uint64(1)).mean() for k in range(len(languages))])
        return cls(languages, rows, fill**hashes, hashes)

    def hits(self, grams: np.ndarray) -> np.ndarray:
        """Per language, how many of the n-grams its filter holds."""
        mask = None
        for at in self._slots(grams, len(self.rows), self.hashes):
            mask = self.rows[at] if mask is None else mask & self.rows[at]
        return np.array([((mask[:, k // 64] >> np.uint64(k % 64)) & np.uint64(1)).sum() for k in range(len(self.languages))], np.int64)

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.languages or not has_letter(text):
            return UNKNOWN, 0.0
        data, total, hits = normalised(text), 0, np.zeros(len(self.languages), np.int64)
        for k in range(0, len(data), RUN):
            grams = grams_of(data[k: k + RUN + 3 if k + RUN < len(data) else None])
            hits += self.hits(grams)
            total += len(grams)
        share = np.clip((hits / total - self.chance) / np.maximum(1 - self.chance, 1e-9), 0, 1)
        best = int(np.argmax(share))
        return self.languages[best], float(share[best])


def fit(docs: DataFrame, sample: int = 2000, grams: int = 6000, slots: int = 1 << 18, hashes: int = 3) -> LanguageFilter:
    """A filter learned from docs (doc_id, text, lang) with text and lang: about ``sample`` whole documents of each language, chosen
    by a hash of doc_id, and the ``grams`` n-grams of a language that most of its documents hold (ties: smaller ones)."""
    docs = docs.where("text is not null and lang is not null").select("doc_id", "text", F.col("lang").cast("string").alias("lang"))
    counts = docs.groupBy("lang").count().limit(LANGUAGES + 1).collect()
    if len(counts) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages")
    if not counts:
        return LanguageFilter.build({}, slots, hashes)
    share = F.create_map(*[F.lit(x) for lang, n in counts for x in (lang, sample / n)])
    roll = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) / float(1 << 20)
    chosen = docs.where(roll < F.element_at(share, F.col("lang"))).select("lang", "text")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for lang, part in pdf.groupby("lang"):
                each = [np.unique(grams_of(normalised(t))) for t in part["text"] if has_letter(t)]
                if each:
                    gram, n = np.unique(np.concatenate(each), return_counts=True)
                    yield pd.DataFrame({"lang": lang, "gram": gram.astype(np.int64), "n": n})

    counted = chosen.mapInPandas(releasing(count), "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    top = counted.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))).where(F.col("k") <= grams)
    got = top.select("lang", "gram").toPandas()  # grams rows for each language at most
    return LanguageFilter.build({x: g["gram"].to_numpy(np.uint32) for x, g in got.groupby("lang")}, slots, hashes)


def held_out(doc_id: str = "doc_id"):
    """Whether crc32(doc_id as text) mod 3 is 1; null: not."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _with_found(docs: DataFrame, model: LanguageFilter) -> tuple[DataFrame, str]:
    """docs with one more column, struct<lang_pred, score, judged>, and its name, which no column of docs has."""
    shared, name = docs.sparkSession.sparkContext.broadcast(model), "_found"
    while name in {c.lower() for c in docs.columns}:
        name += "_"

    def run(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in texts:
            yield pd.DataFrame([(*shared.value.predict(t), can_judge(t)) for t in s], columns=["lang_pred", "score", "judged"])
        release_memory()

    return docs.withColumn(name, F.pandas_udf(run, "lang_pred string, score double, judged boolean")(F.col("text").cast("string"))), name


def predict(docs: DataFrame, model: LanguageFilter) -> DataFrame:
    """docs, all columns, with lang_pred and score (double, 0 to 1) of their text. No letter or null: ``und``, 0. Columns of those names are replaced."""
    kept = [c for c in docs.columns if c not in ("lang_pred", "score")]
    found, at = _with_found(docs.select(*map(quoted, kept)), model)
    return found.select(*map(quoted, kept), f"{at}.lang_pred", f"{at}.score")


def identify(docs: DataFrame, **options) -> DataFrame:
    """doc_id, held_out, lang_pred, score of each row of docs (doc_id, text, lang), learned from the rows of docs that are not held out.

    Rows without text, lang or doc_id teach nothing. All of a long text counts. With nothing learned all are ``und``. Repeated rows each give a row; ties between languages go to
    the first in ascending order; other columns are not looked at.
    """
    model = fit(docs.where(~held_out()).where("doc_id is not null"), **options)
    return predict(docs.select("doc_id", held_out().alias("held_out"), "text"), model).select("doc_id", "held_out", "lang_pred", "score")


def keep_known(docs: DataFrame, least: float = 0.2, **options) -> DataFrame:
    """docs without those whose language is ``und`` or scores under ``least``; texts with letters but too short to judge stay. docs' columns."""
    model = fit(docs.where(~held_out()).where("doc_id is not null"), **options)
    found, at = _with_found(docs, model)
    return found.where((F.col(f"{at}.lang_pred") != UNKNOWN) & ((F.col(f"{at}.score") >= least) | ~F.col(f"{at}.judged"))).select(*map(quoted, docs.columns))
