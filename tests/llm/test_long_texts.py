"""Texts of megabytes, whole, for the operators that read texts row by row."""

import base64
import hashlib
import random
import zlib

import numpy as np
import pytest

from rasterloom.llm import bpe, langid, packing, tokenfiles, warc
from rasterloom.llm.tokenizers_public import default_path, encoding

SPECIES = {"en": "the of and to in that was his with as for on by at from they which", "es": "de la que el en los del se las por un para con no una su al", "fr": "le des les est dans une pour qui pas plus par sur au avec sont"}


def prose(lang, n, seed):
    rng = random.Random(seed)
    words = SPECIES[lang].split()
    return " ".join(rng.choice(words) + rng.choice(["", "", "", ",", "é" * (lang == "fr")]) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    long = prose("en", 400_000, 1)
    return [(1, long), (2, long + " end"), (3, "short"), (4, "x" * 200_000), (5, None), (6, "\n" * 300_000)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(3)


def test_archives(spark, rows):
    pages = spark.createDataFrame([(i, f"http://x/{i}", t) for i, t in rows] + [(9, "http://x/9", rows[0][1])], "page_id long, url string, html string")
    found = {r.page_id: r for r in warc.archive_round_trip(pages).drop("payload").collect()}
    for i, t in [*rows, (9, rows[0][1])]:
        data = (t or "").encode()
        assert (found[i].payload_bytes, found[i].payload_digest) == (len(data), base64.b32encode(hashlib.sha1(data).digest()).decode())
    assert (found[1].record_type, found[1].refers_to, found[9].record_type) == ("revisit", 9, "response")


def test_token_counts_and_ids(rows, docs):
    plain, multi = encoding(default_path("byte_bpe_50k.tiktoken")), encoding(default_path("byte_bpe_multi_50k.tiktoken"))
    assert {r.doc_id: r.n_tokens for r in tokenfiles.token_counts(docs).collect()} == {i: len(plain.encode_ordinary(t or "")) for i, t in rows}
    for r in bpe.encode_documents(docs).collect():
        text = dict(rows)[r.doc_id] or ""
        ids = multi.encode_ordinary(text)
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_packing(rows, docs):
    plain = encoding(default_path("byte_bpe_50k.tiktoken"))
    found = packing.best_fit_pack(docs).toPandas()
    for i, t in rows:
        ids = [*plain.encode_ordinary(t or ""), 0]
        mine = found[found["doc_id"] == i].sort_values("piece")
        assert mine["start"].tolist() == np.concatenate([[0], mine["length"].cumsum()[:-1]]).astype(int).tolist() and mine["length"].sum() == len(ids) and (mine["length"].iloc[1:] == 2048).all()
        for r in mine.iloc[[0, -1]].itertuples():
            assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start: r.start + r.length], "<u4").tobytes())
    used = found.groupby("sequence_id").agg(n=("length", "sum"), end=("offset", "max"))
    assert (used["n"] <= 2048).all() and (used["end"] < 2048).all()


def test_languages(spark):
    small = [(k, prose(lang, 60, k), lang) for k, lang in enumerate(list(SPECIES) * 60)]
    big = [(1000 + k, prose(lang, 300_000, k), lang) for k, lang in enumerate(SPECIES)]
    found = {r.doc_id: r for r in langid.identify(spark.createDataFrame(small + big, "doc_id long, text string, lang string")).collect()}
    assert [found[i].lang_pred for i, _, _ in big] == list(SPECIES)
    assert all(0 <= found[i].score <= 1 for i, _, _ in big)


def test_texts_too_short_to_judge():
    """An n-gram counts unless two of its bytes are neighbouring spaces; megabytes without one are read once."""
    rng = random.Random(8)
    for _ in range(3000):
        text = "".join(rng.choice("a  b\n.é") for _ in range(rng.randrange(9)))
        data = b" " + langid.normalised(text) + b" "
        assert langid.can_judge(text) == any(b"  " not in data[k: k + 4] for k in range(len(data) - 3)), text
    assert not langid.can_judge(" " * 5_000_000) and not langid.can_judge(None) and langid.can_judge(" " * 5_000_000 + "word")
