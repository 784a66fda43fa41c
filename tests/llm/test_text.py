"""WARC bundles, packing, fingerprints, token files, BPE and language ID against brute force and round trips."""

import base64
import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from rasterloom.llm import bpe, langid, packing, syncmers, tokenfiles, warc
from rasterloom.llm.storage import Workspace, open_fs
from rasterloom.llm.tokenizers_public import default_path, encode_with_added, encoding, encoding_with_added, split_pattern, tiktoken_ranks

from .helpers import documents, texts

MULTI = default_path("byte_bpe_multi_50k.tiktoken")
PLAIN = default_path("byte_bpe_50k.tiktoken")


def ordered(rows):
    return sorted((tuple(r) for r in rows), key=str)


# WARC


def pages(spark):
    rows = [(k, f"http://x/{k}?q=é \r\n{k}", t) for k, t in enumerate(texts(2, 40))]
    rows += [(None, None, "bare"), (None, None, "bare"), (3, "again", rows[3][2]), (3, "again", rows[3][2]), (9, None, None), (-4, "", "minus"), (1 << 60, "u", "big\r\n\r\nWARC/1.1")]
    return rows, spark.createDataFrame([(*r, "x", "y") for r in rows], "page_id long, url string, html string, digest string, revisit string").repartition(3)


@pytest.mark.parametrize("least", [0, 5])
def test_warc_round_trip(spark, least):
    rows, df = pages(spark)
    groups = defaultdict(list)
    for i, _, t in rows:
        groups[(t or "").encode()].append(i)
    wanted = []
    for data, ids in groups.items():
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        named = [i for i in ids if i is not None]
        chief = max(named, default=None)
        rest = Counter(ids)
        rest[chief] -= 1
        if len(data) < least:
            wanted += [(i, len(data), digest, "response", None) for i in ids]
        else:
            wanted += [(chief, len(data), digest, "response", None)] + [(i, len(data), digest, "revisit", chief) for i in rest.elements()]
    found = warc.archive_round_trip(df, least, archive_bytes=3000, frame_bytes=700)
    assert ordered(found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()) == ordered(wanted)
    given_payloads = {(i, (t or "").encode()) for i, _, t in rows}
    assert {(r.page_id, bytes(r.payload)) for r in found.where("record_type = 'response'").collect()} <= given_payloads
    assert warc.archive_round_trip(df.limit(0)).count() == 0


def test_warc_seeks(spark):
    import zstandard

    rows, df = pages(spark)
    ws = Workspace(spark, "test")
    index = warc.write_archives(df, ws, archive_bytes=3000, frame_bytes=700)
    got = warc.look_up(index, f"{ws.path}/archives", spark.createDataFrame([(7,), (1 << 60,), (123456,)], "page_id long")).collect()
    assert {r.page_id for r in got} == {7, 1 << 60} and len(got) == 2
    name = index.where("archive_bytes is not null").orderBy(F.desc("archive_bytes")).first().archive
    fs, root = open_fs(f"{ws.path}/archives")
    with fs.open_input_file(f"{root}/{name}") as f:
        data = f.read()
        frames = warc.read_seek_table(f, len(data))
    assert len(frames) > 1
    whole = b"".join(zstandard.ZstdDecompressor().decompress(data[at: at + c], max_output_size=d) for at, c, d in frames)
    plain = zstandard.ZstdDecompressor().stream_reader(data, read_across_frames=True).read()
    assert plain == whole and whole.startswith(b"WARC/1.1\r\n")


def test_record_names():
    for n in (0, 1, -1, 1 << 62, -(1 << 63), (1 << 63) - 1, 12345678901):
        assert warc.page_of(warc.record_uri(n, "x")) == n
    assert warc.page_of(warc.record_uri(None, "x")) is None


# Packing


@given(st.lists(st.integers(1, 50), max_size=120), st.integers(50, 60))
@settings(max_examples=60, deadline=None)
def test_pack_places_everything(lengths, capacity):
    lengths = np.array(lengths, np.int64)
    where, offset = packing.pack(lengths, capacity)
    for b in set(where.tolist()):
        mine = sorted((o, n) for w, o, n in zip(where, offset, lengths) if w == b)
        assert [o for o, _ in mine] == np.cumsum([0, *(n for _, n in mine)])[:-1].tolist() and sum(n for _, n in mine) <= capacity
    first_fit: list[int] = []
    for n in sorted(lengths.tolist(), reverse=True):
        k = next((k for k, f in enumerate(first_fit) if f + n <= capacity), None)
        if k is None:
            first_fit.append(n)
        else:
            first_fit[k] += n
    assert len(set(where.tolist())) <= len(first_fit) + 1


def test_local_search_empties_a_bin():
    # Best fit by decreasing length needs four bins of 10 here; three hold all.
    lengths = np.array([6, 5, 5, 4, 3, 3, 2, 2])
    for seed in range(5):
        mixed = np.random.default_rng(seed).permutation(lengths)
        assert len(set(packing.pack(mixed, 10)[0].tolist())) == 3


def test_packing(spark):
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(default_path("byte_bpe_50k.json"))
    rows, docs = documents(spark)
    wanted = []
    for i, t in rows:
        ids = [*own.encode(t or "", add_special_tokens=False).ids, 0]
        head = len(ids) % 64 or 64
        cuts = [0, *range(head, len(ids), 64)]
        wanted += [(i, k, s, len(part := ids[s:e]), zlib.crc32(np.array(part, "<u4").tobytes())) for k, (s, e) in enumerate(zip(cuts, [*cuts[1:], len(ids)]))]
    for group in (50_000, 40):
        found = packing.best_fit_pack(docs, capacity=64, group=group).collect()
        assert ordered(r[:5] for r in found) == ordered(wanted)
        bins = defaultdict(list)
        for r in found:
            bins[r.sequence_id].append((r.offset, r.length))
        for b in bins.values():
            b.sort()
            assert [o for o, _ in b] == np.cumsum([0, *(n for _, n in b)])[:-1].tolist() and b[-1][0] + b[-1][1] <= 64
        assert len(bins) <= 1.02 * sum(r.length for r in found) / 64 + 2 * max(1, len(found) / group)
    assert packing.best_fit_pack(docs.limit(0)).count() == 0


# Tokenizers


def test_json_vocabulary_gives_the_ids_of_tokenizers():
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(default_path("byte_bpe_50k.json"))
    enc = encoding_with_added(default_path("byte_bpe_50k.json"))
    rng = random.Random(4)
    letters = [chr(c) for c in (*range(0x250), *range(0x2000, 0x2030), 0x3000, 0x4E00, 0x1F600, 0x300, 0x661)]
    for t in [x for x in texts() if x] + ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(800)] + ["<|endoftext|> a"]:
        assert encode_with_added(enc, t).tolist() == own.encode(t, add_special_tokens=False).ids


def test_packing_takes_added_tokens(spark):
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(default_path("byte_bpe_50k.json"))
    rng = random.Random(5)
    pieces = ["<|endoftext|>", "<|endoftext", "|>", " ", "   ", "\n", "a", "don't", " the", "世界", "12"]
    rows = [(0, "a <|endoftext|> b")] + [(k, "".join(rng.choice(pieces) for _ in range(rng.randint(1, 20)))) for k in range(1, 200)]
    wanted = {i: (len(ids := [*own.encode(t, add_special_tokens=False).ids, 0]), zlib.crc32(np.array(ids, "<u4").tobytes())) for i, t in rows}
    found = packing.best_fit_pack(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r.doc_id: (r.length, r.ids_crc32) for r in found.collect()} == wanted


LETTERS = st.text(st.one_of(st.characters(codec="utf-8"), st.sampled_from(" \n\t'sdthe…0123 \x1c\x85　᠎")), max_size=80)


@given(LETTERS)
@settings(max_examples=400, deadline=None)
def test_prefix_bpe_equals_tiktoken(text):
    ids, n, data = bpe.encode_text(text, MULTI, split_pattern())
    wanted = encoding(MULTI).encode_ordinary(text)
    assert ids == ",".join(map(str, wanted)) and n == len(wanted) and data == text.encode()


def test_prefix_tables():
    rng = random.Random(7)
    one = bpe.PrefixBPE(tiktoken_ranks(MULTI))
    plain = lambda data: [one.ranks[x] for x in one._merged(data)]
    table = bpe.PrefixTable(one)
    for _ in range(60):
        if rng.random() < 0.5:
            table.append("".join(rng.choice("theaning ésto0") for _ in range(rng.randint(0, 6))).encode())
        else:
            a = rng.randint(0, len(table.data))
            table.edit(a, min(len(table.data), a + rng.randint(0, 5)), rng.choice([b"", b"ing", b" th", b"\xff"]))
        assert table.ids() == plain(table.data)
        k = rng.randint(0, len(table.data))
        assert table.ids(k) == plain(table.data[:k])
    ids = list(one.bytes_of)
    for _ in range(3000):
        a, b = rng.choice(ids[:4000]), rng.choice(ids[:4000])
        assert one.compatible(a, b) == (one._merged(one.bytes_of[a] + one.bytes_of[b]) == [one.bytes_of[a], one.bytes_of[b]])


def test_encode_documents(spark):
    rows, docs = documents(spark)
    enc = encoding(MULTI)
    wanted = [(i, len(ids := enc.encode_ordinary(t or "")), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in rows]
    assert ordered(bpe.encode_documents(docs).collect()) == ordered(wanted)
    got = bpe.encode_documents(docs, with_ids=True).where("doc_id = 0").first()
    assert got.ids == enc.encode_ordinary(rows[0][1]) and bytes(got.decoded).decode() == rows[0][1]
    assert bpe.encode_documents(docs.limit(0)).count() == 0


def test_token_counts(spark):
    rows, docs = documents(spark)
    enc = encoding(PLAIN)
    wanted = [(i, len(enc.encode_ordinary(t or ""))) for i, t in rows]
    for file_bytes, block in ((1 << 25, 1 << 20), (900, 7), (3000, 1)):
        found = tokenfiles.token_counts(docs, file_bytes=file_bytes, block=block)
        assert ordered(found.select("doc_id", "n_tokens").collect()) == ordered(wanted)
    assert tokenfiles.token_counts(docs.limit(0)).count() == 0


def test_token_files_check_ids(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    for options in ({"eod": 5}, {"width": 2, "eod": 70_000}, {"eod": -1}, {"width": 1}):
        with pytest.raises(ValueError):
            tokenfiles.token_counts(docs, **options)
    assert tokenfiles.token_counts(docs, eod=70_000, width=4).first().n_tokens == 2


def test_separator_scan_edges(spark):
    ws = Workspace(spark, "test")
    fs, root = open_fs(ws.path)
    fs.create_dir(root)
    files = {"a": [9, 9, 1, 2, 3, 4, 9, 5], "b": [1, 2, 3], "c": [9], "d": [1, 1, 1, 1, 1, 1, 9, 9]}
    for name, ids in files.items():
        with fs.open_output_stream(f"{root}/{name}") as f:
            f.write(np.array(ids, "<u4").tobytes())
    df = spark.createDataFrame([(k, len(v)) for k, v in files.items()] + [("none", 0)], "file string, file_ids long")
    wanted = []
    for name, ids in files.items():
        start = 0
        ends = [k for k, x in enumerate(ids) if x == 9]
        for k, e in enumerate(ends):
            wanted.append((name, k, start, e - start))
            start = e + 1
    for block in (1, 2, 3, 8, 100):
        assert ordered(tokenfiles.separator_scan(df, ws.path, 9, 4, block).collect()) == ordered(wanted)


# Fingerprints


def anchors_by_hand(text, k=syncmers.K, s=syncmers.S):
    """(place, hash) of the closed syncmers of the text's bytes."""
    data, h = (text or "").encode(), lambda b: (x := xxhash.xxh64_intdigest(b, 42)) - (1 << 64 if x >> 63 else 0)
    if len(data) < k:
        return [(0, h(data) & 0xFFFFFFFF)] if data else []
    inner = [h(data[i: i + s]) for i in range(len(data) - s + 1)]
    closed = lambda i: min(inner[i: i + k - s + 1]) in (inner[i], inner[i + k - s])
    return [(i, h(data[i: i + k]) & 0xFFFFFFFF) for i in range(len(data) - k + 1) if closed(i)]


def fingerprint_by_hand(found):
    return "".join(f"{place - (found[i - 1][0] if i else 0):02x}{h:08x}" for i, (place, h) in enumerate(found))


def likeness_by_hand(a, b):
    steps = lambda x: {(p[1], q[0] - p[0], q[1]) for p, q in zip(x, x[1:])} if len(x) != 1 else {x[0][1]}
    both = steps(a) | steps(b)
    return len(steps(a) & steps(b)) / len(both) if both else 1.0


def edited_by_hand(rows):
    signed = lambda t: (x := xxhash.xxh64_intdigest(t.encode(), 42)) - (1 << 64 if x >> 63 else 0)
    inorder = sorted(((i is not None, i or 0, signed(t or ""), t or "", i) for i, t in rows))
    out = []
    for n, (*_, text, i) in enumerate(inorder):
        after = inorder[(n + 1) % len(inorder)][3]
        cut = len(text) // 4
        edited = text[: len(text) - cut] + after[:cut]
        a, e, b = anchors_by_hand(text), anchors_by_hand(edited), anchors_by_hand(after)
        out.append((i, len(text), hashlib.sha256(edited.encode()).hexdigest(), fingerprint_by_hand(a), fingerprint_by_hand(e), round(likeness_by_hand(a, e), 9), round(likeness_by_hand(a, b), 9)))
    return out


def rounded(found):
    return ordered((*r[:5], round(r[5], 9), round(r[6], 9)) for r in found)


@pytest.mark.parametrize(("size", "ranges"), [(1 << 22, 64**3), (400, 64**3), (1, 64**3), (1, 5)])
def test_fingerprints(spark, size, ranges):
    rows, docs = documents(spark)
    assert rounded(syncmers.fingerprint_and_edit(docs, range_bytes=size, ranges=ranges).collect()) == ordered(edited_by_hand(rows))


def test_fingerprints_without_repeated_rows(spark, monkeypatch):
    monkeypatch.setattr(syncmers, "PIECE", 50)  # texts of many pieces
    rows = [(7 * i, t) for i, t in enumerate(texts(2, 40))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert rounded(syncmers.fingerprint_and_edit(docs, range_bytes=300).collect()) == ordered(edited_by_hand(rows))
    assert syncmers.fingerprint_and_edit(docs.limit(0)).count() == 0
    one = syncmers.fingerprint_and_edit(docs.where("doc_id = 7")).first()
    assert one.near_next == 1.0


def test_texts_without_spaces_are_alike_in_part(spark):
    rng = random.Random(1)
    chars = [chr(c) for c in range(0x4E00, 0x5E00)]
    rows = [(i, "".join(rng.choice(chars) for _ in range(1200))) for i in range(12)]
    for r in syncmers.fingerprint_and_edit(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        assert 0.55 < r.near_edited < 0.65 and r.near_next < 0.02


def test_anchors_cover_every_stretch(spark):
    rows, docs = documents(spark)
    found = docs.select("text", syncmers.anchors(F.encode(F.coalesce("text", F.lit("")), "UTF-8")).alias("a")).collect()
    for r in found:
        assert [(x >> 32, x & 0xFFFFFFFF) for x in r.a] == anchors_by_hand(r.text)
        assert all(0 < (y >> 32) - (x >> 32) <= syncmers.K - syncmers.S for x, y in zip(r.a, r.a[1:]))


def test_fingerprint_long_text(spark):
    rng = random.Random(2)
    text = "".join(rng.choice("abcdefgh é") for _ in range(3_000_000))
    docs = spark.createDataFrame([(1, text), (2, "short text of a few words only")], "doc_id long, text string")
    found = {r.doc_id: r for r in syncmers.fingerprint_and_edit(docs).collect()}
    assert found[1].n_chars == 3_000_000 and 0.7 < found[1].near_edited < 0.8 and found[1].near_next == 0.0


def test_edits_move_few_anchors(spark):
    rng = random.Random(3)
    words = [f"w{rng.randint(0, 400)}" for _ in range(500)]
    a, b = " ".join(words), " ".join([*words[:200], "new", *words[200:]])
    df = spark.createDataFrame([(1, a), (2, b)], "doc_id long, text string")
    x, y = ({p & 0xFFFFFFFF for p in r.a} for r in df.orderBy("doc_id").select(syncmers.anchors(F.encode("text", "UTF-8")).alias("a")).collect())
    assert len(x ^ y) <= 2 * syncmers.K


# Language ID


def test_filter_returns_all_languages():
    rng = np.random.default_rng(0)
    grams = {f"l{k:02d}": rng.integers(0, 1 << 32, 50, dtype=np.uint32) for k in range(70)}
    model = langid.LanguageFilter.build(grams, 1 << 12, 3)
    for k, name in enumerate(model.languages):
        assert model.hits(grams[name])[k] == 50
    assert model.rows.shape[1] == 2 and (model.hits(rng.integers(0, 1 << 32, 20_000, dtype=np.uint32)) / 20_000 < model.chance + 0.01).all()


def test_language_id(spark):
    rng = random.Random(9)
    lexicon = {"en": "the house and river stands with green", "fr": "le maison et rivière debout avec vert", "de": "das haus und fluß steht mit grün"}
    rows = [(k, " ".join(rng.choice(lexicon[lang].split()) for _ in range(12)), lang) for k, lang in enumerate(["en", "fr", "de"] * 100)]
    rows += [(1000, None, "en"), (1001, "", "fr"), (1002, "123 !?", "de"), (None, "the house", "en"), (1003, "the river", None), (1004, "q", "en"), (1003, "the river", None)]
    docs = spark.createDataFrame([(*r, "s", 1.0) for r in rows], "doc_id long, text string, lang string, source string, score double")
    found = langid.identify(docs).collect()
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 3 == 1
    assert Counter((r.doc_id, r.held_out) for r in found) == Counter((i, held(i)) for i, _, _ in rows)
    pred = {r.doc_id: r for r in found}
    assert all(pred[i].lang_pred == lang for i, _, lang in rows[:300]) and all(0 <= r.score <= 1 for r in found)
    assert [pred[i].lang_pred for i in (1000, 1001, 1002)] == ["und"] * 3 and pred[1003].lang_pred == "en" and pred[1004].lang_pred in lexicon
    relabelled = docs.withColumn("lang", F.when(langid.held_out(), F.lit("xx")).otherwise(F.col("lang")))
    assert ordered(langid.identify(relabelled).collect()) == ordered(found)
    kept = langid.keep_known(docs)
    assert {r.score for r in kept.collect()} == {1.0}  # the column that was there
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} >= set(range(300)) and not kept.where("doc_id in (1000, 1001, 1002)").count()
    assert langid.identify(docs.limit(0)).count() == 0


def languages_by_hand(learn: list[tuple[str, str]], texts: list[str | None], grams: int) -> list[tuple[str, float]]:
    """(language, share of its n-grams) with exact sets in place of the filters."""

    def found(text: str) -> list[bytes]:
        data = b" " + bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in text.lower().encode()) + b" "
        every = [data[k: k + 4] for k in range(len(data) - 3)] or [data.ljust(4)]
        return [g for g in every if b"  " not in g] or every[:1]

    counts: dict[str, Counter] = {}
    for text, lang in learn:
        if any(c.isalpha() for c in text):
            counts.setdefault(lang, Counter()).update(set(found(text)))
    known = {lang: {g for _, g in sorted((-n, int.from_bytes(g, "little")) for g, n in c.items())[:grams]} for lang, c in sorted(counts.items())}
    out = []
    for text in texts:
        if text is None or not any(c.isalpha() for c in text):
            out.append(("und", 0.0))
            continue
        own = [int.from_bytes(g, "little") for g in found(text)]
        out.append(max(((lang, sum(g in s for g in own) / len(own)) for lang, s in known.items()), key=lambda v: v[1]))
    return out


def test_language_id_equals_exact_sets_and_knows_what_it_has_not_seen(spark):
    """On all documents: the same languages as without false positives, scores within what the filters' chance hits can do, and nearly all held-out documents right."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    rows = docs.orderBy("doc_id").collect()
    held = {r.doc_id for r in rows if zlib.crc32(str(r.doc_id).encode()) % 3 == 1}
    got = {r.doc_id: r for r in langid.identify(docs).collect()}
    # Every language has fewer than 2000 documents here, so that all are learned from.
    wanted = languages_by_hand([(r.text, r.lang) for r in rows if r.doc_id not in held and r.text is not None and r.lang is not None], [r.text for r in rows], 6000)
    assert len(got) == len(rows) and {i for i in got if got[i].held_out} == held
    for r, (lang, share) in zip(rows, wanted):
        assert got[r.doc_id].lang_pred == lang and abs(got[r.doc_id].score - share) < 0.02
    judged = [r for r in rows if r.doc_id in held and r.lang is not None and got[r.doc_id].lang_pred != "und"]
    assert sum(got[r.doc_id].lang_pred == r.lang for r in judged) >= 0.99 * len(judged) > 100


def test_language_columns_of_any_name_come_back(spark):
    rows = [(k, "the house and the garden of the street", "en", k, k + 1, k + 2) for k in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, _found long, _FOUND_ long, `a.b` long")
    assert sorted(map(tuple, langid.keep_known(docs).collect())) == rows
    found = langid.predict(docs, langid.fit(docs))
    assert found.columns == [*docs.columns, "lang_pred", "score"] and sorted(r[3] for r in found.collect()) == list(range(40))


def test_language_keeps_what_is_too_short_to_judge(spark):
    rows = [(k, f"the house and the garden number {k} of the street", "en") for k in range(60)] + [(100, "A.", "en"), (101, "b", "en"), (102, "qxz", "en"), (103, ".", "en"), (104, "", "en"), (105, None, "en")]
    rows = [(i, t, lang if i < 100 else None) for i, t, lang in rows]
    kept = langid.keep_known(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert {r.doc_id for r in kept.where("doc_id >= 100").collect()} == {100, 101}
    assert kept.where("doc_id < 100").count() == 60
