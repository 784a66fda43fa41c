"""Byte-level BPE by prefix dynamic programming.

For every prefix of a byte string, BPE's encoding ends in one token, and what precedes it is the encoding of the
shorter prefix. So one token id per byte holds the encodings of all prefixes: the last token of a prefix is the only one
that is compatible with the last token before it (the pair, encoded as a whole, gives the pair). Appending extends the
table; an edit keeps the table up to where it begins. Walking back from the end gives the ids.

Texts are split by the pattern first; each match is encoded separately. A worker keeps the results of matches it has
seen lately, in tables of bounded size, which changes no result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .tokenizers_public import default_path, split_pattern, tiktoken_ranks

CACHE = 600_000
#: Above every rank.
NEVER = 1 << 40


class PrefixBPE:
    """An encoder for one table of ranks (token bytes to id)."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.longest = max(map(len, ranks))
        self._pairs: dict[tuple[int, int], bool] = {}
        self._edges: dict[tuple[int, bool], list | None] = {}

    def _merged(self, data: bytes, stop: int = 1) -> list[bytes]:
        """Plain merging, least rank first, down to ``stop`` parts; for short strings: single tokens."""
        get, parts = self.ranks.get, [data[k: k + 1] for k in range(len(data))]
        while len(parts) > stop:
            best = min((get(x + y, NEVER), k) for k, (x, y) in enumerate(zip(parts, parts[1:])))
            if best[0] == NEVER:
                break
            parts[best[1]: best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]
        return parts

    def _edge(self, token: int, right: bool) -> list[tuple[bytes, int, int]] | None:
        """The parts that stand at the token's right (or left) end while it is merged, the token first: (bytes, rank at
        which the part forms, rank at which it is absorbed). None: merging the token's bytes doesn't give it."""
        known = self._edges.get((token, right), self)
        if known is not self:
            return known
        data, absorbed, chain = self.bytes_of[token], NEVER, []
        whole = self._merged(data) == [data]
        while whole:
            rank = self.ranks[data] if len(data) > 1 else -1
            chain.append((data, rank, absorbed))
            if len(data) == 1:
                break
            data, absorbed = self._merged(data, 2)[-1 if right else 0], rank
        self._edges[token, right] = chain if whole else None
        return self._edges[token, right]

    def sound(self, token: int) -> bool:
        """Whether merging the token's bytes gives the token."""
        return self._edge(token, True) is not None

    def compatible(self, a: int, b: int) -> bool:
        """Whether merging the bytes of both gives just the two: no part at a's right end meets a part at b's left end with
        which it merges before either is absorbed. At equal ranks the left merge comes first."""
        known = self._pairs.get((a, b))
        if known is None:
            if len(self._pairs) >= CACHE:
                self._pairs.clear()
            known = self._pairs[a, b] = self._apart(self._edge(a, True), self._edge(b, False))
        return known

    def _apart(self, left: list | None, right: list | None) -> bool:
        if left is None or right is None:
            return False
        get = self.ranks.get
        for x, x_from, x_to in left:
            for y, y_from, y_to in right:
                if x_from < y_to and y_from < x_to:
                    rank = get(x + y, NEVER)
                    if rank < x_to and rank <= y_to and rank != NEVER:
                        return False
        return True

    def extend(self, last: list[int], data: bytes) -> list[int]:
        """Fills ``last`` (the last token of each prefix of data that it holds already) up to all of data. As only one token is right, the order of trial is free: first the place where the
        last token of the prefix before began, then the last bytes, then the rest."""
        get, known, bytes_of, add = self.ranks.get, self._pairs.get, self.bytes_of, last.append
        for end in range(len(last) + 1, len(data) + 1):
            before = end - 1 - len(bytes_of[last[-1]]) if last else 0
            tried = (before, end - 1, end - 2, end - 3)
            for begin in tried:
                token = get(data[begin:end]) if begin >= 0 else None
                if token is not None:
                    if not begin:
                        ok = self.sound(token)
                    elif (ok := known(pair := (last[begin - 1], token))) is None:
                        ok = self.compatible(*pair)
                    if ok:
                        add(token)
                        break
            else:
                add(self._other(last, data, end, tried))
        return last

    def _other(self, last: list[int], data: bytes, end: int, tried: tuple[int, ...]) -> int:
        for begin in range(max(0, end - self.longest), end):
            if begin not in tried and (token := self.ranks.get(data[begin:end])) is not None:
                if self.compatible(last[begin - 1], token) if begin else self.sound(token):
                    return token
        raise ValueError(f"no token ends at byte {end} of {data[:end]!r}")

    def walk(self, last: list[int], end: int | None = None) -> list[int]:
        """The ids of the prefix of ``end`` bytes."""
        end, out = len(last) if end is None else end, []
        while end:
            out.append(last[end - 1])
            end -= len(self.bytes_of[out[-1]])
        return out[::-1]

    def encode_piece(self, data: bytes) -> list[int]:
        """One match of the pattern. A match that is a token itself is that token, as in tiktoken."""
        whole = self.ranks.get(data)
        return [whole] if whole is not None else self.walk(self.extend([], data))


class PrefixTable:
    """The encodings of all prefixes of one byte string, kept right under appends and edits."""

    def __init__(self, bpe: PrefixBPE, data: bytes = b""):
        self.bpe, self.data = bpe, data
        self.last = bpe.extend([], data)

    def append(self, more: bytes) -> None:
        self.data += more
        self.bpe.extend(self.last, self.data)

    def edit(self, begin: int, end: int, new: bytes) -> None:
        """Replaces bytes begin..end; prefixes up to begin are kept."""
        self.data = self.data[:begin] + new + self.data[end:]
        del self.last[begin:]
        self.bpe.extend(self.last, self.data)

    def ids(self, prefix: int | None = None) -> list[int]:
        return self.bpe.walk(self.last, prefix)


class _Recent(dict):
    """A table that keeps what was asked for lately: when it is full, it becomes the old one, and what is asked for again moves back."""

    def __init__(self, most: int):
        super().__init__()
        self.most, self.old = most, {}

    def __missing__(self, key: str) -> tuple[str, bytes]:
        found = self.old.get(key) or self.make(key)
        if len(key) <= 40:
            if len(self) >= self.most:
                self.old = dict(self)
                self.clear()
            self[key] = found
        return found


class _Pieces(_Recent):
    """Match to (decimal ids joined by commas, decoded bytes)."""

    def __init__(self, bpe: PrefixBPE, most: int):
        super().__init__(most)
        self.bpe = bpe

    def make(self, piece: str) -> tuple[str, bytes]:
        ids, bytes_of = self.bpe.encode_piece(piece.encode("utf-8", "replace")), self.bpe.bytes_of
        return (str(ids[0]), bytes_of[ids[0]]) if len(ids) == 1 else (",".join(map(str, ids)), b"".join([bytes_of[i] for i in ids]))


class _Stretches(_Recent):
    """The same for what stands between two single spaces, with the space before it; its matches are those of the text. A match that begins with the space is found here without it."""

    def __init__(self, split, pieces: _Pieces, most: int):
        super().__init__(most)
        self.split, self.pieces = split, pieces

    def make(self, stretch: str) -> tuple[str, bytes]:
        head, *rest = self.split(" " + stretch)
        if not rest:
            return self.pieces.make(head)
        # The first match is shorter than the stretch, so this ends.
        parts = [self[head[1:]] if len(head) > 1 else self.pieces[head], *map(self.pieces.__getitem__, rest)]
        return ",".join([x[0] for x in parts]), b"".join([x[1] for x in parts])


def _joined(parts) -> tuple[str, bytes]:
    parts = list(parts)
    return ",".join([x[0] for x in parts]), b"".join([x[1] for x in parts])


@lru_cache(maxsize=2)
def _worker(path: str, pattern: str, spaced: bool):
    import regex

    split, pieces = regex.compile(pattern, regex.V0).findall, _Pieces(PrefixBPE(tiktoken_ranks(path)), CACHE // 4)
    # A space beside white space, or at an end, belongs to a run, which one match may take.
    white = "".join(map(re.escape, regex.findall(r"\s", "".join(map(chr, range(0x110000))))))
    odd = re.compile(f" [{white}]|[{white}] |^ | $").search
    return split, pieces, _Stretches(split, pieces, CACHE) if spaced else None, odd


def encode_text(text: str | None, path: str, pattern: str) -> tuple[str, int, bytes]:
    """(ids joined by commas, number of ids, decoded bytes) of a whole text; null: empty.

    With the public pattern no match holds a single space but as its first character, so texts are cut before single spaces first, which spares most searches.
    """
    text = text or ""
    split, pieces, stretches, odd = _worker(path, pattern, pattern == split_pattern())
    if stretches is None or not text or odd(text):
        ids, data = _joined(map(pieces.__getitem__, split(text)))
    else:
        head, *rest = text.split(" ")
        first, parts = _joined(map(pieces.__getitem__, split(head))), list(map(stretches.__getitem__, rest))
        ids, data = ",".join([first[0], *[x[0] for x in parts]]), b"".join([first[1], *[x[1] for x in parts]])
    return ids, ids.count(",") + 1 if ids else 0, data


def encode_documents(docs: DataFrame, path: str | None = None, pattern: str | None = None, with_ids: bool = False) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, n_tokens, ids_sha256 of the decimal ids joined by commas, decoded_sha256
    of the decoded bytes; with_ids: also ids, array<int>, and decoded, binary.

    Null and empty texts have no ids; long ones are encoded whole, match by match. Repeated rows each give a row; null doc_ids stay null; other columns are not looked at.
    """
    path, pattern = path or default_path("byte_bpe_multi_50k.tiktoken"), pattern or split_pattern()
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded binary" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, max(1, batch.num_rows), 1000):
                b = batch.slice(k, 1000)
                n, ids_hash, text_hash, ids, decoded = [], [], [], [], []
                for text in b.column(1):
                    joined, count, data = encode_text(text.as_py(), path, pattern)
                    n.append(count)
                    ids_hash.append(hashlib.sha256(joined.encode()).hexdigest())
                    text_hash.append(hashlib.sha256(data).hexdigest())
                    if with_ids:
                        ids.append([int(x) for x in joined.split(",") if x])
                        decoded.append(data)
                cols = [b.column(0), pa.array(n, pa.int64()), pa.array(ids_hash, pa.string()), pa.array(text_hash, pa.string())]
                if with_ids:
                    cols += [pa.array(ids, pa.list_(pa.int32())), pa.array(decoded, pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded"][: len(cols)])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)
