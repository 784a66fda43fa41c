"""Public vocabulary files read where a task needs them, once per Python worker; paths are parameters."""

from __future__ import annotations

import base64
import json
from functools import lru_cache


def default_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def split_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


@lru_cache(maxsize=4)
def tiktoken_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


def _byte_alphabet() -> dict[str, int]:
    """The printable stand-ins of byte-level BPE files: printable bytes stand for themselves, others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


@lru_cache(maxsize=4)
def json_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to id from a ``tokenizers`` byte-level BPE file whose ids follow its merge order, without added
    tokens. Then merging by least id is merging by first merge, and tiktoken gives the ids of ``tokenizers``."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, alphabet = spec["model"], _byte_alphabet()
    special = {t["content"] for t in spec.get("added_tokens", [])}
    vocab = {token: i for token, i in model["vocab"].items() if token not in special}
    made = [vocab["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
    if model["type"] != "BPE" or made != sorted(made) or len(made) + 256 != len(vocab):
        raise ValueError(f"{path}: ids don't follow the merges")
    return {bytes(alphabet[c] for c in token): i for token, i in vocab.items()}


@lru_cache(maxsize=4)
def vocabulary_ids(path: str) -> frozenset[int]:
    return frozenset((json_ranks(path) if path.endswith(".json") else tiktoken_ranks(path)).values())


@lru_cache(maxsize=4)
def encoding(path: str):
    """A tiktoken encoder for a .tiktoken or byte-level .json file, without special tokens."""
    import tiktoken

    ranks = json_ranks(path) if path.endswith(".json") else tiktoken_ranks(path)
    return tiktoken.Encoding("own", pat_str=split_pattern(), mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=4)
def added_tokens(path: str) -> dict[str, int]:
    """A .json file's added tokens and their ids; none for a .tiktoken file."""
    if not path.endswith(".json"):
        return {}
    with open(path, encoding="utf-8") as f:
        added = json.load(f).get("added_tokens", [])
    if any(t.get(k) for t in added for k in ("single_word", "lstrip", "rstrip", "normalized")):
        raise ValueError(f"{path}: added tokens that don't match as they stand")
    return {t["content"]: t["id"] for t in added}


@lru_cache(maxsize=4)
def encoding_with_added(path: str):
    """Like ``encoding``, with the file's added tokens: ``encode_with_added`` finds them in texts first, as ``tokenizers`` does."""
    import tiktoken

    ranks = json_ranks(path) if path.endswith(".json") else tiktoken_ranks(path)
    return tiktoken.Encoding("own", pat_str=split_pattern(), mergeable_ranks=ranks, special_tokens=added_tokens(path))


def encode_with_added(enc, text: str | None):
    """The whole text's ids as a numpy array, each added token as its own id; null: none."""
    return enc.encode_to_numpy(text or "", allowed_special="all", disallowed_special=())


def encode_to_array(enc, text: str | None):
    """The whole text's ids as a numpy array; null: none."""
    return enc.encode_to_numpy(text or "", disallowed_special=())
