"""Token counts by a separator scan over flat token files.

A token file is a run of little-endian 16- or 32-bit ids; each document ends in the end-of-document id, and nothing else
says where documents begin. Tasks read blocks of the files and find the separators with one vectorised comparison. What a
block cannot know (how many documents ended before it, where the last separator before it stands) comes from a
prefix scan over one small row per block: a running sum and a running maximum per file. Files have a bounded size, so the
scan's groups do too.

Files are written and read by ranges through the shared folder. A task names its files after itself and its attempt; only the files listed
by tasks that ended well are read.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .storage import Workspace, open_fs
from .tokenizers_public import default_path, encode_to_array, encoding, vocabulary_ids

#: Bytes of a token file at most, but for one document that is longer.
FILE_BYTES = 32 << 20
#: Ids of a block.
BLOCK = 1 << 20


def write_token_files(docs: DataFrame, ws: Workspace, path: str, eod: int, width: int = 2, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Writes docs' (doc_id, text) token files; returns the listing (file, ordinal, doc_id, file_ids), in each file's order.
    The listing names documents; it holds no offsets or lengths. file_ids: ids in the file, on its first row only."""
    folder = f"{ws.path}/tokens"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = open_fs(folder)
        fs.create_dir(root, recursive=True)
        enc, end = encoding(path), np.array([eod], f"<u{width}").tobytes()
        out, name, ids, held = None, "", [], 0

        def listing() -> pa.RecordBatch:
            sizes = [held // width] + [None] * (len(ids) - 1)
            return pa.RecordBatch.from_arrays([pa.array([name] * len(ids)), pa.array(range(len(ids)), pa.int64()), pa.array(ids, pa.int64()), pa.array(sizes, pa.int64())], ["file", "ordinal", "doc_id", "file_ids"])

        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1)):
                if out is None:
                    name, ids, held = f"{uuid.uuid4().hex}.bin", [], 0
                    out = fs.open_output_stream(f"{root}/{name}")
                data = encode_to_array(enc, text.as_py()).astype(f"<u{width}").tobytes() + end
                out.write(data)
                ids.append(doc_id)
                held += len(data)
                if held >= file_bytes:
                    out.close()
                    yield listing()
                    out = None
        if out is not None:
            out.close()
            yield listing()

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return ws.save(slim.mapInArrow(run, "file string, ordinal long, doc_id long, file_ids long"), "listing")


def separator_scan(files: DataFrame, folder: str, eod: int, width: int = 2, block: int = BLOCK) -> DataFrame:
    """(file, ordinal, token_start, n_tokens) of each document of the files (columns file, file_ids: its number of ids). token_start counts
    the file's ids before the document; n_tokens leaves the separator out. Ids after a file's last separator belong to no document."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, root = open_fs(folder)
        for pdf in batches:
            for name, n, size in zip(pdf["file"], pdf["block"], pdf["file_ids"]):
                with fs.open_input_file(f"{root}/{name}") as f:
                    ids = np.frombuffer(f.read_at(width * min(block, size - n * block), n * block * width), f"<u{width}")
                at = np.flatnonzero(ids == eod) + n * block
                yield pd.DataFrame({"file": [name], "block": [n], "ends": [at], "n": [len(at)], "last": [at[-1] if len(at) else -1]})

    blocks = files.select("file", "file_ids", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("file_ids") - 1) / block))).alias("block"))
    found = blocks.where("file_ids > 0").mapInPandas(scan, "file string, block long, ends array<long>, n long, last long")
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    found = found.withColumns({"ordinal": F.coalesce(F.sum("n").over(before), F.lit(0)), "start": F.coalesce(F.max("last").over(before), F.lit(-1)) + 1})
    starts = F.concat(F.array("start"), F.transform("ends", lambda e: e + 1))
    each = found.where("n > 0").select("file", "ordinal", F.posexplode(F.arrays_zip("ends", starts.alias("starts"))).alias("k", "e")).where("e.ends is not null")
    return each.select("file", (F.col("ordinal") + F.col("k")).alias("ordinal"), F.col("e.starts").alias("token_start"), (F.col("e.ends") - F.col("e.starts")).alias("n_tokens"))


def token_counts(docs: DataFrame, path: str | None = None, eod: int = 50256, width: int = 2, file_bytes: int = FILE_BYTES, block: int = BLOCK) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, n_tokens, and where its ids stand (file, ordinal, token_start).

    Null and empty texts have 0 tokens; long ones may span many blocks of a file. Repeated rows each give a row; null doc_ids stay null; other columns are not looked at.
    ``eod`` must be no id of the vocabulary, and it and all ids must fit the width (bytes of an id, 2 or 4); else this is an error before any file is written.
    """
    path = path or default_path("byte_bpe_50k.tiktoken")
    known = encoding(path)
    most = max(known.max_token_value, eod)
    if width not in (2, 4) or most >= 1 << 8 * width:
        raise ValueError(f"ids up to {most} don't fit {width} bytes")
    if eod < 0 or eod in vocabulary_ids(path):
        raise ValueError(f"{eod} is an id of the vocabulary")
    ws = Workspace(docs.sparkSession, "tokens")
    listing = write_token_files(docs, ws, path, eod, width, file_bytes)
    files = listing.where("ordinal = 0").select("file", "file_ids")
    files = files.repartition(max(1, docs.sparkSession.sparkContext.defaultParallelism))
    # Spark would take the rows of the scan for as few as its blocks are, and broadcast them.
    found = separator_scan(files, f"{ws.path}/tokens", eod, width, block)
    return listing.select("file", "ordinal", "doc_id").join(found.hint("merge"), ["file", "ordinal"]).select("doc_id", "n_tokens", "file", "ordinal", "token_start")
