"""Line dedup by content-defined chunks of lines, in DataFrame functions only.

A line's hash is the first 32 bits of its MD5. A rolling hash over the hashes of the last two lines proposes a boundary where it is divisible by
``every``; a line that equals the one before it proposes one as well. Of proposals at neighbouring lines every other one counts, from the first on, so a chunk has two lines
at least and, with ``every`` = 2, three on average. A boundary depends on the two lines before it and on the run of proposals that it stands in, so an insertion shifts
no boundary but its own. Chunks with two lines or more that aren't blank are grouped over all documents by their bytes, and of equal ones all but
the first (by doc_id, nulls first, then place in the document) are removed.

Chunks move as text once, in a count that is pre-aggregated where they are read, so a chunk in very many documents moves once a task. From there on a 64-bit
hash stands for a chunk, where the count has shown that only one text has it; chunks whose hash several texts share are joined as text. Rows with places are
joined without a grouping above, so a skewed side can be split.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .storage import Packed, Workspace

#: Multipliers of the rolling hash over (line, line before), and the prime by which it is reduced.
ROLL = (7919, 104729, 1000003)


def _chunks(text: Column, every: int) -> dict[str, Column]:
    """Columns to add one after the other; the last, chunks, has the chunks: array<struct<text, lines, solid>>."""
    here, before, prime = ROLL
    lines = F.split(text, "\n", -1)
    hashes = F.transform("lines", lambda x: F.conv(F.substring(F.md5(x), 1, 8), 16, 10).cast("long"))
    last = lambda i: F.when(i > 1, F.get("hashes", i - 2)).otherwise(F.lit(0))
    rolled = lambda i: (F.get("hashes", i - 1) * here + last(i) * before) % prime
    again = lambda i: (i > 1) & (F.get("lines", i - 1) == F.get("lines", i - 2))
    proposed = F.transform(F.sequence(F.lit(1), F.size("lines")), lambda i: F.when((rolled(i) % every == 0) | again(i), F.lit("1")).otherwise(F.lit("0")))
    marks = F.split(F.regexp_replace(F.array_join(proposed, ""), "11", "10"), "")
    # The marks are bound by a transform of one element: a column that a lambda names once would be made anew for each line.
    closing = lambda m: F.filter(F.sequence(F.lit(1), F.size(m)), lambda i: (i == F.size(m)) | (F.get(m, i - 1) == "1"))
    ends = F.get(F.transform(F.array(marks), closing), F.lit(0))
    starts = F.concat(F.array(F.lit(1)), F.transform(F.slice("ends", 1, F.size("ends") - 1), lambda e: e + 1))
    part = lambda s, e: F.slice("lines", s, e - s + 1)
    solid = lambda s, e: F.size(F.filter(part(s, e), lambda x: F.trim(x) != "")) > 1
    chunk = lambda s, e: F.struct(F.array_join(part(s, e), "\n").alias("text"), (e - s + 1).alias("lines"), solid(s, e).alias("solid"))
    return {"lines": lines, "hashes": hashes, "ends": ends, "starts": starts, "chunks": F.zip_with("starts", "ends", chunk)}


def _with_chunks(docs: DataFrame, text: Column, every: int) -> DataFrame:
    for name, col in _chunks(text, every).items():
        docs = docs.withColumn(name, col)
    return docs.drop("lines", "hashes", "ends", "starts")


def repeated_chunks(docs: DataFrame, every: int = 2, bits: int = 64) -> DataFrame:
    """(doc_id, digest, removed array<int>, n_removed): places of the chunks to remove, for documents that have any. digest: xxhash64 of the text, which
    tells apart documents that share a doc_id. bits: of the hash, fewer of which only cost time."""
    slim = docs.select("doc_id", F.col("text").cast("string").alias("text")).where("text is not null")
    # The outer form: for the inner one, Spark infers a filter on the array's size and inlines all of its expression into it.
    each = _with_chunks(slim, F.col("text"), every)
    each = each.select("doc_id", F.xxhash64("text").alias("digest"), F.posexplode_outer("chunks").alias("place", "c")).where("c.solid")
    each = each.select("doc_id", "digest", "place", F.col("c.text").alias("chunk"), F.col("c.lines").alias("lines"), F.shiftrightunsigned(F.xxhash64("c.text"), 64 - bits).alias("h"))
    ws = Workspace(docs.sparkSession, "lines")
    texts = each.groupBy("h", "chunk").agg(F.count("*").alias("n"))
    often = ws.save(texts.groupBy("h").agg(F.count("*").alias("texts"), F.max("n").alias("n")).where("n > 1"), "often")
    where = F.struct("doc_id", "digest", "place")

    def later(rows: DataFrame, keys: list[str], wanted: DataFrame) -> DataFrame:
        """Rows but the first of their keys. Firsts are pre-aggregated where rows are read, and stored: so the join that brings them to the rows has
        plain shuffles on both sides, which Spark splits where they are skewed."""
        first = ws.save(rows.groupBy(*keys).agg(F.min(where).alias("first")).join(wanted, "h", "left_semi"), f"first{len(keys)}")
        return rows.join(first, keys).where(~where.eqNullSafe(F.col("first"))).select("doc_id", "digest", "place", "lines")

    gone = later(each.drop("chunk"), ["h"], often.where("texts = 1").select("h"))
    shared = often.where("texts > 1").select("h")
    if not shared.isEmpty():
        gone = gone.unionByName(later(each.join(shared, "h", "left_semi"), ["h", "chunk"], shared))
    gone = gone.groupBy("doc_id", "digest").agg(F.collect_set(F.struct("place", "lines")).alias("gone"))
    return gone.select("doc_id", "digest", F.col("gone.place").alias("removed"), F.aggregate("gone", F.lit(0).cast("long"), lambda a, x: a + x["lines"]).alias("n_removed"))


def remove_repeated_lines(docs: DataFrame, every: int = 2, count: bool = False, bits: int = 64) -> DataFrame:
    """docs (any columns, among them doc_id and text) with the repeated chunks' lines taken out of text; n_chars, if it is there, follows.
    count: also n_lines and n_removed (columns of docs with these names are replaced then).

    Null texts stay null (no lines), empty ones have one empty line; long ones are cut into chunks in one row like any other. Rows that repeat doc_id and text are one document: they lose the same chunks, and not
    to each other. No rows give no rows. A document all of whose chunks are removed keeps its row, with an empty text. Other columns may have any names.
    """
    if count:
        docs = docs.drop("n_lines", "n_removed")
    packed = Packed(docs, *[c for c in ("doc_id", "text", "n_chars") if c in docs.columns])
    gone = repeated_chunks(docs, every, bits).withColumnsRenamed({"doc_id": "of", "digest": "of_digest"})
    rows = docs.select(*packed.own, packed.rest()).withColumn("text", F.col("text").cast("string"))
    rows = rows.join(gone, F.col("doc_id").eqNullSafe(F.col("of")) & (F.xxhash64("text") == F.col("of_digest")), "left")
    cut = F.col("removed").isNotNull()
    rows = _with_chunks(rows, F.when(cut, F.col("text")), every)  # null, and cheap, for documents that lose nothing
    rows = rows.withColumn("kept", F.array_except(F.sequence(F.lit(0), F.size("chunks") - 1, F.lit(1)), "removed"))
    rows = rows.withColumn("left", F.array_join(F.transform("kept", lambda i: F.get("chunks", i)["text"]), "\n"))
    now = {"text": F.when(cut, F.col("left")).otherwise(F.col("text"))}
    if "n_chars" in docs.columns:
        now["n_chars"] = F.when(cut, F.length("left").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    extra = []
    if count:
        n_lines = F.when(F.col("text").isNull(), 0).otherwise(F.size(F.split("text", "\n", -1))).cast("long")
        extra = [n_lines.alias("n_lines"), F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed")]
    return rows.select(*packed.columns(**now), *extra)
