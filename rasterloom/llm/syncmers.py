"""Document fingerprints from closed syncmers, in DataFrame functions only.

A text is a sequence of bytes (UTF-8), so texts without white space are no special case. Of its windows of ``k`` bytes, those are chosen whose least inner window of ``s`` bytes (by hash) lies
at an edge: a choice that looks at nothing outside the window, so an edit changes only the windows that touch it, and one window at least is chosen of any ``k - s`` that follow
one another. The chosen windows are anchors: a place (in bytes) and a 32-bit hash. The fingerprint is all of them in the order of the text, ten hexadecimal digits each: the
distance to the anchor before (two digits; it is ``k - s`` at most) and the hash.

Fingerprints are matched by position: an anchor with the distance to the next one and that one's hash is a step, and the likeness of two fingerprints is the Jaccard likeness of
their sets of steps. So order and distances count, and a passage matches wherever it stands.

The successor of each document in doc_id order comes from a window over ranges of documents; each document moves once. Ranges are cut by exact sums of bytes over the sorted documents, and every
range gets a copy of the next one's first document as its last row.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from .storage import Workspace

K, S = 24, 7
#: Bytes of text of a range, about, and the most ranges that there are (then they are larger).
RANGE_BYTES, RANGES = 4 << 20, 64**3
#: Bytes of a text whose windows are looked at together.
PIECE = 1 << 16
_LOW = 0xFFFFFFFF


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with value evaluated once."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _least_of_four(m: Column, then: Callable[[Column], Column]) -> Column:
    """then(the least of each value and the three after it)."""
    ahead = lambda x, n: F.zip_with(x, F.slice(x, n + 1, F.size(x) - n), lambda p, q: F.least(p, q))
    return _let(ahead(m, 1), lambda two: _let(ahead(two, 2), then))


def _chosen(text: Column, n: Column, k: int, s: int) -> Column:
    """The places (from 0) of the closed syncmers of n bytes, n >= k."""
    last = k - s  # of a window's inner windows, from 0
    inner = F.transform(F.sequence(F.lit(1), n - s + 1), lambda i: F.xxhash64(F.substring(text, i, F.lit(s))))

    def pick(m: Column, four: Column) -> Column:
        def closed(i: Column) -> Column:
            edge = F.least(F.get(m, i), F.get(m, i + last))
            out = F.lit(True)
            for at in [*range(1, last - 4, 4), last - 4]:  # inner windows 1..last - 1, by fours
                out = out & (edge <= F.get(four, i + at))
            return out

        return F.filter(F.sequence(F.lit(0), n - k), closed)

    return _let(inner, lambda m: _least_of_four(m, lambda four: pick(m, four)))


def anchors(text: Column, k: int = K, s: int = S, whole: bool = True) -> Column:
    """array<long> of the anchors of a binary column: place << 32 | hash, ascending. Fewer than k bytes (and at least one) are one anchor, all bytes (whole; else they have none);
    an empty text has none. Needs k - s >= 5."""
    if k - s < 5:
        raise ValueError("k - s must be 5 or more")

    def of_piece(data: Column, at: Column) -> Column:
        piece = F.substring(data, at + 1, F.lit(PIECE + k - 1))
        value = lambda p, i: (at + i).cast("long") * (1 << 32) + F.xxhash64(F.substring(p, i + 1, F.lit(k))).bitwiseAND(F.lit(_LOW))
        return _let(piece, lambda p: F.transform(_chosen(p, F.octet_length(p), k, s), lambda i: value(p, i)))

    def of_text(data: Column) -> Column:
        n = F.octet_length(data)
        pieces = F.transform(F.sequence(F.lit(0), n - k, F.lit(PIECE)), lambda at: of_piece(data, at))
        out = F.when(n >= k, F.flatten(pieces))
        if whole:
            out = out.when(n > 0, F.array(F.xxhash64(data).bitwiseAND(F.lit(_LOW))))
        return out.otherwise(F.array().cast("array<bigint>"))

    return _let(text, of_text)


def _gaps(found: str) -> Column:
    """The anchors with the distance to the one before (the first: its place) for their place."""
    return F.transform(found, lambda x, i: x - F.when(i == 0, F.lit(0)).otherwise(F.shiftright(F.get(found, i - 1), 32) * (1 << 32)))


def fingerprint(gaps: str) -> Column:
    return F.lower(F.array_join(F.transform(gaps, lambda x: F.lpad(F.hex(x), 10, "0")), ""))


def steps(gaps: str) -> Column:
    """array<long>, distinct: a hash of each anchor's hash, the distance to the next and that one's hash; a single anchor is its own step."""
    at = F.col(gaps)
    pairs = F.zip_with(F.slice(at, 1, F.size(at) - 1), F.slice(at, 2, F.size(at) - 1), lambda x, y: F.xxhash64(x.bitwiseAND(F.lit(_LOW)), y))
    return F.array_distinct(F.when(F.size(at) > 1, pairs).otherwise(F.transform(at, lambda x: x.bitwiseAND(F.lit(_LOW)))))


def likeness(a: str, b: str) -> Column:
    """0 to 1; two texts without anchors are alike."""
    shared = F.size(F.array_intersect(a, b))
    both = F.size(a) + F.size(b) - shared
    return F.when(both == 0, F.lit(1.0)).otherwise(shared / both).cast("double")


def _sort_key(doc_id: Column, digest: Column) -> Column:
    """A string in the order of (doc_id, digest), nulls first."""
    digits = lambda x: F.lpad(F.hex(x.bitwiseXOR(F.lit(-(1 << 63)))), 16, "0")
    return F.concat(F.when(doc_id.isNull(), F.lit("0")).otherwise(F.lit("1")), digits(F.coalesce(doc_id, F.lit(0))), digits(digest))


def _cuts(rows: DataFrame, ws: Workspace, range_bytes: int, ranges: int) -> tuple[list[str], int]:
    """(the keys at which ranges begin, ascending; the most rows of one key): each range holds about range_bytes, or a share of all so that ranges are about ``ranges`` at most, and one key at least."""
    keys = rows.groupBy("key").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"))
    keys = ws.save(keys.repartitionByRange("key").withColumn("part", F.spark_partition_id()), "keys")
    total, most = keys.agg(F.sum("bytes"), F.max("n")).first()
    size = max(range_bytes, (total or 0) // ranges + 1)
    in_part = Window.partitionBy("part").orderBy("key")
    cell = F.floor((F.sum("bytes").over(in_part) - F.col("bytes")) / size)
    found = keys.withColumn("cell", cell).groupBy("part", "cell").agg(F.min("key").alias("key")).select("key").collect()  # one row a range
    ws.drop("keys")
    return sorted(r.key for r in found), most or 0


def _range_of(key: Column, cuts: list[str]) -> Column:
    """How many cuts are at most key, less one. Cuts are looked up in three steps of at most about the cube root of their number."""
    width = 1
    while width**3 < len(cuts):
        width += 1
    runs = [cuts[k: k + width] for k in range(0, len(cuts), width)]
    tops = [[r[0] for r in runs[k: k + width]] for k in range(0, len(runs), width)]
    count = lambda known, x: F.size(F.filter(known, lambda c: c <= x))
    texts = lambda rows: F.array(*[F.lit(r) for r in rows])
    found = lambda x: _let(count(F.lit([t[0] for t in tops]), x) - 1, lambda i: _let(i * width + count(F.get(texts(tops), i), x) - 1, lambda j: j * width + count(F.get(texts(runs), j), x) - 1))
    return _let(key, found)


def _edited(df: DataFrame, k: int, s: int) -> DataFrame:
    """From text, found, steps, next_text, next_steps: the edited text's columns and the likenesses. Of its anchors, those of windows that end before the edit are the text's own."""
    cut = F.floor(F.col("n_chars") / 4).cast("int")
    left, head = F.substring("text", F.lit(1), F.col("n_chars").cast("int") - cut), F.substring("next_text", F.lit(1), cut)
    df = df.withColumns({"left": left, "head": head})
    df = df.withColumns({"edited": F.concat("left", "head"), "kept": F.octet_length("left")}).withColumn("seam", F.greatest(F.col("kept") - (k - 1), F.lit(0)))
    own = F.filter("found", lambda x: F.shiftright(x, 32) + k <= F.col("kept"))
    new = anchors(F.encode(F.col("edited"), "UTF-8").substr(F.col("seam") + 1, F.octet_length("edited")), k, s, whole=False)
    both = F.concat(own, F.transform(new, lambda x: x + F.col("seam").cast("long") * (1 << 32)))
    whole = anchors(F.encode(F.col("edited"), "UTF-8"), k, s)
    df = df.withColumn("found", F.when(F.octet_length("edited") >= k, both).otherwise(whole))
    df = df.withColumn("gaps", _gaps("found")).withColumn("edited_steps", steps("gaps"))
    return df.withColumns({
        "edited_sha256": F.sha2(F.encode("edited", "UTF-8"), 256), "edited_fingerprint": fingerprint("gaps"),
        "near_edited": likeness("steps", "edited_steps"), "near_next": likeness("steps", "next_steps"),
    })


def fingerprint_and_edit(docs: DataFrame, k: int = K, s: int = S, range_bytes: int = RANGE_BYTES, ranges: int = RANGES) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text has the last floor(n_chars / 4) code points replaced by as many, or all, of the next document's first. Documents are ordered by doc_id, nulls first, then by a hash of the text,
    then by text; the first follows the last; a single document follows itself; of rows that repeat doc_id and text, all but one are followed by their like. Null texts count as empty; of long ones all anchors are in the fingerprint. Other columns are not looked at.
    No rows give no rows.
    """
    ws = Workspace(docs.sparkSession, "syncmers")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumns({"key": _sort_key(F.col("doc_id"), F.xxhash64("text"))})
    cuts, most = _cuts(rows.select("key", F.octet_length("text").cast("long").alias("bytes")), ws, range_bytes, ranges)
    rows = rows.groupBy("doc_id", "key", "text").agg(F.count("*").alias("copies")) if most > 1 else rows.withColumn("copies", F.lit(1).cast("long"))
    if not cuts:
        cuts = [""]
    rows = rows.withColumn("range", _range_of(F.col("key"), cuts))
    # The first document of each range, as a guest at the end of the range before: at most one row a range.
    begins = docs.sparkSession.createDataFrame([(c, (i - 1) % len(cuts)) for i, c in enumerate(cuts)], "begin string, before int")
    firsts = rows.join(F.broadcast(begins), F.col("key") == F.col("begin")).groupBy("before").agg(F.min("text").alias("text"))
    guests = ws.save(firsts.select(F.lit(None).cast("long").alias("doc_id"), "text", F.lit("~").alias("key"), F.lit(0).cast("long").alias("copies"), F.col("before").alias("range")), "guests")
    rows = rows.unionByName(guests).repartition("range")
    rows = rows.withColumns({"n_chars": F.length("text").cast("long"), "found": anchors(F.encode("text", "UTF-8"), k, s)})
    rows = rows.withColumn("gaps", _gaps("found")).withColumn("steps", steps("gaps"))
    ahead = F.lead(F.struct("text", "steps")).over(Window.partitionBy("range").orderBy("key", "text"))
    rows = rows.withColumn("ahead", ahead).where("copies > 0")
    # A row that stands for copies gives one that the next document follows, and the others.
    alone = F.array(F.struct(F.col("ahead.text").alias("text"), F.col("ahead.steps").alias("steps")))
    others = F.array_repeat(F.struct("text", "steps"), F.col("copies").cast("int") - 1)
    rows = rows.withColumn("next", F.explode(F.concat(alone, others))) if most > 1 else rows.withColumn("next", F.col("ahead"))
    rows = rows.select("doc_id", "n_chars", "text", "found", "steps", fingerprint("gaps").alias("fingerprint"), F.col("next.text").alias("next_text"), F.col("next.steps").alias("next_steps"))
    return _edited(rows, k, s).select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")
