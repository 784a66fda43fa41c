"""The queries of this subpackage and the SQL that gives the same rows, where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import bpe, embeddings, langid, linededup, packing, periods, prefixtrie, simhash, substrings, syncmers, tokenfiles, urls, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.archive_round_trip(_table(spark, sf_dir, "pages"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeats(_table(spark, sf_dir, "documents"), digest=True)


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_lines, n_removed and the SHA-256 of the text that is left."""
    found = linededup.remove_repeated_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"), count=True)
    return found.select("doc_id", "n_lines", "n_removed", F.sha2(F.encode("text", "UTF-8"), 256).alias("kept_sha256"))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.best_fit_pack(_table(spark, sf_dir, "documents"))


def op5_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op6_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syncmers.fingerprint_and_edit(_table(spark, sf_dir, "documents"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id and its number of byte_bpe_50k ids, found in flat token files."""
    return tokenfiles.token_counts(_table(spark, sf_dir, "documents")).select("doc_id", "n_tokens")


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(_table(spark, sf_dir, "documents"))


def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(_table(spark, sf_dir, "documents"))


def op11_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = urls.judge(_table(spark, sf_dir, "pages").select("page_id", "url"))
    return judged.select("page_id", "host", "path", "rule", "verdict", "score")


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = prefixtrie.sequences(_table(spark, sf_dir, "conversations"))
    return prefixtrie.prefix_trie(prefixtrie.with_shared_heads(conversations))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periods.collapse_runs(periods.with_periodic_tails(_table(spark, sf_dir, "documents")), keep_spacing=False)
    # The longest run; of equally long ones that with the smallest start, then period.
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    lines = F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise("")
    digest = lambda x: F.sha2(F.encode(x, "UTF-8"), 256)
    length, period = F.col("best.length"), -F.col("best.period")
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.start")).alias("start"), length.alias("length"), period.alias("period"), F.floor(1000 * length / period).cast("long").alias("exponent_milli"),
        digest(lines).alias("runs_sha256"), digest(F.coalesce("text", F.lit(""))).alias("collapsed_sha256"),
    )


_ALL = (
    op1_warc_round_trip, op2_substring_dedup, op3_line_dedup, op4_best_fit_packing, op5_embedding_near_dedup, op6_document_fingerprints, op7_token_counts,
    op8_byte_bpe, op9_simhash_near_dedup, op10_language_id, op11_url_filter, op12_conversation_trie, op13_periodic_runs,
)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in _ALL}

ORACLE_SQL: dict[str, str] = {
    "op1_warc_round_trip": """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
k AS (SELECT page_id, strlen(html) AS payload_bytes, max(page_id) OVER (PARTITION BY h) AS chief,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(h, (i // 4) * 5 + 1, 5))::INTEGER >> CAST(15 - 5 * (i % 4) AS INTEGER)) & 31), 1)), '') AS payload_digest FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = chief THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> chief THEN chief END AS refers_to FROM k""",
    "op2_substring_dedup": """
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
i AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS k FROM d),
s AS (SELECT doc_id, k, w[k] AS word, CASE WHEN k + 34 <= len(w) THEN array_to_string(w[k:k + 34], ' ') END AS win FROM i),
r AS (SELECT doc_id, k, word, win IS NOT NULL AND count(*) OVER (PARTITION BY win) > 1 AS again FROM s),
c AS (SELECT doc_id, k, word, max(CAST(again AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) AS gone FROM r),
g AS (SELECT doc_id, CAST(sum(gone) AS BIGINT) AS n_removed, string_agg(word, ' ' ORDER BY k) FILTER (gone = 0) AS kept FROM c GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN g ON d.doc_id = g.doc_id""",
    "op3_line_dedup": """
WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL),
h AS (SELECT doc_id, ls, list_transform(ls, lambda x: ('0x' || substr(md5(x), 1, 8))::BIGINT) AS hs FROM l),
i AS (SELECT doc_id, ls, hs, unnest(range(1, len(ls) + 1)) AS k FROM h),
p AS (SELECT doc_id, k, ls[k] AS line, k = len(ls) AS final,
  CASE WHEN (hs[k] * 7919 + CASE WHEN k > 1 THEN hs[k - 1] ELSE 0 END * 104729) % 1000003 % 2 = 0 OR (k > 1 AND ls[k] = ls[k - 1]) THEN '1' ELSE '0' END AS proposed FROM i),
m AS (SELECT doc_id, regexp_replace(string_agg(proposed, '' ORDER BY k), '11', '10', 'g') AS marks FROM p GROUP BY 1),
e AS (SELECT p.doc_id, k, line, CASE WHEN final OR substr(marks, k, 1) = '1' THEN 1 ELSE 0 END AS closes FROM p JOIN m ON p.doc_id = m.doc_id),
c AS (SELECT *, sum(closes) OVER (PARTITION BY doc_id ORDER BY k) - closes AS place FROM e),
ch AS (SELECT doc_id, place, string_agg(line, chr(10) ORDER BY k) AS chunk, count(*) AS lines, count(*) FILTER (trim(line) <> '') > 1 AS solid FROM c GROUP BY 1, 2),
f AS (SELECT *, solid AND row_number() OVER (PARTITION BY chunk ORDER BY doc_id, place) > 1 AS gone FROM ch)
SELECT doc_id, CAST(sum(lines) AS BIGINT) AS n_lines, CAST(coalesce(sum(lines) FILTER (gone), 0) AS BIGINT) AS n_removed, sha256(coalesce(string_agg(chunk, chr(10) ORDER BY place) FILTER (NOT gone), '')) AS kept_sha256 FROM f GROUP BY 1
UNION ALL SELECT doc_id, 0, 0, NULL FROM documents WHERE text IS NULL""",
    "op5_embedding_near_dedup": """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a, v b WHERE a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.95),
reach(a, b) AS (SELECT vec_id, vec_id FROM v UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
n AS (SELECT a, count(*) AS n_links FROM links GROUP BY 1)
SELECT a AS vec_id, coalesce(max(n_links), 0) AS n_links, min(b) AS component_id, a = min(b) AS kept FROM reach LEFT JOIN n USING (a) GROUP BY 1""",
    "op12_conversation_trie": """
WITH t AS (SELECT conv_id, turn, sha256(CAST(strlen(coalesce(role, '')) AS VARCHAR) || ':' || coalesce(role, '') || coalesce(text, '')) || ':' || CAST(length(coalesce(text, '')) AS VARCHAR) AS e FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, list(e ORDER BY turn NULLS FIRST, e) AS s FROM t GROUP BY 1),
h AS (SELECT conv_id, s, xor(list_reduce([4294967295] || list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT)),
  lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda r, z: CASE WHEN r & 1 = 1 THEN xor(r >> 1, 3988292384) ELSE r >> 1 END)), 4294967295) % 6 AS h FROM c),
r AS (SELECT h.conv_id, coalesce(b.s[1:h.h], []) || h.s[h.h + 1:] AS s FROM h LEFT JOIN c b ON b.conv_id = h.conv_id - h.conv_id % 100),
p AS (SELECT conv_id, d, len(s) = d AS final, md5(array_to_string(s[1:d], ',')) || d AS node, CASE WHEN d > 0 THEN md5(array_to_string(s[1:d - 1], ',')) || (d - 1) END AS up, CASE WHEN d > 0 THEN CAST(split_part(s[d], ':', 2) AS BIGINT) ELSE 0 END AS size
  FROM (SELECT conv_id, s, unnest(range(0, len(s) + 1)) AS d FROM r)),
n AS (SELECT node, any_value(up) AS up, any_value(d) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(size) AS own, sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (final), '')) AS ends_sha256 FROM p GROUP BY 1),
k AS (SELECT up, count(*) AS n FROM n WHERE up IS NOT NULL GROUP BY 1),
f AS (SELECT n.*, coalesce(k.n, 0) AS n_children FROM n LEFT JOIN k ON n.node = k.up),
s AS (SELECT p.node, count(*) FILTER (f.n_children = 0) AS n_leaves, CAST(sum(f.own) AS BIGINT) AS saved_tokens FROM f JOIN p ON p.conv_id = f.conv_id AND p.d <= f.depth GROUP BY 1)
SELECT f.conv_id, f.depth, u.conv_id AS parent_conv_id, f.n_convs, f.n_children, s.n_leaves, s.saved_tokens, f.ends_sha256 FROM f JOIN s ON s.node = f.node LEFT JOIN n u ON u.node = f.up""",
}
