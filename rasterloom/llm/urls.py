"""URL filter: rules by host and path first, then gradient-boosted trees on lexical features, trained on the URLs that rules label.

Features are column expressions: lengths, depth, share of digits, entropy of characters, numbers of parameters, host labels and hyphens, and statistics of suffixes: for the last one, two and three labels of
the host, and for the first directory, how many labelled URLs have it and the share of blocked ones among them, drawn towards the share overall.

How it scales: the trees and the statistics are learned from about ``per_verdict`` distinct URLs of each verdict, taken by a hash of the URL. Every URL is judged by reading its row once: statistics have at most four rows for a sampled URL, under 8-byte keys, so
they are broadcast (about 2 MB at the default), and no row of pages is shuffled.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from .storage import Packed, Workspace

#: (verdict, host and path): the longest that fits decides.
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
LEXICAL = ("url_length", "host_length", "path_length", "depth", "digit_ratio", "entropy", "parameters", "host_labels", "hyphens", "secure", "fragment")
#: Kinds of suffixes: host labels from the right, or the first directory.
SUFFIXES = (1, 2, 3, "directory")
FOLDS, PRIOR_WEIGHT = 5, 20.0


def host_and_path(url: Column) -> tuple[Column, Column]:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased, and what follows that up to ``?``, ``#`` or the end; both empty for null, or without ``://``."""
    found = lambda k: F.coalesce(F.regexp_extract(url, r"://([^/?#]*)([^?#]*)", k), F.lit(""))
    return F.translate(found(1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), found(2)


def fits(host: Column, path: Column, rule: str) -> Column:
    """A rule fits its host and all subdomains, if the path starts with the rule's; a rule that starts with / fits every host."""
    cut = rule.find("/") if "/" in rule else len(rule)
    site, start = rule[:cut], rule[cut:]
    of_site = (host == site) | host.endswith("." + site) if site else F.lit(True)
    return of_site & path.startswith(start)


def decide(host: Column, path: Column, rules: tuple[tuple[str, str], ...] = RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else null; equally long ones: the longer host, then the smaller text, then allow."""
    text = verdict = F.lit(None).cast("string")
    for kind, rule in sorted(rules, key=lambda r: (len(r[1]), len(r[1].split("/")[0]), [-ord(c) for c in r[1]], r[0] == "allow")):
        if kind not in ("allow", "block"):
            raise ValueError(f"{kind}: a verdict is allow or block")
        hit = fits(host, path, rule)
        text, verdict = F.when(hit, rule).otherwise(text), F.when(hit, kind).otherwise(verdict)
    return text, verdict


def entropy(text: Column) -> Column:
    """Bits a character, from the lengths of runs of the sorted characters; 0 for an empty text."""
    start = F.struct(F.lit("").alias("c"), F.lit(0.0).alias("n"), F.lit(0.0).alias("s"))
    spent = lambda n: F.when(n > 1, n * F.log2(n)).otherwise(0.0)

    def add(acc: Column, c: Column) -> Column:
        same = acc["c"] == c
        return F.struct(c.alias("c"), F.when(same, acc["n"] + 1).otherwise(1.0).alias("n"), F.when(same, acc["s"]).otherwise(acc["s"] + spent(acc["n"])).alias("s"))

    n = F.length(text).cast("double")
    total = F.aggregate(F.array_sort(F.split(text, "")), start, add, lambda acc: acc["s"] + spent(acc["n"]))
    return F.when(n > 0, F.log2(n) - total / n).otherwise(0.0)


def features(urls: DataFrame) -> DataFrame:
    """urls (url, host, path) with the LEXICAL features and the suffixes' keys s0, s1, ... (null where a URL has no such suffix)."""
    url, host, path = F.coalesce("url", F.lit("")), F.col("host"), F.col("path")
    count = lambda text, c: F.length(text) - F.length(F.translate(text, c, ""))
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    labels = F.size(F.split(host, r"\."))
    made = {
        "url_length": F.length(url), "host_length": F.length(host), "path_length": F.length(path), "depth": count(path, "/"), "digit_ratio": count(url, "0123456789") / F.greatest(F.length(url), F.lit(1)), "entropy": entropy(url),
        "parameters": F.when(query != "", 1 + count(query, "&;")).otherwise(0), "host_labels": labels, "hyphens": count(host, "-"), "secure": url.startswith("https").cast("int"), "fragment": url.contains("#").cast("int"),
    }
    keys = {}
    for k, kind in enumerate(SUFFIXES):
        text = F.regexp_extract(path, "^/([^/]*)", 1) if kind == "directory" else F.when(labels >= kind, F.substring_index(host, ".", -kind))
        keys[f"s{k}"] = F.xxhash64(F.lit(k), text)
        if kind != "directory":
            keys[f"s{k}"] = F.when(labels >= kind, keys[f"s{k}"])
    return urls.withColumns({c: x.cast("double") for c, x in made.items()} | keys)


@dataclass
class UrlModel:
    """Trees and the statistics that they read; only: the verdict of all URLs where the labelled ones had one (or none: allow)."""

    trees: GBTClassificationModel | None
    statistics: DataFrame | None
    share: float
    only: str = "allow"

    def blocked(self, urls: DataFrame) -> DataFrame:
        """urls (url, host, path and more) with ``score``, the trees' probability of block."""
        if self.trees is None:
            return urls.withColumn("score", F.lit(float(self.only == "block")))
        names = urls.columns
        ready = features(urls)
        for k in range(len(SUFFIXES)):
            own = self.statistics.where(F.col("kind") == k).select(F.col("suffix").alias(f"s{k}"), "n", "n_blocked")
            ready = with_statistics(ready.join(F.broadcast(own), f"s{k}", "left"), k, F.coalesce("n", F.lit(0)), F.coalesce("n_blocked", F.lit(0)), self.share).drop("n", "n_blocked")
        scored = self.trees.transform(assembler().transform(ready))
        return scored.select(*names, vector_to_array("probability")[1].alias("score"))


def with_statistics(df: DataFrame, k: int, n: Column, blocked: Column, share: float) -> DataFrame:
    return df.withColumns({f"seen{k}": F.log1p(n.cast("double")), f"rate{k}": (blocked + PRIOR_WEIGHT * share) / (n + PRIOR_WEIGHT)})


def assembler() -> VectorAssembler:
    names = [*LEXICAL, *[f"{c}{k}" for k in range(len(SUFFIXES)) for c in ("seen", "rate")]]
    return VectorAssembler(inputCols=names, outputCol="features")


def learn(labelled: DataFrame, per_verdict: int = 10_000, trees: int = 20, depth: int = 4, ws: Workspace | None = None) -> UrlModel:
    """A model from labelled (url, host, path, verdict), verdict allow or block. It reads about ``per_verdict`` distinct URLs of each verdict (all where there are fewer), those with the smallest hashes of the URL; copies of a URL count once.

    Suffix statistics of a training URL come from the other folds of FOLDS, so that the trees can't read a URL's own label in them.
    """
    ws = ws or Workspace(labelled.sparkSession, "urls")
    place = F.pmod(F.xxhash64("url"), F.lit(1 << 40))
    sizes = {r["verdict"]: r["n"] for r in labelled.groupBy("verdict").agg(F.approx_count_distinct("url", 0.02).alias("n")).collect()}
    taken = F.lit(False)
    for verdict, n in sizes.items():
        taken = taken | ((F.col("verdict") == verdict) & (place < int((1 << 40) * min(1.0, per_verdict / max(n, 1)))))
    sample = labelled.where(taken).groupBy("url").agg(*[F.min(c).alias(c) for c in ("host", "path", "verdict")])
    sample = sample.withColumns({"label": (F.col("verdict") == "block").cast("double"), "fold": F.pmod(F.xxhash64(F.lit("fold"), "url"), F.lit(FOLDS))})
    sample = ws.save(features(sample), "sample")
    counts = sample.agg(F.count("*").alias("n"), F.sum("label").alias("blocked")).first()
    if not counts["n"] or counts["blocked"] in (0, counts["n"]):
        return UrlModel(None, None, 0.0, "block" if counts["blocked"] else "allow")
    share = counts["blocked"] / counts["n"]
    kinds = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(f"s{k}").alias("suffix")) for k in range(len(SUFFIXES))])).alias("s")
    by_fold = ws.save(sample.select("fold", "label", kinds).where("s.suffix IS NOT NULL").groupBy("s.kind", "s.suffix", "fold").agg(F.count("*").alias("n"), F.sum("label").alias("n_blocked")), "folds")
    statistics = ws.save(by_fold.groupBy("kind", "suffix").agg(F.sum("n").alias("n"), F.sum("n_blocked").alias("n_blocked")), "statistics")
    ready = sample
    for k in range(len(SUFFIXES)):
        every, own = (df.where(F.col("kind") == k).withColumnsRenamed({"suffix": f"s{k}"}).drop("kind") for df in (statistics, by_fold))
        own = own.withColumnsRenamed({"n": "n_own", "n_blocked": "blocked_own"})
        ready = ready.join(F.broadcast(every), f"s{k}", "left").join(F.broadcast(own), [f"s{k}", "fold"], "left")
        rest = lambda a, b: F.coalesce(F.col(a), F.lit(0)) - F.coalesce(F.col(b), F.lit(0))
        ready = with_statistics(ready, k, rest("n", "n_own"), rest("n_blocked", "blocked_own"), share).drop("n", "n_blocked", "n_own", "blocked_own")
    # The order of rows decides between equally good splits.
    ready = ws.save(assembler().transform(ready).select("features", "label", "url").coalesce(4).sortWithinPartitions("url"), "training")
    fitted = GBTClassifier(maxIter=trees, maxDepth=depth, stepSize=0.2, maxBins=32, seed=7, maxMemoryInMB=64).fit(ready.coalesce(4))
    return UrlModel(fitted, statistics, share)


def judge(pages: DataFrame, rules: tuple[tuple[str, str], ...] = RULES, per_verdict: int = 10_000, threshold: float = 0.5) -> DataFrame:
    """pages (any columns, among them url) with host, path, rule (of the longest rule that fits, else null), score (the model's probability of block) and verdict: the rule's, else block where score reaches ``threshold``.

    The URLs that a rule fits train the model (see learn). Null and empty URLs have an empty host and path and are judged like any other; repeated rows get equal verdicts, and long URLs are judged whole. Where no URL is labelled, all others are allowed; where all labels
    agree, the others get that verdict. No rows give no rows. Other columns may have any names; those named host, path, rule, score or verdict are replaced.
    """
    ws = Workspace(pages.sparkSession, "urls")
    pages = pages.drop("host", "path", "rule", "score", "verdict")
    packed = Packed(pages, "url")
    host, path = host_and_path(F.col("url"))
    read = pages.select(F.col("url").cast("string").alias("url"), packed.rest()).withColumns({"host": host, "path": path})
    rule, verdict = decide(F.col("host"), F.col("path"), rules)
    read = read.withColumns({"rule": rule, "verdict": verdict})
    model = learn(read.where("verdict IS NOT NULL").select("url", "host", "path", "verdict"), per_verdict, ws=ws)
    judged = model.blocked(read)
    final = F.coalesce("verdict", F.when(F.col("score") >= threshold, "block").otherwise("allow"))
    return judged.select(*packed.columns(), "host", "path", "rule", "score", final.alias("verdict"))
