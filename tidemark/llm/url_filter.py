"""URL rules by hashed host-suffix and path-prefix expressions.

Each URL is expanded into the pairs of a host suffix and a path prefix that a rule could
have (no more labels and no other prefix lengths than the rules use), and each rule and
expression is named by its SHA-256 digest.  The equi-join is on the digest's first four
bytes; full digests then confirm, and the longest rule wins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import saved

#: Rules up to which they are broadcast (at most a few MB); beyond, both sides are shuffled.
BROADCAST_RULES = 20_000
#: URLs with a rule up to which they are broadcast (some 200 bytes each); beyond, they are joined.
BROADCAST_URLS = 50_000
DEFAULT_VERDICT = "allow"
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty without ``://``."""
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring(__url, locate('://', __url) + 3)")).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return host, path


def rule_table(spark: SparkSession, rules) -> DataFrame:
    """``(rule, verdict)`` rows as ``(rule, verdict, labels, reach, digest, short)``."""
    rows = spark.createDataFrame(list(rules), "rule string, verdict string") if not isinstance(rules, DataFrame) else rules.select("rule", "verdict")
    rows = rows.where("rule is not null and verdict is not null").dropDuplicates(["rule", "verdict"])
    host = F.regexp_extract("rule", r"(?s)^([^/]*)", 1)
    digest = F.sha2(F.col("rule").cast("binary"), 256)
    return rows.select("rule", "verdict", F.size(F.split(host, r"\.")).alias("labels"), (F.char_length("rule") - F.char_length(host)).alias("reach"), digest.alias("digest"), F.substring(digest, 1, 8).alias("short"))


def judged_urls(pages: DataFrame, rules=RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """``(page_id, host, path, rule, verdict)``, one row per row of ``pages``.

    A rule is ``host/path``: it fits its host and all subdomains where the URL's path
    starts with its own.  The longest rule wins, then block.  No rule: null and
    ``DEFAULT_VERDICT``.  Null URLs and such without ``://`` have empty parts and no rule;
    null ids are kept; equal rows give equal results; other columns are ignored; no rows
    give none.
    """
    spark = pages.sparkSession
    table = rule_table(spark, rules)
    shapes = table.agg(F.collect_set("labels").alias("labels"), F.collect_set("reach").alias("reach"), F.count("*").alias("n")).first()
    host, path = url_parts(F.col("__url"))
    parts = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("__url")).select("page_id", host.alias("host"), path.alias("path"))
    # Each distinct (host, path) is judged once, however many pages have it.
    urls = parts.where("host <> ''").select("host", "path").distinct()
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.filter(F.array(*map(F.lit, sorted(shapes["labels"]) or [0])), lambda k: (k > 0) & (k <= F.size(labels))), lambda k: F.array_join(F.slice(labels, -k, k), "."))
    prefixes = F.transform(F.filter(F.array(*map(F.lit, sorted(shapes["reach"]) or [-1])), lambda k: (k >= 0) & (k <= F.char_length("path"))), lambda k: F.substring(F.col("path"), F.lit(1), k))
    expressions = urls.withColumn("__s", F.explode(suffixes)).withColumn("__p", F.explode(prefixes))
    expressions = expressions.select("host", "path", F.sha2(F.concat("__s", "__p").cast("binary"), 256).alias("__full"))
    expressions = expressions.withColumn("short", F.substring("__full", 1, 8))
    small = F.broadcast(table) if shapes["n"] <= BROADCAST_RULES else table
    hits = expressions.join(small, "short").where("__full = digest")
    rank = F.struct(F.char_length("rule"), F.col("labels"), (F.col("verdict") == "block").cast("int"), F.col("rule"))
    best = hits.groupBy("host", "path").agg(F.max_by(F.struct("rule", "verdict"), rank).alias("__best"))
    # As a table of its own, so that rows of a hot URL, or of none, are split where the join shuffles.
    best = saved(best.select("host", "path", "__best.rule", "__best.verdict"), "judged")
    if best.count() <= BROADCAST_URLS:
        best = F.broadcast(best)
    out = parts.join(best, ["host", "path"], "left")
    return out.select("page_id", "host", "path", "rule", F.coalesce("verdict", F.lit(DEFAULT_VERDICT)).alias("verdict"))
