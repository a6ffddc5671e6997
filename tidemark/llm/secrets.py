"""Secret scan of whole texts in DataFrame expressions, with ownership frequencies.

Patterns are matched in one pass each; where a match lies follows from the lengths of the
matches and of the text between them.  Each candidate's value is hashed, and hashes are
counted over the whole corpus by distinct repositories and owners: a value that many
owners or very many repositories have is an example that was copied, one that a single
owner has in few repositories and that looks random is reported as live.  Values
themselves are never stored, only their hashes.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import saved

#: (kind, pattern, group of the value, least length of the value), in the order of listing.
BASE = (
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", "AKIA[A-Z0-9]+", 0, 20),
    ("hex", "[0-9a-f]{24,}", 0, 24),
)
MORE = (
    ("github", "gh[pousr]_[A-Za-z0-9]{36,}", 0, 40),
    ("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}", 0, 32),
    ("pem", "-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 20),
)
#: Owners, or repositories, from which on a value counts as a copied example.
EXAMPLE_OWNERS, EXAMPLE_REPOSITORIES = 3, 10
#: Distinct characters from which on a value looks random.
LIVE_CHARACTERS = 8
#: Values up to which their counts (some 30 bytes each) are broadcast; beyond, only those
#: that make up more than one in ``HOT_SHARE`` uses, fewer than ``HOT_SHARE``, are, and the
#: others are joined.
BROADCAST_VALUES, HOT_SHARE = 250_000, 1000


def matches(text: Column, kind: str, place: int, pattern: str, group: int, least: int) -> Column:
    """All matches of one kind as ``array<struct<start, place, end, kind, hash, random>>``."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found
    between = F.split(text, pattern, -1)
    rows = F.arrays_zip(found.alias("found"), values.alias("value"), F.slice(between, 1, F.size(found)).alias("before"))
    empty = F.expr("cast(array() as array<struct<start:int,place:int,end:int,kind:string,hash:bigint,random:boolean>>)")

    def step(state, row):
        start = state["end"] + F.char_length(row["before"])
        end = start + F.char_length(row["found"])
        span = F.struct(start.cast("int").alias("start"), F.lit(place).cast("int").alias("place"), end.cast("int").alias("end"), F.lit(kind).alias("kind"), F.xxhash64(row["value"]).alias("hash"), (F.size(F.array_distinct(F.split(row["value"], ""))) >= LIVE_CHARACTERS).alias("random"))
        kept = F.when(F.char_length(row["value"]) >= least, F.concat(state["spans"], F.array(span))).otherwise(state["spans"])
        return F.struct(end.cast("int").alias("end"), kept.alias("spans"))

    spans = F.aggregate(rows, F.struct(F.lit(0).alias("end"), empty.alias("spans")), step, lambda s: s["spans"])
    return F.when(text.rlike(pattern), spans).otherwise(empty)


def listed(spans: Column) -> Column:
    """``kind:start:end`` of all spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def secret_spans(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` without its text, with ``__spans`` by start, then kind as listed."""
    text = F.coalesce(F.col("__text"), F.lit(""))
    found = F.concat(*[matches(text, kind, place, pattern, group, least) for place, (kind, pattern, group, least) in enumerate(BASE + MORE)])
    return docs.withColumnRenamed(text_col, "__text").withColumn("__spans", F.array_sort(found)).drop("__text")


def ownership(candidates: DataFrame) -> DataFrame:
    """``(hash, repositories, owners, uses)`` of ``(hash, repository, owner)`` rows.

    Rows are pre-aggregated per (hash, repository, owner), so a value that a third of all
    rows hold shrinks before it moves.
    """
    each = candidates.groupBy("hash", "repository", "owner").agg(F.count("*").alias("uses"))
    return each.groupBy("hash").agg(F.count_distinct("repository").alias("repositories"), F.count_distinct("owner").alias("owners"), F.sum("uses").alias("uses"))


def secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", repository_col: str = "source", owner_col: str = "source") -> DataFrame:
    """One row per row of ``docs``: id, ``spans`` and how widely its candidates are owned.

    ``(doc_id, spans array, examples, live, other)``: numbers of spans whose value
    ``EXAMPLE_OWNERS`` owners or ``EXAMPLE_REPOSITORIES`` repositories or more have, of those
    of one owner that look random, and of the rest.  Null texts are empty, null repositories
    and owners are values of their own; equal rows give equal results; other columns are
    ignored, whatever their names; no rows give none.
    """
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(repository_col).cast("string").alias("repository"), F.col(owner_col).cast("string").alias("owner"), F.col(text_col).alias("text"))
    found = saved(secret_spans(slim), "spans")
    values = F.array_distinct(F.transform("__spans", lambda s: s["hash"]))
    candidates = found.select(F.coalesce("repository", F.lit("")).alias("repository"), F.coalesce("owner", F.lit("")).alias("owner"), F.explode(values).alias("hash"))
    wide = saved(ownership(candidates), "owned")
    # Back to the rows: a document's values meet their counts, then one row each.
    rows = found.withColumn("row", F.xxhash64(F.to_json(F.struct("doc_id", "__spans"))))
    some = rows.where(F.size("__spans") > 0).dropDuplicates(["row"])
    uses = some.select("row", F.explode("__spans").alias("s")).select("row", "s.hash", "s.random")
    sums = wide.agg(F.count("*").alias("n"), F.sum("uses").alias("uses")).first()
    if sums["n"] <= BROADCAST_VALUES:
        uses = uses.join(F.broadcast(wide), "hash")
    else:
        hot = wide.where(F.col("uses") * HOT_SHARE > sums["uses"])
        cold = uses.join(F.broadcast(hot), "hash", "left_anti").join(wide, "hash")
        uses = uses.join(F.broadcast(hot), "hash").unionByName(cold)
    example = (F.col("owners") >= EXAMPLE_OWNERS) | (F.col("repositories") >= EXAMPLE_REPOSITORIES)
    live = ~example & (F.col("owners") == 1) & F.col("random")
    flags = [F.sum(c.cast("long")).alias(n) for n, c in (("examples", example), ("live", live), ("other", ~example & ~live))]
    judged = uses.groupBy("row").agg(*flags)
    out = rows.join(judged, "row", "left")
    return out.select("doc_id", F.col("__spans").alias("spans"), *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("examples", "live", "other")])


def digest_columns(found: DataFrame) -> DataFrame:
    """The counts and digests of base spans, and all spans as a string."""
    base = F.filter("spans", lambda s: s["place"] < len(BASE))
    count = reduce(lambda cols, k: [*cols, F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")], [k for k, *_ in BASE], [])
    return found.select("doc_id", *count, F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"), "examples", "live", "other")
