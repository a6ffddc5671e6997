"""Mixing sources to target weights by iterative proportional fitting, in DataFrames only.

Texts are pre-aggregated to cells (source, language, topic) with their tokens.  Raking
scales the cells' weights to each marginal's targets in turn until all three hold; a
document's probability is its cell's weight over its cell's tokens, scaled so that the
largest is 1.  Documents are drawn by a hash of their id, so a rerun or a lost executor
changes nothing.

A cell's weight is its tokens times one factor for its source, its language and its topic,
so raking only moves factors: each step sums the cells by one key, with partial sums in
every task, and no key's cells ever meet in one.

Topics are given: a column (of any classifier), or patterns whose first match in the text
names its topic.
"""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, saved

#: Topics by the first pattern found in a text; else the rest.
TOPICS = (("legal", "[Ll]icen[cs]e|[Cc]opyright"), ("contact", "@|://"), ("numeric", "[0-9]{3}"))
REST = "prose"
#: Natural shares to this power, normalised, are the default targets.
TEMPER = 0.8
#: Raking goes on until no marginal is off by more than this share, or for so many sweeps
#: where targets contradict each other.
TOLERANCE, SWEEPS = 1e-4, 60
#: Rows up to which cells and factors (a few dozen bytes each) are broadcast; beyond, they are joined.
BROADCAST_CELLS = 100_000
NULL = "<null>"
KEYS = ("source", "lang", "topic")


def topic_of(text: Column, topics: tuple[tuple[str, str], ...] = TOPICS, rest: str = REST) -> Column:
    out = F.lit(rest)
    for name, pattern in reversed(topics):
        out = F.when(text.rlike(pattern), name).otherwise(out)
    return out


def token_count(text: Column) -> Column:
    """Runs of other characters than blanks and tab to carriage return."""
    return F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def _targets(cells: DataFrame, key: str, given: dict[str, float] | None, temper: float) -> DataFrame:
    """``(key, target)``: the given shares of values that occur, or tempered natural ones."""
    shares = cells.groupBy(key).agg(F.sum("t").alias("s"))
    if given is not None:
        spec = F.create_map(*[F.lit(x) for kv in given.items() for x in kv]) if given else None
        wish = F.coalesce(F.try_element_at(spec, F.col(key)), F.lit(0.0)) if given else F.lit(0.0)
    else:
        wish = F.pow(F.col("s"), F.lit(temper))
    shares = shares.withColumn("w", F.when(F.col("s") > 0, wish).otherwise(0.0))
    total = shares.agg(F.sum("w")).first()[0] or 0.0
    return shares.select(key, (F.col("w") / total if total else F.lit(0.0)).alias("target"))


def cell_weights(rows: DataFrame, targets: dict[str, dict[str, float]] | None = None, temper: float = TEMPER, tolerance: float = TOLERANCE, sweeps: int = SWEEPS) -> DataFrame:
    """``(*KEYS, t, w)``: tokens and raked weight (a share) of every cell of ``(*KEYS, tokens)``.

    ``targets`` may give shares for "source", "lang" or "topic"; values it leaves out get
    none.  Cells without tokens keep weight 0.  Where targets contradict each other raking
    ends after ``sweeps`` with a warning that names the largest error left.
    """
    cells = saved(rows.groupBy(*KEYS).agg(F.sum("tokens").cast("double").alias("t")), "cells")
    few = cells.count() <= BROADCAST_CELLS
    if few:  # one small file, as each sweep reads it several times
        cells = saved(cells.coalesce(1), "cells")
    wish = {key: saved(_targets(cells, key, (targets or {}).get(key), temper), "targets") for key in KEYS}
    factors = {key: wish[key].select(key, F.lit(1.0).alias(f"f_{key}")) for key in KEYS}

    def weighted(factors: dict[str, DataFrame]) -> DataFrame:
        out = cells
        for key, factor in factors.items():
            out = out.join(F.broadcast(factor) if few else factor, key)
        return out.withColumn("w", F.expr(" * ".join(["t", *(f"f_{key}" for key in factors)])))

    def sums(key: str, factors: dict[str, DataFrame]) -> DataFrame:
        return weighted(factors).groupBy(key).agg(F.sum("w").alias("s"))

    worst = None
    for _ in range(sweeps):
        for key in KEYS:
            others = {k: f for k, f in factors.items() if k != key}
            fitted = F.when(F.col("s") > 0, F.col("target") / F.col("s")).otherwise(0.0)
            factors[key] = saved(wish[key].join(sums(key, others), key).select(key, fitted.alias(f"f_{key}")), "factors")
        # The last key's marginal holds by construction; the others tell how far off it is.
        off = [wish[key].join(sums(key, factors), key).select(F.abs(F.col("s") - F.col("target")).alias("e")) for key in KEYS[:-1]]
        worst = off[0].union(off[1]).agg(F.max("e")).first()[0]
        if worst is None or worst < tolerance:
            break
    else:
        warnings.warn(f"raking ended with a marginal off by {worst:.3g}", stacklevel=2)
    return weighted(factors).select(*KEYS, "t", "w")


def uniform(key: Column, seed: int) -> Column:
    """A number in [0, 1) from the first 32 bits of an MD5 digest."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def drawn(rows: DataFrame, names: dict[str, str], source: Column, lang: Column, key: Column, targets: dict[str, dict[str, float]] | None, temper: float, sweeps: int, seed: int) -> DataFrame:
    """``rows`` (with topic and tokens) and ``names["probability"]``, ``names["kept"]``."""
    cell = {"source": source, "lang": lang, "topic": F.col(names["topic"])}
    cells = saved(cell_weights(rows.select(*(c.alias(k) for k, c in cell.items()), F.col(names["tokens"]).alias("tokens")), targets, temper, sweeps=sweeps), "weights")
    ratio = F.when(F.col("t") > 0, F.col("w") / F.col("t"))
    top = cells.agg(F.max(ratio)).first()[0]
    own = {k: fresh(f"__cell_{k}", rows.columns) for k in (*KEYS, "chance")}
    chances = cells.select(*(F.col(k).alias(own[k]) for k in KEYS), (ratio / top if top else ratio).alias(own["chance"]))
    if cells.count() <= BROADCAST_CELLS:
        chances = F.broadcast(chances)
    same = [c == F.col(own[k]) for k, c in cell.items()]
    joined = rows.join(chances, same[0] & same[1] & same[2], "left")
    chance = F.when(F.col(names["tokens"]) == 0, F.lit(1.0)).otherwise(F.coalesce(own["chance"], F.lit(0.0)))
    joined = joined.withColumn(names["probability"], chance).withColumn(names["kept"], uniform(key, seed) < F.col(names["probability"]))
    return joined.drop(*own.values())


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang", topic_col: str | None = None, topics: tuple[tuple[str, str], ...] = TOPICS, targets: dict[str, dict[str, float]] | None = None, temper: float = TEMPER, sweeps: int = SWEEPS, seed: int = 7, columns: list[str] | None = None) -> DataFrame:
    """All rows of ``docs``, its ``columns`` (null: all) and topic, tokens, probability and kept.

    The four are named ``__topic`` and so on, with underscores behind where ``docs`` has
    such a column.  ``topic_col`` may name given topics; else ``topics`` has patterns.  Null
    sources, languages and given topics are values of their own; a null or empty text has
    no tokens and probability 1, for it weighs nothing.  Rows with equal ids have equal
    draws, so of such rows in one cell all or none are kept; a null id is an id; no rows
    give none.
    """
    names = {k: fresh(f"__{k}", docs.columns) for k in ("topic", "tokens", "probability", "kept")}
    wanted = docs.columns if columns is None else list(dict.fromkeys([*columns, id_col, source_col, lang_col]))
    null, text = F.lit(NULL), F.coalesce(F.col(text_col), F.lit(""))
    topic = F.coalesce(F.col(topic_col).cast("string"), null) if topic_col else topic_of(text, topics)
    # Both read the whole text, so they are computed once, for the cells and for the draw.
    rows = saved(docs.select(*wanted, topic.alias(names["topic"]), token_count(text).alias(names["tokens"])), "labelled")
    return drawn(rows, names, F.coalesce(F.col(source_col).cast("string"), null), F.coalesce(F.col(lang_col).cast("string"), null), F.col(id_col), targets, temper, sweeps, seed)


def mixture(docs: DataFrame, **how) -> DataFrame:
    """The rows of ``docs`` that are drawn, with its columns.

    Options and edge cases are those of ``mixed``: null and empty texts always stay.
    """
    out = mixed(docs, **how)
    return out.where(F.col(out.columns[-1])).select(*docs.columns)
