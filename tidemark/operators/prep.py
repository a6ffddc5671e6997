"""Dataset preparation: splits, leak checks, encodings, scaling and class weights."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranks import positions

LABELS = ("SELL", "HOLD", "BUY")
#: Columns that see the future and never are features.
FORBIDDEN = ["spy_return_1d", "spy_return_1hr", "return_1hr", "return_to_next_open", "entry_price", "exit_price_1hr", "price_next_open", "label_3class", "label_1d_3class"]
#: What a category that is missing counts as.
MISSING = {"market_regime": "calm", "sector": "Other", "market_cap_bucket": "unknown"}


def require_columns(df: DataFrame, names: Sequence[str]) -> DataFrame:
    if absent := [c for c in names if c not in df.columns]:
        raise ValueError(f"missing columns: {absent}")
    return df


def reliable_rows(df: DataFrame, target: str = "label_1d_3class", drop_missing: bool = True) -> DataFrame:
    df = df.where(F.col("is_reliable_label"))
    return df.where(F.col(target).isNotNull()) if drop_missing else df


def labelled_texts(df: DataFrame, target: str = "label_1d_3class") -> DataFrame:
    """Rows with a label and a text, reliable or not."""
    return df.where(F.col(target).isNotNull() & (F.char_length("text") > 0))


def summary(df: DataFrame, target: str = "label_1d_3class") -> DataFrame:
    """One row: samples, reliable ones, missing and each label, authors, tickers."""
    counts = {"n_sell": F.col(target) == "SELL", "n_hold": F.col(target) == "HOLD", "n_buy": F.col(target) == "BUY", "missing_target": F.col(target).isNull()}
    return df.agg(F.count("*").alias("total_samples"), F.count_if("is_reliable_label").alias("reliable_samples"), *[F.count_if(c).alias(n) for n, c in counts.items()], F.count_distinct("author").alias("unique_authors"), F.count_distinct("ticker").alias("unique_tickers"))


def missing_shares(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``(feature, missing_rate)`` of each column, in one pass."""
    rates = df.agg(*[F.avg(F.col(c).isNull().cast("int")).alias(c) for c in columns])
    return rates.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("missing_rate")) for c in columns])).alias("x")).select("x.*")


def token_ids(df: DataFrame, encode: Callable[[list[str]], list[list[int]]], text_col: str = "text", width: int = 128, pad: int = 0) -> DataFrame:
    """``df`` with ``input_ids`` and ``attention_mask``, cut and padded to ``width``.

    ``encode`` maps texts to ids with any tokenizer; a null text is an empty one.
    """
    from pyspark.sql.types import ArrayType, IntegerType

    @F.pandas_udf(ArrayType(IntegerType()))
    def ids(texts: pd.Series) -> pd.Series:
        return pd.Series([x[:width] for x in encode(texts.fillna("").tolist())])

    n = F.size("__ids")
    padded = lambda x, fill: F.concat(x, F.array_repeat(F.lit(fill), F.lit(width) - n))
    out = df.withColumn("__ids", ids(text_col))
    return out.withColumns({"input_ids": padded(F.col("__ids"), pad), "attention_mask": padded(F.transform("__ids", lambda _: F.lit(1)), 0)}).drop("__ids")


def feature_columns(df: DataFrame, numerical: Sequence[str], categorical: Sequence[str]) -> DataFrame:
    """``df`` with missing numbers as 0; forbidden columns among the features are an error."""
    if leaks := sorted({*numerical, *categorical} & {*FORBIDDEN}):
        raise ValueError(f"features that see the future: {leaks}")
    return require_columns(df, [*numerical, *categorical]).fillna(0, list(numerical))


def label_id(label: Column) -> Column:
    return F.when(label == "SELL", 0).when(label == "HOLD", 1).when(label == "BUY", 2)


def split_by_hash(df: DataFrame, hash_col: str = "tweet_hash", test: float = 0.1, val: float = 0.1) -> DataFrame:
    """``split`` from the hash's first 8 hex digits: equal texts never part."""
    number = F.conv(F.substring(hash_col, 1, 8), 16, 10).cast("long") % 1000
    return require_columns(df, [hash_col]).withColumn("split", F.when(number < int(test * 1000), "test").when(number < int((test + val) * 1000), "val").otherwise("train"))


def split_by_time(df: DataFrame, order: list[str], test: float = 0.1, val: float = 0.1) -> DataFrame:
    """``split`` by position in time: first train, then val, then test."""
    n = df.count()
    train_end, val_end = int(n * (1 - test - val)), int(n * (1 - test))
    at = positions(df, order, "__position")
    return at.withColumn("split", F.when(F.col("__position") < train_end, "train").when(F.col("__position") < val_end, "val").otherwise("test")).drop("__position")


def split_summary(df: DataFrame, hash_col: str = "tweet_hash") -> DataFrame:
    n = df.groupBy("split").agg(F.count("*").alias("n_rows"), F.count_distinct(hash_col).alias("n_hashes"))
    total = F.sum("n_rows").over(Window.partitionBy())
    return n.withColumn("pct", F.round(100 * F.col("n_rows") / total, 6))


def temporal_summary(df: DataFrame, ts: str = "ts") -> DataFrame:
    return df.groupBy("split").agg(F.count("*").alias("n_rows"), F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"))


def leaking(df: DataFrame, hash_col: str = "tweet_hash") -> DataFrame:
    """Hashes that two splits or more have, with how many."""
    return df.groupBy(hash_col).agg(F.count_distinct("split").alias("n_splits")).where("n_splits > 1")


def assert_no_leakage(df: DataFrame, hash_col: str = "tweet_hash") -> None:
    if (n := leaking(df, hash_col).count()) > 0:
        raise ValueError(f"{n} hashes are in more than one split")


def encodings(df: DataFrame, column: str, order: str) -> DataFrame:
    """``(value, idx)``: values numbered by first appearance in ``order``."""
    value = F.coalesce(F.col(column), F.lit(MISSING[column])) if column in MISSING else F.col(column)
    first = df.select(value.alias("value"), F.col(order).alias("__o")).where("value is not null").groupBy("value").agg(F.min("__o").alias("__o"))
    # One row per distinct value, far fewer than rows.
    return first.withColumn("idx", (F.row_number().over(Window.orderBy("__o", "value")) - 1).cast("int")).select("value", "idx")


def encoded(df: DataFrame, maps: dict[str, DataFrame], handle_unknown: str = "default") -> DataFrame:
    """``df`` with ``<column>_idx``; unknown values get 0, or are an error."""
    for column, known in maps.items():
        value = F.coalesce(F.col(column), F.lit(MISSING[column])) if column in MISSING else F.col(column)
        pair = known.select(F.col("value").alias("__value"), F.col("idx").alias("__idx"))
        df = df.withColumn("__key", value).join(pair, F.col("__key") == F.col("__value"), "left")
        unknown = F.lit(0) if handle_unknown != "error" else F.raise_error(F.concat(F.lit(f"unknown {column}: "), F.coalesce("__key", F.lit("null")))).cast("int")
        df = df.withColumn(f"{column}_idx", F.coalesce("__idx", unknown)).drop("__key", "__value", "__idx")
    return df


def scaler(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row of means and population deviations (1 where a column doesn't vary)."""
    filled = df.fillna(0, list(columns))
    std = lambda c: F.when(F.stddev_pop(c) > 0, F.stddev_pop(c)).otherwise(1.0)
    return filled.agg(*[F.avg(c).alias(f"{c}_mean") for c in columns], *[std(c).alias(f"{c}_std") for c in columns])


def scaled(df: DataFrame, columns: Sequence[str], fitted: DataFrame) -> DataFrame:
    df = df.fillna(0, list(columns)).join(F.broadcast(fitted))  # one row
    return df.withColumns({c: (F.col(c) - F.col(f"{c}_mean")) / F.col(f"{c}_std") for c in columns}).drop(*[f"{c}_{k}" for c in columns for k in ("mean", "std")])


def class_weights(df: DataFrame, label: str = "label", mode: str = "balanced", buy_boost: float = 1.0) -> DataFrame:
    """``(label, n, weight)``: n / (classes * n of the class), or its root with mean 1."""
    n = df.where(F.col(label).isNotNull()).groupBy(F.col(label).alias("label")).agg(F.count("*").alias("n"))
    everything = Window.partitionBy()  # one row per class
    weight = F.sum("n").over(everything) / (F.count("*").over(everything) * F.col("n"))
    n = n.withColumn("weight", weight)
    if mode == "sqrt":
        n = n.withColumn("weight", F.sqrt("weight")).withColumn("weight", F.col("weight") / F.avg("weight").over(everything))
    return n.withColumn("weight", F.when(F.col("label").cast("string").isin("BUY", "2"), F.col("weight") * buy_boost).otherwise(F.col("weight")))
