"""Writing bars, datasets, exports and artifacts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import clean_for_model


def write_bars(bars: DataFrame, path: str) -> None:
    """Replace the stored bars of the symbols at hand; those of others stay."""
    time = "bar_ts" if "bar_ts" in bars.columns else "bar_date"
    rows = bars.repartition("symbol").sortWithinPartitions("symbol", time)
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("symbol").parquet(path)


def write_bar_table(bars: DataFrame, name: str, path: str, buckets: int = 64) -> DataFrame:
    """Bars as the table ``name`` at ``path``, bucketed by symbol and sorted by time.

    Indicators and other windows by symbol read it without a shuffle.  Each bucket is one
    file, written by the task that has it: what a symbol can hold is bounded by its days.
    """
    time = "bar_ts" if "bar_ts" in bars.columns else "bar_date"
    rows = bars.repartition(buckets, "symbol").sortWithinPartitions("symbol", time)
    rows.write.mode("overwrite").bucketBy(buckets, "symbol").sortBy("symbol", time).option("path", path).saveAsTable(name)
    return bars.sparkSession.table(name)


def export_csv(tweets: DataFrame, path: str) -> None:
    """Processed tweets by time, texts cleaned anew, as CSV files with a header.

    Files are ranges of time in the order of their names, so that no task writes all;
    a small export is one file.
    """
    rows = tweets.withColumn("text", clean_for_model("text")).select(F.col("ts").alias("timestamp"), "author", "ticker", "tweet_url", "category", "text")
    rows.orderBy("timestamp").write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_dataset(df: DataFrame, path: str) -> None:
    if path.endswith(".csv"):
        df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)
    else:
        df.write.mode("overwrite").parquet(path)


def save_artifacts(artifacts: dict[str, DataFrame], path: str) -> None:
    """Small tables (encodings, scaler, weights) as JSON, a folder each."""
    for name, df in artifacts.items():
        df.coalesce(1).write.mode("overwrite").json(f"{path}/{name}")


def load_artifact(spark: SparkSession, path: str, name: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(f"{path}/{name}")


def write_metadata(metadata: DataFrame, path: str) -> None:
    metadata.select("ticker", "sector", "market_cap_bucket").write.mode("overwrite").json(path)


def write_results(reports: dict[str, DataFrame], path: str) -> None:
    """Reports of a few rows as one JSON object: an array of rows for each name."""
    spark = next(iter(reports.values())).sparkSession
    whole = spark.range(1).select()
    for name, df in reports.items():
        whole = whole.join(df.agg(F.collect_list(F.struct(*df.columns)).alias(name)))  # one row each
    whole.coalesce(1).write.mode("overwrite").json(path)
