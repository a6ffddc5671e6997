"""Structured Streaming: landed pages to raw and processed tweets, ticks to bars.

The file source's checkpoint is the resume cursor: a crash repeats a micro-batch, and
batches are written by their number, so a repetition replaces what it wrote before.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import IntegerType, StructField, StructType

from ..functions.text import per_ticker
from ..plans.progress import observed
from ..sources.pages import read_landed, texts_of
from ..sources.raw import PAGE, page_tweets, parse_json


def landed_pages(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    stream = spark.readStream.schema(PAGE)
    if files_per_batch:  # the rate limit of the source
        stream = stream.option("maxFilesPerTrigger", files_per_batch)
    return stream.json(path)


def new_tweets(pages: DataFrame, lateness: str = "7 days") -> DataFrame:
    """Tweets of a page stream, each id once within ``lateness`` of event time."""
    return page_tweets(pages).where("ts is not null").withWatermark("ts", lateness).dropDuplicatesWithinWatermark(["id"])


def _commits(store: str, least: int) -> Callable[[DataFrame, int], None]:
    """Writes a batch's new tweets and their rows per ticker under the batch's number.

    A batch is read once: the rows per ticker are made from the stored tweets.
    """

    def write(rows: DataFrame, name: str, number: int) -> None:
        rows.withColumn("batch", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(f"{store}/{name}")

    def commit(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        rows = held = batch.dropDuplicates(["id"])
        try:
            stored = session.read.parquet(f"{store}/raw").where(F.col("batch") != number).select("id")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
        else:
            # Ids grow with time, so the files' statistics leave out those of other times.
            # What reads the store isn't kept: a write to it would have it worked out anew.
            rows = held = rows.persist()
            ends = rows.agg(F.min("id").alias("lo"), F.max("id").alias("hi")).first()
            rows = rows.join(stored.where(F.col("id").between(ends["lo"], ends["hi"])), "id", "left_anti")
        write(rows, "raw", number)
        held.unpersist()
        new = session.read.schema(StructType([*rows.schema.fields, StructField("batch", IntegerType())])).parquet(f"{store}/raw").where(F.col("batch") == number)
        write(per_ticker(new.drop("batch"), least), "processed", number)

    return commit


def sync(spark: SparkSession, landing: str, store: str, checkpoint: str, least: int = 30, files_per_batch: int | None = None) -> StreamingQuery:
    """Append new tweets to ``store``/raw and their rows per ticker to ``store``/processed.

    Ids that earlier batches stored are left out by an anti-join, however late they come.
    """
    tweets = page_tweets(landed_pages(spark, landing, files_per_batch))
    return tweets.writeStream.foreachBatch(_commits(store, least)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def sync_landed(spark: SparkSession, path: str, store: str, checkpoint: str, least: int = 30) -> StreamingQuery:
    """The same from landings: the checkpoint's offset is the last landing that was read.

    Failed pages have no tweets; they come with the landing that has the page again.
    """
    tweets = observed(parse_json(texts_of(read_landed(spark, path, stream=True)), named=True), "landed", without_time=F.col("ts").isNull())
    return tweets.writeStream.foreachBatch(_commits(store, least)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def bar_stream(ticks: DataFrame, width: str = "15 minutes", lateness: str = "1 hour") -> DataFrame:
    """Bars ``(symbol, bar_ts, open, ...)`` of a stream of ``(symbol, ts, seq, price)``."""
    bars = ticks.withWatermark("ts", lateness).groupBy("symbol", F.window("ts", width))
    order = F.struct("ts", "seq")
    bars = bars.agg(F.min_by("price", order).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", order).alias("close"), F.count("*").alias("volume"))
    return bars.select("symbol", F.col("window.start").alias("bar_ts"), "open", "high", "low", "close", "volume")
