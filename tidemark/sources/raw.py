"""Reading tweets, bars, metadata and datasets; fetching through pluggable pages."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.once import once
from ..functions.timezones import api_time, bar_instant
from ..operators.indicators import NUMERICAL
from ..operators.prep import require_columns

#: A tweet of the API, a page of tweets and bars, as schemas.
TWEET = "id string, text string, createdAt string, twitterUrl string, url string, author struct<name: string, userName: string>, entities struct<symbols: array<struct<text: string>>>"
_TWEET = "struct<id: string, text: string, createdAt: string, twitterUrl: string, url: string, author: struct<name: string, userName: string>, entities: struct<symbols: array<struct<text: string>>>>"
PAGE = f"data struct<tweets: array<{_TWEET}>>, tweets array<{_TWEET}>, next_cursor string, has_next_page boolean"
DAILY = "symbol string, bar_date date, open double, high double, low double, close double, volume double"
INTRADAY = "symbol string, bar_ts timestamp, open double, high double, low double, close double, volume double"
#: Columns that a dataset for training has.
DATASET = ["text", "author", "category", "tweet_hash", "is_reliable_label", "label_1d_3class"]


#: Types of an enriched dataset's columns other than text.
DATASET_SCHEMA = ", ".join(
    [f"{c} double" for c in (*NUMERICAL, "entry_price", "price_next_open", "return_to_next_open", "hours_to_next_open", "market_cap")]
    + ["is_reliable_label boolean", "timestamp timestamp"]
)


def projected(tweets: DataFrame) -> DataFrame:
    """``(id, ts, author, username, url, symbols, text)`` of parsed API tweets."""
    return tweets.select(
        F.coalesce("id", F.lit("")).alias("id"),
        api_time(F.col("createdAt")).alias("ts"),
        F.coalesce("author.name", F.lit("")).alias("author"),
        F.coalesce("author.userName", F.lit("")).alias("username"),
        F.coalesce(F.nullif("twitterUrl", F.lit("")), F.col("url"), F.lit("")).alias("url"),
        F.coalesce(F.transform("entities.symbols", lambda s: s["text"]), F.array().cast("array<string>")).alias("symbols"),
        F.coalesce("text", F.lit("")).alias("text"),
    )


def page_tweets(pages: DataFrame) -> DataFrame:
    """The tweets of landed API pages, under ``tweets`` or ``data.tweets``."""
    return projected(pages.select(F.explode(F.coalesce("tweets", "data.tweets")).alias("t")).select("t.*"))


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Landed pages, a JSON object per line."""
    return page_tweets(spark.read.schema(PAGE).json(path))


def parse_json(raw: DataFrame, column: str = "json_data", named: bool = False) -> DataFrame:
    """Tweets of a text column of JSON objects; unreadable ones are null rows left out.

    ``named``: those without an id are left out too.
    """
    return projected(raw.select(once(F.from_json(column, TWEET)).alias("t")).where("t.id is not null" if named else "t is not null").select("t.*"))


def read_bars(spark: SparkSession, path: str, symbols: list[str] | None = None) -> DataFrame:
    """Bars of a parquet store partitioned by symbol; only the symbols asked for are read."""
    bars = spark.read.parquet(path)
    return bars.where(F.col("symbol").isin(symbols)) if symbols else bars


def read_feather_bars(spark: SparkSession, path: str, time: str = "bar_date") -> DataFrame:
    """Bars of Feather files named after their symbol, wherever Spark finds them.

    Times without a zone are New York's; those that name no instant are left out.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.feather").load(path).select("path", "content")
    names = ["symbol", time, "naive", "open", "high", "low", "close", "volume"]

    def run(batches):
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                table = pa.ipc.open_file(content.as_buffer()).read_all()
                first = "date" if "date" in table.column_names else table.column_names[0]
                naive = not pa.types.is_timestamp(table[first].type) or table[first].type.tz is None
                stamp = (table[first].cast(pa.timestamp("us")) if naive else table[first]).cast(pa.timestamp("us", tz="UTC"))
                columns = [pa.array([name.rsplit("/", 1)[-1].removesuffix(".feather").split("_")[0]] * len(table)), stamp.combine_chunks(), pa.array([naive] * len(table)), *(table[c].cast(pa.float64()).combine_chunks() for c in names[3:])]
                yield from pa.Table.from_arrays(columns, names=names).to_batches()

    out = files.mapInArrow(run, INTRADAY.replace("bar_ts timestamp", f"{time} timestamp, naive boolean"))
    if time == "bar_date":
        day = F.when(F.col("naive"), F.col(time)).otherwise(F.from_utc_timestamp(time, "America/New_York")).cast("date")
        return out.withColumn(time, day).drop("naive")
    out = out.withColumn(time, F.when(F.col("naive"), bar_instant(F.col(time))).otherwise(F.col(time)))
    return out.where(F.col(time).isNotNull()).drop("naive")


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """``(ticker, sector, market_cap_bucket)`` of a JSON object by ticker."""
    entry = "map<string, struct<sector: string, market_cap_bucket: string>>"
    raw = spark.read.option("wholetext", True).text(path).select(F.explode(F.from_json("value", entry)).alias("ticker", "m"))
    return raw.select("ticker", F.coalesce("m.sector", F.lit("Other")).alias("sector"), F.coalesce("m.market_cap_bucket", F.lit("unknown")).alias("market_cap_bucket"))


def read_metadata_rows(spark: SparkSession, path: str) -> DataFrame:
    """Metadata as ``sinks.write_metadata`` leaves it, a JSON object per line."""
    return spark.read.schema("ticker string, sector string, market_cap_bucket string").json(path)


def bars_of_symbols(bars: DataFrame, symbols: DataFrame) -> DataFrame:
    """The bars of a table of symbols, which prunes a store's partitions as it runs."""
    return bars.join(symbols.select("symbol").distinct(), "symbol", "left_semi")


class PreloadedBars:
    """A bar store of which some symbols' bars stay in the executors' memory.

    What is preloaded spills to disk and is read again where an executor is lost.
    """

    def __init__(self, bars: DataFrame):
        self.bars, self.held = bars, None

    def preload(self, symbols: DataFrame) -> DataFrame:
        """Keep the bars of a table of symbols, in place of those kept so far."""
        self.release()
        self.held = bars_of_symbols(self.bars, symbols).persist()
        return self.held

    def in_memory(self, symbol: str) -> DataFrame:
        """A symbol's bars as far as they are preloaded; none otherwise."""
        return (self.bars.limit(0) if self.held is None else self.held).where(F.col("symbol") == symbol)

    def of(self, symbol: str) -> DataFrame:
        """A symbol's bars, from memory if they are there and else from the store."""
        kept = self.in_memory(symbol)
        return self.bars.where(F.col("symbol") == symbol) if kept.isEmpty() else kept

    def release(self) -> None:
        if self.held is not None:
            self.held.unpersist()
            self.held = None


def store_stats(bars: DataFrame, time: str = "bar_date") -> DataFrame:
    """``(symbol, n_bars, first_bar, last_bar)`` of a store."""
    return bars.groupBy("symbol").agg(F.count("*").alias("n_bars"), F.min(time).alias("first_bar"), F.max(time).alias("last_bar"))


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV with a header and texts of many lines, by the header's names and the schema's types.

    One pass: no type is guessed, and columns that the schema doesn't know are text.
    """
    csv = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    types = dict(x.rsplit(" ", 1) for x in schema.split(", "))
    return csv.select(*[F.col(c).cast(types.get(c, "string")).alias(c) for c in csv.columns])


def read_dataset(spark: SparkSession, path: str) -> DataFrame:
    """An enriched dataset, CSV or parquet; missing columns are an error."""
    if path.rstrip("/").endswith(".csv"):
        df = read_csv(spark, path, DATASET_SCHEMA)
    else:
        df = spark.read.parquet(path)
    return require_columns(df, DATASET)


def validated_symbols(symbols: DataFrame, master: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Symbols that the master list has, and those it lacks."""
    return symbols.join(master.select("symbol"), "symbol", "left_semi"), symbols.join(master.select("symbol"), "symbol", "left_anti")
