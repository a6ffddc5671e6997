"""Queries over landed pages, bars and metadata: crawls, searches, backfills, streams.

``events`` are the tweets: a page holds up to four of an account and day, newest first, and
lies in JSON files that Spark writes and the data source reads.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import timezones as Z
from ..operators import bars as B
from ..scratch import scratch_path
from ..sources import crawl as C
from ..sources import pages as P
from ..sources import raw, sinks, stores
from ..sources import tables as S
from ..sources.versioned import Store, upserted
from ..streaming.accounts import keep_account_states
from ..streaming.ingest import sync_landed

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


#: Pages are numbered from this day back, a thousand to a day; on the other day some failed.
AFTER, FAILING = date(2024, 2, 29), date(2024, 1, 15)


def accounts(spark, sf) -> DataFrame:
    return S.table(spark, sf, "events").select(F.col("user_id").cast("string").alias("account")).distinct()


def written_pages(spark, sf) -> DataFrame:
    """``(user_id, date, page, tweets)`` of all accounts and days, by one sort."""
    e = S.table(spark, sf, "events").withColumn("date", F.col("ts").cast("date"))
    body = F.struct(F.col("event_id").cast("string").alias("id"), F.date_format("ts", "EEE MMM dd HH:mm:ss '+0000' yyyy").alias("createdAt"), F.concat("event_type", F.lit(" of $U"), F.col("user_id").cast("string"), F.lit(", seen by many people")).alias("text"))
    newest = Window.partitionBy("user_id", "date").orderBy(F.desc("ts"), F.desc("event_id"), F.desc("tweet"))
    rows = e.select("user_id", "date", "ts", "event_id", F.to_json(body).alias("tweet"))
    four = F.array_compact(F.array("tweet", *[F.lead("tweet", n).over(newest) for n in (1, 2, 3)]))
    firsts = rows.select("user_id", "date", (F.row_number().over(newest) - 1).alias("place"), four.alias("tweets")).where("place % 4 = 0")
    return firsts.select("user_id", "date", (F.datediff(F.lit(AFTER), "date") * 1000 + (F.col("place") / 4).cast("int")).alias("page"), "tweets")


def land_days(spark, sf, path: str, number: int) -> None:
    """Landing 1: the days before the failing one.  Landing 2: the others; on the failing day
    the pages of every eleventh account failed.  Landing 3: every second of those again."""
    rows = written_pages(spark, sf)
    lost = (F.col("date") == F.lit(FAILING)) & (F.col("user_id") % 11 == 0)
    if number == 3:
        rows, lost = rows.where(lost & (F.col("user_id") % 22 == 0)), F.lit(False)
    else:
        rows = rows.where((F.col("date") < F.lit(FAILING)) == F.lit(number == 1))
    P.land(rows.select(*P.page_of(F.col("user_id"), F.col("page"), F.col("date"), F.when(lost, "HTTP 503"), F.col("page") + 1, F.when(~lost, F.col("tweets")))), path, number)


def landed(spark, sf) -> DataFrame:
    path = scratch_path(spark, "landing")
    for number in (1, 2, 3):
        land_days(spark, sf, path, number)
    return P.read_landed(spark, path)


def known(spark, sf) -> DataFrame:
    return S.table(spark, sf, "events").where("event_id % 7 = 0").select(F.col("event_id").cast("string").alias("id"))


POSTS = """posts AS (SELECT CAST(user_id AS VARCHAR) AS account, user_id AS a, CAST(event_id AS VARCHAR) AS id, date_trunc('second', ts) AS ts, CAST(ts AS DATE) AS day, event_id % 7 = 0 AS seen,
  row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn,
  date_diff('day', CAST(ts AS DATE), DATE '2024-02-29') * 1000 + (row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts DESC, event_id DESC) - 1) // 4 AS page,
  CAST(ts AS DATE) = DATE '2024-01-15' AND user_id % 11 = 0 AND user_id % 22 <> 0 AS lost FROM events),
fails AS (SELECT account, min(page) AS failed_page, min(rn) AS failed_rn FROM posts WHERE lost GROUP BY 1)"""


def _times(out: DataFrame) -> DataFrame:
    return out.select("account", "id", Z.api_time(F.col("created")).cast("timestamp_ntz").alias("ts"), "error")


@query(f"WITH {POSTS} SELECT account, id, ts, NULL AS error FROM posts LEFT JOIN fails USING (account) WHERE failed_page IS NULL OR page < failed_page UNION ALL SELECT account, NULL, NULL, 'HTTP 503' FROM fails")
def crawl_all(spark, sf):
    """Every page of every account, up to one that failed for good; failures are rows."""
    return _times(P.crawl(landed(spark, sf)))


@query(f"WITH {POSTS}, stops AS (SELECT account, min(rn) AS stop FROM posts WHERE seen AND NOT lost GROUP BY 1) SELECT account, id, ts FROM posts LEFT JOIN stops USING (account) LEFT JOIN fails USING (account) WHERE (stop IS NULL OR rn < stop) AND (failed_page IS NULL OR page < failed_page)")
def crawl_incremental(spark, sf):
    """Each account up to its first known tweet."""
    return _times(P.crawl(landed(spark, sf), known(spark, sf))).where("id is not null").drop("error")


@query(f"WITH {POSTS} SELECT account, id, ts FROM posts LEFT JOIN fails USING (account) WHERE rn <= 7 AND (failed_page IS NULL OR page < failed_page)")
def crawl_most(spark, sf):
    return _times(P.crawl(landed(spark, sf), most=7)).where("id is not null").drop("error")


@query(f"WITH {POSTS} SELECT account, id, ts FROM posts WHERE day >= DATE '2024-01-20' AND NOT seen")
def crawl_backfill(spark, sf):
    """Known tweets are skipped, older ones than the target end the crawl."""
    return _times(P.crawl(landed(spark, sf), known(spark, sf), until=date(2024, 1, 20))).where("id is not null").drop("error")


@query(f"WITH {POSTS} SELECT account, id, ts FROM posts WHERE page >= 50000")
def crawl_resumed(spark, sf):
    """From a stored cursor on."""
    return _times(P.crawl(landed(spark, sf), cursors=accounts(spark, sf).withColumn("cursor", F.lit("50000")))).where("id is not null").drop("error")


def _ranges(spark, sf) -> DataFrame:
    return accounts(spark, sf).select("account", F.lit(date(2024, 1, 14)).alias("since"), F.lit(date(2024, 1, 17)).alias("until"))


HITS = f"{POSTS}, hits AS (SELECT * FROM posts WHERE day >= DATE '2024-01-14' AND day < DATE '2024-01-17')"


@query(f"WITH {HITS} SELECT account, id, ts FROM hits WHERE NOT seen AND account NOT IN (SELECT account FROM hits WHERE lost)")
def search_range(spark, sf):
    new, _ = P.search(_ranges(spark, sf), landed(spark, sf), known(spark, sf))
    return _times(new.withColumn("error", F.lit(None).cast("string"))).drop("error")


@query(f"""WITH {HITS}, n AS (SELECT account, count(DISTINCT page) AS calls, bool_or(lost) AS failed, count(*) AS n, count(*) FILTER (seen) AS old FROM hits GROUP BY 1)
SELECT account, greatest(coalesce(calls, 0), 1)::BIGINT AS calls, CASE WHEN failed THEN 0 ELSE coalesce(n - old, 0) END::BIGINT AS n_new, CASE WHEN failed THEN 0 ELSE coalesce(old, 0) END::BIGINT AS n_skipped, CASE WHEN failed THEN 'HTTP 503' END AS error
FROM (SELECT DISTINCT CAST(user_id AS VARCHAR) AS account FROM events) LEFT JOIN n USING (account)""")
def search_journal(spark, sf):
    """Calls, new and skipped tweets of each range."""
    return P.search(_ranges(spark, sf), landed(spark, sf), known(spark, sf))[1].select("account", "calls", "n_new", "n_skipped", "error")


def _backfill(spark, sf):
    a = accounts(spark, sf)
    journal = a.where("cast(account as long) % 4 = 1").select("account", F.lit(date(2024, 1, 14)).alias("fetch_date"))
    return P.backfill(a, journal, landed(spark, sf), date(2024, 1, 13), date(2024, 1, 17), known(spark, sf))


DUE = f"""{POSTS}, due AS (SELECT account, a, since FROM (SELECT DISTINCT CAST(user_id AS VARCHAR) AS account, user_id AS a FROM events), (SELECT CAST(unnest(generate_series(DATE '2024-01-13', DATE '2024-01-16', INTERVAL 1 DAY)) AS DATE) AS since) WHERE NOT (a % 4 = 1 AND since = DATE '2024-01-14'))"""


@query(f"WITH {DUE} SELECT p.account, since, id FROM posts p JOIN due d ON p.account = d.account AND day = since WHERE NOT lost AND NOT seen")
def backfill_commit(spark, sf):
    """Whole days only: a day with a failed page leaves nothing, today isn't asked for."""
    return _backfill(spark, sf)[0].select("account", "since", "id")


@query(f"""WITH {DUE}, n AS (SELECT account, day AS since, bool_or(lost) AS failed, count(*) AS n, count(*) FILTER (seen) AS old FROM posts GROUP BY ALL)
SELECT account, since, CASE WHEN failed THEN 0 ELSE coalesce(n - old, 0) END::BIGINT AS n_new, CASE WHEN failed THEN 0 ELSE coalesce(old, 0) END::BIGINT AS n_skipped, CASE WHEN failed THEN 'HTTP 503' END AS error FROM due LEFT JOIN n USING (account, since)""")
def backfill_journal(spark, sf):
    return _backfill(spark, sf)[1].select("account", "since", "n_new", "n_skipped", "error")


@query(f"WITH {POSTS} SELECT id, ts FROM posts WHERE NOT lost")
def sync_stream(spark, sf):
    """Landings as a stream: two runs from one checkpoint, what landed in between is new."""
    path, store = scratch_path(spark, "landing"), scratch_path(spark, "store")
    for numbers in ((1, 2), (3,)):
        for number in numbers:
            land_days(spark, sf, path, number)
        sync_landed(spark, path, store, f"{store}-checkpoint").awaitTermination()
    return spark.read.parquet(f"{store}/raw").select("id", F.col("ts").cast("timestamp_ntz").alias("ts"))


@query(f"WITH {POSTS} SELECT id, 'U' || a AS ticker, event_type || ' of $U' || a || ', seen by many people' AS text FROM posts JOIN events ON id = CAST(event_id AS VARCHAR) WHERE NOT lost")
def sync_processed(spark, sf):
    """The stream's processed rows, one per tweet and ticker."""
    path, store = scratch_path(spark, "landing"), scratch_path(spark, "store")
    for number in (1, 2, 3):
        land_days(spark, sf, path, number)
    sync_landed(spark, path, store, f"{store}-checkpoint").awaitTermination()
    return spark.read.parquet(f"{store}/processed").select("id", "ticker", "text")


@query("""SELECT CAST(user_id AS VARCHAR) AS account, CAST(arg_max(event_id, (ts, event_id)) AS VARCHAR) AS last_tweet_id, 'cursor ' || arg_max(event_id, (ts, event_id)) AS last_cursor, count(*) AS total_tweets, max(ts) AS last_ts FROM events WHERE user_id IS NOT NULL GROUP BY 1""")
def sync_states(spark, sf):
    """Sync states kept by a stream over batches out of order, stopped and started again."""
    e = S.table(spark, sf, "events").select(F.col("user_id").cast("string").alias("account"), F.col("event_id").cast("string").alias("id"), F.concat(F.lit("cursor "), F.col("event_id").cast("string")).alias("cursor"), F.col("ts").cast("timestamp").alias("ts"))
    source, root = scratch_path(spark, "tweets"), scratch_path(spark, "states")
    store = Store(spark, root, ["account"], 8)
    for part in (2, 0, 1):
        e.where(F.pmod(F.xxhash64("id"), F.lit(3)) == part).write.mode("append").parquet(source)
        stream = spark.readStream.schema(e.schema).parquet(source)
        keep_account_states(stream, store, f"{root}-checkpoint", "60 days").awaitTermination()
    return store.read().select("account", "last_tweet_id", "last_cursor", "total_tweets", F.col("last_ts").cast("timestamp_ntz").alias("last_ts"))


# ---------------------------------------------------------------- bars, contracts, metadata


def _bar_store(spark, sf) -> str:
    path = scratch_path(spark, "bar-store")
    sinks.write_bars(S.daily_bars(spark, sf).withColumn("volume", F.col("volume").cast("double")), path)
    return path


@query(f"WITH {S.DAILY} SELECT symbol, bar_date, close FROM daily WHERE symbol IN (SELECT o_orderpriority FROM orders GROUP BY 1 HAVING count(*) % 2 = 0)")
def preloaded_bars(spark, sf):
    """Bars that stay in memory for the symbols that a table asks for."""
    wanted = S.table(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("symbol")).count().where("count % 2 = 0")
    return raw.PreloadedBars(raw.read_bars(spark, _bar_store(spark, sf))).preload(wanted).select("symbol", "bar_date", "close")


def _asked(spark, sf) -> DataFrame:
    """The symbols of orders, and the flags of line items, which have no bars."""
    modes = S.table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("symbol"))
    return S.table(spark, sf, "orders").select(F.col("o_orderpriority").alias("symbol")).union(modes).distinct()


@query(f"WITH {S.DAILY} SELECT symbol, bar_date, open, high, low, close, CAST(volume AS DOUBLE) AS volume FROM daily")
def fetch_bars(spark, sf):
    """One symbol after another from a landed store; one without bars leaves the others alone."""
    return C.fetched_bars(_asked(spark, sf), stores.bar_fetcher(_bar_store(spark, sf)), batch=1)[0]


@query("SELECT DISTINCT l_returnflag AS symbol, 'LookupError: no bars of ' || l_returnflag AS error FROM lineitem")
def fetch_bars_errors(spark, sf):
    return C.fetched_bars(_asked(spark, sf), stores.bar_fetcher(_bar_store(spark, sf)), batch=1)[1]


@query("SELECT DISTINCT o_orderpriority AS symbol, true AS valid FROM orders UNION ALL SELECT DISTINCT l_returnflag, false FROM lineitem")
def validate_contracts(spark, sf):
    return C.validated(_asked(spark, sf), stores.contract_checker(_bar_store(spark, sf)))


@query("""SELECT CAST(s_suppkey AS VARCHAR) AS ticker, CASE WHEN s_suppkey % 2 = 0 THEN 'Stored' WHEN s_suppkey % 5 = 0 THEN 'Other' ELSE s_name END AS sector,
CASE WHEN s_suppkey % 2 = 0 THEN 'mega_cap' WHEN s_suppkey % 5 = 0 THEN 'unknown' WHEN s_acctbal >= 5000 THEN 'large_cap' ELSE 'small_cap' END AS market_cap_bucket FROM supplier""")
def metadata_read_through(spark, sf):
    """Stored metadata, written as JSON and read again; the rest is joined with what landed."""
    s = S.table(spark, sf, "supplier").select(F.col("s_suppkey").cast("string").alias("ticker"), F.col("s_suppkey").alias("k"), "s_name", "s_acctbal")
    path, there = scratch_path(spark, "metadata-json"), scratch_path(spark, "metadata-landed")
    sinks.write_metadata(s.where("k % 2 = 0").select("ticker", F.lit("Stored").alias("sector"), F.lit("mega_cap").alias("market_cap_bucket")), path)
    s.where("k % 5 <> 0").select("ticker", F.col("s_name").alias("sector"), F.when(F.col("s_acctbal") >= 5000, "large_cap").otherwise("small_cap").alias("market_cap_bucket")).write.parquet(there)
    return C.with_metadata(s.select("ticker"), raw.read_metadata_rows(spark, path), spark.read.parquet(there))


# ---------------------------------------------------------------- stores that are merged in place


@query(f"WITH {S.DAILY} SELECT symbol, bar_date, open, high, low, close, volume FROM daily")
def store_bars(spark, sf):
    """Bars of two syncs, then of a backfill, in one versioned store; a repeated sync adds none."""
    bars, store = S.daily_bars(spark, sf), Store(spark, scratch_path(spark, "bars-store"), ["symbol"], 8)
    for rows, merge in ((bars.where("bar_date between '1997-01-01' and '1998-06-30'"), B.appended), (bars.where("bar_date >= '1998-01-01'"), B.appended), (bars.where("bar_date >= '1998-01-01'"), B.appended), (bars.where("bar_date < '1997-06-01'"), B.prepended)):
        store.merge(rows, merge, order=["symbol", "bar_date"])
    return store.read()


@query(f"WITH {S.DAILY} SELECT symbol, bar_date, close FROM daily WHERE bar_date < DATE '1998-01-01'")
def store_of_a_version(spark, sf):
    """What a reader of the first version sees after later merges."""
    bars, store = S.daily_bars(spark, sf).select("symbol", "bar_date", "close"), Store(spark, scratch_path(spark, "bars-store"), ["symbol", "bar_date"], 8)
    store.merge(bars.where("bar_date < '1998-01-01'"), upserted(["symbol", "bar_date"]))
    store.merge(bars.withColumn("close", F.lit(0.0)), upserted(["symbol", "bar_date"]))
    return store.read(1)


@query("""SELECT CAST(user_id AS VARCHAR) AS account, CAST(ts AS DATE) AS fetch_date, max(event_id)::BIGINT AS last_id, date_trunc('second', arg_max(ts, event_id)) AS fetched_at FROM events GROUP BY ALL""")
def store_journal(spark, sf):
    """The fetch journal, in batches whose last write of an account and day wins."""
    e = S.table(spark, sf, "events").select(F.col("user_id").cast("string").alias("account"), F.col("ts").cast("date").alias("fetch_date"), F.col("event_id").alias("last_id"), F.date_trunc("second", "ts").cast("timestamp_ntz").alias("fetched_at"))
    store, keys = Store(spark, scratch_path(spark, "journal-store"), ["account", "fetch_date"], 8), ["account", "fetch_date"]
    cut = e.agg((F.max("last_id") / 2).cast("long").alias("c")).first().c or 0
    for number, batch in enumerate((e.where(F.col("last_id") <= cut), e.where(F.col("last_id") > cut))):
        for _ in range(2):  # the second time nothing changes
            store.merge(batch, upserted(keys, "last_id"), batch=("journal", number))
    return store.read()
