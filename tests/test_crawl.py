"""A crawled service played by functions, and the crawls that ask it page by page.

Account ``a`` of ``supplier`` has ``5 + 7 a mod 40`` tweets, the ``k``-th newest at ``k``
hours before March 2024.
"""

import sys
from datetime import date, datetime, timedelta

import pytest
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import timezones as Z
from tidemark.scratch import scratch_path
from tidemark.sources import crawl as C
from tidemark.sources import raw, sinks
from tidemark.sources import tables as S

# Executors have no tests on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
PLAYED: dict = {}


def query(sql: str):
    def add(f):
        PLAYED[f.__name__] = f, sql
        return f

    return add


def accounts(spark, sf) -> DataFrame:
    return S.table(spark, sf, "supplier").select(F.col("s_suppkey").cast("string").alias("account"))


def _tweets_of(account: str) -> list[dict]:
    a, newest = int(account), datetime(2024, 3, 1)
    return [{"id": str(a * 1000 + k), "createdAt": (newest - timedelta(hours=k)).strftime("%a %b %d %H:%M:%S +0000 %Y"), "text": f"tweet {k}"} for k in range(5 + 7 * a % 40)]


def page(account: str, cursor: str | None) -> tuple[list[dict], str | None]:
    """Ten tweets a page; every eleventh account fails."""
    if int(account) % 11 == 0:
        raise OSError("no such account")
    at, tweets = int(cursor or 0), _tweets_of(account)
    return tweets[at : at + 10], str(at + 10) if at + 10 < len(tweets) else None


SERVICE = """
posts AS (SELECT CAST(a AS VARCHAR) AS account, CAST(a * 1000 + k AS VARCHAR) AS id, a, k, TIMESTAMP '2024-03-01' - to_hours(CAST(k AS INTEGER)) AS ts
  FROM (SELECT s_suppkey AS a, unnest(range(5 + 7 * s_suppkey % 40)) AS k FROM supplier))"""


def _crawl(out: DataFrame) -> DataFrame:
    return out.select("account", "id", Z.api_time(F.col("created")).cast("timestamp_ntz").alias("ts"), "error")


@query(f"WITH {SERVICE} SELECT account, id, ts, NULL AS error FROM posts WHERE a % 11 <> 0 UNION ALL SELECT CAST(s_suppkey AS VARCHAR), NULL, NULL, 'OSError: no such account' FROM supplier WHERE s_suppkey % 11 = 0")
def crawl_all(spark, sf):
    """Every page of every account; failures are rows."""
    return _crawl(C.crawled(accounts(spark, sf), page))


KNOWN = "known AS (SELECT account, id, k FROM posts WHERE k >= 12 OR a % 5 = 0 AND k = 3)"


def _known(spark, sf) -> DataFrame:
    rows = accounts(spark, sf).withColumn("a", F.col("account").cast("long"))
    rows = rows.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), 4 + 7 * F.col("a") % 40)))
    return rows.where("k >= 12 or a % 5 = 0 and k = 3").select((F.col("a") * 1000 + F.col("k")).cast("string").alias("id"), "account", "k")


@query(f"WITH {SERVICE}, {KNOWN}, stops AS (SELECT account, min(k) AS stop FROM known GROUP BY 1) SELECT account, id, ts FROM posts LEFT JOIN stops USING (account) WHERE a % 11 <> 0 AND (stop IS NULL OR k < stop)")
def crawl_incremental(spark, sf):
    """Each account up to its first known tweet."""
    return _crawl(C.crawled(accounts(spark, sf), page, _known(spark, sf))).where("id is not null").drop("error")


@query(f"WITH {SERVICE} SELECT account, id, ts FROM posts WHERE a % 11 <> 0 AND k < 7")
def crawl_most(spark, sf):
    return _crawl(C.crawled(accounts(spark, sf), page, most=7)).where("id is not null").drop("error")


@query(f"WITH {SERVICE}, {KNOWN} SELECT account, id, ts FROM posts WHERE a % 11 <> 0 AND CAST(ts AS DATE) >= DATE '2024-02-29' AND id NOT IN (SELECT id FROM known)")
def crawl_backfill(spark, sf):
    """Known tweets are skipped, older ones than the target end the crawl."""
    return _crawl(C.crawled(accounts(spark, sf), page, _known(spark, sf), until=date(2024, 2, 29))).where("id is not null").drop("error")


@query(f"WITH {SERVICE} SELECT account, id, ts FROM posts WHERE a % 11 <> 0 AND k >= 20")
def crawl_resumed(spark, sf):
    """From a stored cursor on."""
    there = accounts(spark, sf).where("5 + 7 * cast(account as long) % 40 > 20")
    return _crawl(C.crawled(there, page, cursors=there.withColumn("cursor", F.lit("20")))).where("id is not null").drop("error")


def searching(fails: bool = False):
    """Tweets of a range of days, four a page.  Of ``fails``, account 3 + 7 n never answers
    for one day, and account 5 n only the third time."""
    asked: dict = {}

    def search(account: str, since: date, until: date, cursor: str | None) -> tuple[list[dict], str | None]:
        if cursor is None and fails:
            asked[account, since] = asked.get((account, since), 0) + 1
            if since == date(2024, 2, 28) and int(account) % 7 == 3 or int(account) % 5 == 0 and asked[account, since] < 3:
                raise TimeoutError("try again")
        fits = [t for t in _tweets_of(account) if since <= datetime.strptime(t["createdAt"], "%a %b %d %H:%M:%S +0000 %Y").date() < until]
        at = int(cursor or 0)
        return fits[at : at + 4], str(at + 4) if at + 4 < len(fits) else None

    return search


#: The service's search, for the command line.
search = searching()


@query(f"WITH {SERVICE}, {KNOWN} SELECT account, id, ts FROM posts WHERE ts >= TIMESTAMP '2024-02-29' AND ts < TIMESTAMP '2024-03-01' AND id NOT IN (SELECT id FROM known)")
def search_range(spark, sf):
    ranges = accounts(spark, sf).select("account", F.lit(date(2024, 2, 29)).alias("since"), F.lit(date(2024, 3, 1)).alias("until"))
    new, _ = C.searched(ranges, searching(), _known(spark, sf))
    return _crawl(new.withColumn("error", F.lit(None).cast("string"))).drop("error")


@query(f"""WITH {SERVICE}, {KNOWN}, hits AS (SELECT account, count(*) AS n, count(*) FILTER (id IN (SELECT id FROM known)) AS n_skipped FROM posts WHERE ts >= TIMESTAMP '2024-02-29' AND ts < TIMESTAMP '2024-03-01' GROUP BY 1)
SELECT CAST(s_suppkey AS VARCHAR) AS account, greatest(1, (coalesce(n, 0) + 3) // 4)::INTEGER AS calls, (coalesce(n, 0) - coalesce(n_skipped, 0))::BIGINT AS n_new, coalesce(n_skipped, 0)::BIGINT AS n_skipped FROM supplier LEFT JOIN hits ON account = CAST(s_suppkey AS VARCHAR)""")
def search_journal(spark, sf):
    """Calls, new and skipped tweets of each range."""
    ranges = accounts(spark, sf).select("account", F.lit(date(2024, 2, 29)).alias("since"), F.lit(date(2024, 3, 1)).alias("until"))
    return C.searched(ranges, searching(), _known(spark, sf))[1].select("account", "calls", "n_new", "n_skipped")


def _backfill(spark, sf):
    a = accounts(spark, sf)
    journal = a.where("cast(account as long) % 4 = 1").select("account", F.lit(date(2024, 2, 29)).alias("fetch_date"))
    return C.backfilled(a, journal, searching(fails=True), date(2024, 2, 27), date(2024, 3, 1), _known(spark, sf))


DAYS = """days AS (SELECT s_suppkey AS a, CAST(s_suppkey AS VARCHAR) AS account, CAST(unnest(generate_series(DATE '2024-02-27', DATE '2024-02-29', INTERVAL 1 DAY)) AS DATE) AS since FROM supplier),
due AS (SELECT *, since = DATE '2024-02-28' AND a % 7 = 3 AS failed FROM days WHERE NOT (a % 4 = 1 AND since = DATE '2024-02-29'))"""


@query(f"""WITH {SERVICE}, {KNOWN}, {DAYS} SELECT p.account, since, id FROM posts p JOIN due d ON p.account = d.account AND CAST(ts AS DATE) = since WHERE NOT failed AND id NOT IN (SELECT id FROM known)""")
def backfill_commit(spark, sf):
    """Whole days only: a day that fails three times leaves nothing, today isn't asked for."""
    return _backfill(spark, sf)[0].select("account", "since", "id")


@query(f"""WITH {SERVICE}, {KNOWN}, {DAYS}, n AS (SELECT d.account, since, count(id) AS n, count(id) FILTER (id IN (SELECT id FROM known)) AS old FROM due d LEFT JOIN posts p ON p.account = d.account AND CAST(ts AS DATE) = since WHERE NOT failed GROUP BY 1, 2)
SELECT d.account, since, (coalesce(n, 0) - coalesce(old, 0))::BIGINT AS n_new, coalesce(old, 0)::BIGINT AS n_skipped, CASE WHEN failed THEN 'TimeoutError: try again' END AS error FROM due d LEFT JOIN n USING (account, since)""")
def backfill_journal(spark, sf):
    return _backfill(spark, sf)[1].select("account", "since", "n_new", "n_skipped", "error")


def _bars(symbols: list[str]) -> list[dict]:
    """Two bars a symbol; a batch that holds 13 fails, symbol 7 has none."""
    if "13" in symbols:
        raise ConnectionError("lost")
    return [{"symbol": s, "bar_date": date(2024, 1, 1 + k), "open": float(s), "high": float(s) + 1, "low": float(s) - 1, "close": float(s) + k, "volume": 100.0 * k} for s in symbols if s != "7" for k in (1, 2)]


def _symbols(spark, sf):
    return S.table(spark, sf, "supplier").select(F.col("s_suppkey").cast("string").alias("symbol"))


@query("""SELECT CAST(s_suppkey AS VARCHAR) AS symbol, DATE '2024-01-01' + k::INTEGER AS bar_date, s_suppkey::DOUBLE AS open, s_suppkey + 1.0::DOUBLE AS high, s_suppkey - 1.0::DOUBLE AS low, (s_suppkey + k)::DOUBLE AS close, 100.0::DOUBLE * k AS volume
FROM supplier, (VALUES (1), (2)) AS t(k) WHERE s_suppkey NOT IN (7, 13)""")
def fetch_bars(spark, sf):
    """One symbol after another; the failing one leaves the others alone."""
    return C.fetched_bars(_symbols(spark, sf), _bars, batch=1)[0]


@query("SELECT CAST(s_suppkey AS VARCHAR) AS symbol, 'ConnectionError: lost' AS error FROM supplier WHERE s_suppkey = 13")
def fetch_bars_errors(spark, sf):
    return C.fetched_bars(_symbols(spark, sf), _bars, batch=1)[1]


@query("SELECT CAST(s_suppkey AS VARCHAR) AS symbol, s_suppkey % 3 <> 0 AS valid FROM supplier")
def validate_contracts(spark, sf):
    return C.validated(_symbols(spark, sf), lambda group: [s for s in group if int(s) % 3])


@query("""SELECT CAST(s_suppkey AS VARCHAR) AS ticker, CASE WHEN s_suppkey % 2 = 0 THEN 'Stored' WHEN s_suppkey % 5 = 0 THEN 'Other' ELSE 'Found' END AS sector, CASE WHEN s_suppkey % 2 = 0 THEN 'mega' WHEN s_suppkey % 5 = 0 THEN 'unknown' ELSE 'small' END AS market_cap_bucket FROM supplier""")
def metadata_read_through(spark, sf):
    """Stored metadata, written as JSON and read again; the rest is looked up."""

    def lookup(ticker: str) -> tuple[str, str]:
        if int(ticker) % 5 == 0:
            raise LookupError(ticker)
        return "Found", "small"

    tickers = _symbols(spark, sf).withColumnRenamed("symbol", "ticker")
    stored, path = tickers.where("cast(ticker as long) % 2 = 0").select("ticker", F.lit("Stored").alias("sector"), F.lit("mega").alias("market_cap_bucket")), scratch_path(spark, "metadata-json")
    sinks.write_metadata(stored, path)
    return C.with_metadata(tickers, raw.read_metadata_rows(spark, path), lookup)


@pytest.mark.parametrize("name", sorted(PLAYED))
def test_crawls_of_a_played_service_equal_sql(spark, sf, duck, same, name):
    run, sql = PLAYED[name]
    same(run(spark, sf).toPandas(), duck(sf, sql))


def test_connections_are_closed_and_the_service_is_tried(spark, tmp_path):
    log = str(tmp_path / "log")

    class Line:
        def __init__(self):
            open(log, "a").write("open ")

        def close(self):
            open(log, "a").write("closed ")

    def use(line, symbols):
        if "B" in symbols:
            raise OSError("lost")
        return [{"symbol": s, "bar_date": date(2024, 1, 1), **dict.fromkeys(("open", "high", "low", "close", "volume"), 1.0)} for s in symbols]

    bars, errors = C.fetched_bars(spark.createDataFrame([("A",), ("B",), ("C",)], "symbol string"), C.connected(Line, use), batch=1, one_by_one=True)
    assert {x.symbol for x in bars.collect()} == {"A", "C"} and [x.error for x in errors.collect()] == ["OSError: lost"]
    assert open(log).read().split() == ["open", "closed"] * 3
    assert C.reachable(page, "11") == "OSError: no such account" and C.reachable(page, "1") is None


def test_preloaded_bars(spark):
    bars = spark.createDataFrame([("A", 1), ("B", 2), ("A", 3)], "symbol string, close int")
    store = raw.PreloadedBars(bars)
    assert store.in_memory("A").collect() == [] and store.of("A").count() == 2
    assert store.preload(spark.createDataFrame([("A",), (None,), ("Z",)], "symbol string")).count() == 2
    assert store.held.is_cached and store.in_memory("B").collect() == [] and store.of("B").count() == 1 and store.in_memory("A").count() == 2
    store.release()
    assert store.held is None


def test_landed_metadata_is_joined_and_asked_in_many_tasks(spark):
    tickers = spark.createDataFrame([("A",), ("B",), ("B",), ("C",), ("D",), (None,)], "ticker string")
    names = "ticker string, sector string, market_cap_bucket string"
    stored = spark.createDataFrame([("A", "Stored", "mega")], names)
    there = spark.createDataFrame([("A", "New", "small"), ("B", "Found", None), ("D", "Two", "y"), ("D", "One", "x"), (None, "No", "no")], names)
    got = C.with_metadata(tickers, stored, there).collect()
    assert {tuple(x) for x in got} == {("A", "Stored", "mega"), ("B", "Found", None), ("C", "Other", "unknown"), ("D", "One", "x")} and len(got) == 4
    # A function is asked in as many tasks as a shuffle has, however small they are.
    where = C.with_metadata(spark.range(100).select(F.col("id").cast("string").alias("ticker")), stored, lambda t: (str(TaskContext.get().partitionId()), t))
    assert len({r[1] for r in where.collect() if r[1] != "Stored"}) == int(spark.conf.get("spark.sql.shuffle.partitions"))
