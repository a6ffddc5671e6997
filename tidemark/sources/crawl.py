"""Crawling through pluggable functions: pages, date ranges, backfill days, bars, metadata.

A crawl goes page by page: each round fetches the next page of every open account in tasks
of their own, saves it, and decides by joins on the stored ids which accounts go on.  What a
round has saved stays when a later one fails, and no account's failure stops another's.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator
from contextlib import closing
from datetime import date

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.timezones import api_time
from ..scratch import saved, scratch_path

#: ``page(account, cursor)``: tweets, newest first, and the next cursor (None: no more).
Page = Callable[[str, str | None], tuple[list[dict], str | None]]
#: ``search(account, since, until, cursor)``: the same for a range, ``until`` excluded.
Search = Callable[[str, date, date, str | None], tuple[list[dict], str | None]]
ROW = "account string, id string, created string, json_data string"
PAGE_ROW = f"{ROW}, place int, next_cursor string, error string, cursor string"


def _batch(rows: list[tuple], kinds: list[pa.DataType], names: list[str]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[] for _ in names]
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds, strict=True)], names=names)


def reachable(page: Page, account: str) -> str | None:
    """Why the service doesn't answer for ``account``, or None if it does."""
    try:
        page(account, None)
    except Exception as e:
        return f"{type(e).__name__}: {e}"
    return None


def connected(connect: Callable, use: Callable) -> Callable[[list[str]], list[dict]]:
    """``fetch(symbols)`` for ``fetched_bars`` that opens a connection for each batch of
    symbols (``connect()``, where the task runs), uses it and closes it in any case."""

    def fetch(symbols: list[str]) -> list[dict]:
        with closing(connect()) as connection:
            return use(connection, symbols)

    return fetch


def _tried(page: Page, account: str, cursor: str | None, retries: int, pause: float) -> tuple[list[dict], str | None]:
    for left in range(retries - 1, -1, -1):
        try:
            return page(account, cursor)
        except Exception:
            if not left:
                raise
            time.sleep(pause)


def _fetched(open_accounts: DataFrame, page: Page, pause: float, retries: int) -> DataFrame:
    """One page of each ``(account, cursor)``; an empty or failed one is a row without an id."""
    kinds = [*[pa.string()] * 4, pa.int32(), *[pa.string()] * 3]
    names = [x.split()[0] for x in PAGE_ROW.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for account, cursor in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    tweets, after = _tried(page, account, cursor, retries, pause)
                    rows = [(account, t["id"], t.get("createdAt"), json.dumps(t), k, after, None, cursor) for k, t in enumerate(tweets)]
                except Exception as e:  # one account's failure is data, not the job's end
                    rows, after = [(account, None, None, None, 0, None, f"{type(e).__name__}: {e}", cursor)], None
                yield _batch(rows or [(account, None, None, None, 0, None, None, cursor)], kinds, names)
                time.sleep(pause)

    return open_accounts.select("account", "cursor").repartition("account").mapInArrow(run, PAGE_ROW)


def crawled(accounts: DataFrame, page: Page, known: DataFrame | None = None, until: date | None = None, most: int | None = None, cursors: DataFrame | None = None, pause: float = 0.0, retries: int = 1) -> DataFrame:
    """``(account, id, created, json_data, error, cursor)``: new tweets of all accounts.

    ``cursor`` is that of the row's page, so an error's is where to resume.
    Without ``until`` an account is crawled up to its first known id; with it known ids are
    skipped, and the crawl ends with the page that holds an older tweet (its older tweets go).
    It also ends with ``most`` new tweets, without a next cursor, on an empty page, and on an
    error of the ``retries``-th try, which is a row without an id.  A crawl goes on while any
    account has a next cursor.  ``cursors`` ``(account, cursor)`` resume a crawl; ``pause``
    seconds lie between two requests of a task.

    Each round's rows are appended to one folder, which later rounds read for known ids.
    """
    spark = accounts.sparkSession
    known = saved(known.select(F.col("id").alias("known_id")).distinct(), "known") if known is not None else spark.createDataFrame([], "known_id string")
    state = accounts.select("account").distinct()
    state = state.join(cursors, "account", "left") if cursors is not None else state.withColumn("cursor", F.lit(None).cast("string"))
    state = saved(state.withColumn("found", F.lit(0).cast("long")), "crawl-state")
    folder, number, schema = scratch_path(spark, "crawl"), 0, None
    while True:
        pages = saved(_fetched(state, page, pause, retries), "pages")
        seen = F.col("known_id").isNotNull()
        old = (F.to_date(api_time(F.col("created"))) < F.lit(until)) if until else F.lit(False)
        before = known if schema is None else known.unionByName(spark.read.schema(schema).parquet(f"{folder}/*").where("fresh").select(F.col("id").alias("known_id")))
        marked = pages.join(before.distinct(), F.col("id") == F.col("known_id"), "left").withColumns({"seen": seen, "old": F.coalesce(old, F.lit(False))})
        marked = marked.join(state.select("account", "found"), "account")
        order = Window.partitionBy("account").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
        ended = F.max(F.col("seen") | F.col("old")).over(order) if until is None else F.col("seen") | F.col("old")
        kept = marked.withColumn("fresh", F.col("id").isNotNull() & ~ended)
        kept = kept.withColumn("number", F.col("found") + F.sum(F.col("fresh").cast("long")).over(order))
        if most:
            kept = kept.withColumn("fresh", F.col("fresh") & (F.col("number") <= most))
        kept.write.mode("overwrite").parquet(f"{folder}/round-{number}")
        schema = kept.schema
        kept = spark.read.schema(schema).parquet(f"{folder}/round-{number}")
        number += 1
        stop = F.max("old") if until else F.max("seen")
        after = kept.groupBy("account").agg(F.max("next_cursor").alias("cursor"), F.max("number").alias("found"), stop.alias("stop"))
        after = after.where("not stop and cursor is not null" + (f" and found < {most}" if most else ""))
        state = saved(after.select("account", "cursor", "found"), "crawl-state")
        if state.isEmpty():
            return spark.read.schema(schema).parquet(f"{folder}/*").where("fresh or error is not null").select("account", "id", "created", "json_data", "error", "cursor")


def searched(ranges: DataFrame, search: Search, known: DataFrame | None = None, retries: int = 3, pause: float = 0.0) -> tuple[DataFrame, DataFrame]:
    """New tweets ``(account, since, id, created, json_data)`` of ``(account, since, until)``
    ranges, and a journal ``(account, since, until, calls, n_new, n_skipped, error)``.

    A range counts as a whole: its pages are fetched in one task, ``retries`` times at most,
    and only if all of them come do its tweets count, so a failure leaves nothing half done.
    Tweets of known ids, and repeated ones, are skipped and counted.
    """
    kinds = [pa.string(), pa.date32(), pa.date32(), *[pa.string()] * 3, pa.int32(), pa.string()]
    names = ["account", "since", "until", "id", "created", "json_data", "calls", "error"]

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for account, since, until in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                calls, rows, error = 0, [], None
                for _ in range(retries):
                    rows, cursor, error = [], None, None
                    try:
                        while True:
                            calls += 1
                            tweets, cursor = search(account, since, until, cursor)
                            rows += [(account, since, until, t["id"], t.get("createdAt"), json.dumps(t), None, None) for t in tweets]
                            time.sleep(pause)
                            if cursor is None or not tweets:
                                break
                        break
                    except Exception as e:
                        rows, error = [], f"{type(e).__name__}: {e}"
                yield _batch([*rows, (account, since, until, None, None, None, calls, error)], kinds, names)

    got = ranges.select("account", "since", "until").repartition("account", "since").mapInArrow(run, "account string, since date, until date, id string, created string, json_data string, calls int, error string")
    got = saved(got, "searched")
    tweets = got.where("id is not null")
    first = F.min_by(F.struct("account", "since", "created", "json_data"), F.struct("account", "since"))
    once = tweets.groupBy("id").agg(first.alias("t")).select("t.account", "t.since", "id", "t.created", "t.json_data")
    if known is not None:
        once = once.join(known.select("id"), "id", "left_anti")
    once = saved(once.select("account", "since", "id", "created", "json_data"), "new-tweets")
    counts = once.groupBy("account", "since").agg(F.count("*").alias("n_new"))
    totals = tweets.groupBy("account", "since").agg(F.count("*").alias("n"))
    journal = got.where("id is null").select("account", "since", "until", "calls", "error").join(totals, ["account", "since"], "left").join(counts, ["account", "since"], "left")
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("n", "n_new")}
    return once, journal.select("account", "since", "until", "calls", zero["n_new"].cast("long").alias("n_new"), (zero["n"] - zero["n_new"]).cast("long").alias("n_skipped"), "error")


def backfilled(accounts: DataFrame, journal: DataFrame, search: Search, first: date, today: date, known: DataFrame | None = None, retries: int = 3) -> tuple[DataFrame, DataFrame]:
    """New tweets and journal of the days from ``first`` to yesterday that ``journal`` lacks.

    Each (account, day) commits as a whole; today isn't over and is left out, days that
    failed have an error in the journal, and only those without one are done.
    """
    days = accounts.select("account").distinct().withColumn("since", F.explode(F.sequence(F.lit(first), F.date_sub(F.lit(today), 1)))) if first < today else accounts.select("account").withColumn("since", F.lit(first)).limit(0)
    days = days.join(journal.select("account", F.col("fetch_date").alias("since")), ["account", "since"], "left_anti")
    return searched(days.withColumn("until", F.date_add("since", 1)), search, known, retries)


def fetched_bars(symbols: DataFrame, fetch: Callable[[list[str]], list[dict]], intraday: bool = False, batch: int = 50, pause: float = 0.0, one_by_one: bool | None = None) -> tuple[DataFrame, DataFrame]:
    """Bars of all symbols, and ``(symbol, error)`` of those that failed.

    ``fetch(symbols)`` returns bars as dicts with lower-case names; symbols go in batches of
    ``batch``, and a batch that raises fails as a whole.  ``one_by_one`` (None: for intraday
    bars): all batches go through one task, in order of their symbols, so that ``pause`` lies
    between any two requests of the job; only names and bars pass through it.
    """
    time_name = "bar_ts" if intraday else "bar_date"
    kind, stamp = ("timestamp", pa.timestamp("us", tz="UTC")) if intraday else ("date", pa.date32())
    fields = ("open", "high", "low", "close", "volume")
    names, kinds = ["symbol", time_name, *fields, "error"], [pa.string(), stamp, *[pa.float64()] * 5, pa.string()]

    def run(batches: Iterator[pa.RecordBatch]):
        for part in batches:
            for group in part.column(1).to_pylist():
                try:
                    rows = [(b["symbol"], b[time_name], *(b[f] for f in fields), None) for b in fetch(group)]
                except Exception as e:
                    rows = [(s, None, *[None] * 5, f"{type(e).__name__}: {e}") for s in group]
                if rows:
                    yield _batch(rows, kinds, names)
                time.sleep(pause)

    # Batches by a hash, so that no table of all symbols is numbered in one task.
    named = symbols.select("symbol").where("symbol is not null").distinct()
    groups = max(1, -(-named.count() // batch))
    dealt = named.groupBy(F.pmod(F.xxhash64("symbol"), F.lit(groups)).alias("number")).agg(F.sort_array(F.collect_list("symbol")).alias("all"))
    cut = F.transform(F.sequence(F.lit(0), F.floor((F.size("all") - 1) / batch).cast("int")), lambda k: F.slice("all", k * batch + 1, F.lit(batch)))
    asked = dealt.select("number", F.explode(cut).alias("symbols"))
    if intraday if one_by_one is None else one_by_one:
        asked = asked.repartition(1).sortWithinPartitions("symbols")
    got = saved(asked.mapInArrow(run, f"symbol string, {time_name} {kind}, open double, high double, low double, close double, volume double, error string"), "fetched-bars")
    return got.where("error is null").drop("error"), got.where("error is not null").select("symbol", "error")


def validated(symbols: DataFrame, check: Callable[[list[str]], list[str]], batch: int = 50) -> DataFrame:
    """``(symbol, valid)``: whether ``check(symbols)`` returns it; a batch that raises is invalid."""

    def fetch(group: list[str]) -> list[dict]:
        return [{"symbol": s, "bar_date": None, **dict.fromkeys(("open", "high", "low", "close", "volume"))} for s in check(group)]

    good, _ = fetched_bars(symbols, fetch, batch=batch)
    good = good.select("symbol").distinct().withColumn("valid", F.lit(True))
    return symbols.select("symbol").distinct().join(good, "symbol", "left").withColumn("valid", F.coalesce("valid", F.lit(False)))


def with_metadata(tickers: DataFrame, stored: DataFrame, lookup: Callable[[str], tuple[str, str]] | DataFrame) -> DataFrame:
    """``(ticker, sector, market_cap_bucket)``: stored, or looked up where it isn't.

    ``lookup`` is a function that is asked for one ticker after another, or a table of landed
    answers, which is joined; of answers that share a ticker the least row counts.  A lookup
    that fails says Other and unknown, and is stored like any other answer.
    """
    names = ["ticker", "sector", "market_cap_bucket"]
    missing = tickers.select("ticker").where("ticker is not null").distinct().join(stored.select("ticker"), "ticker", "left_anti")
    if isinstance(lookup, DataFrame):
        answers = lookup.groupBy("ticker").agg(F.min(F.struct(*names[1:])).alias("m"))
        none = F.col("m").isNull()
        found = missing.join(answers, "ticker", "left").select("ticker", F.when(none, "Other").otherwise(F.col("m.sector")).alias("sector"), F.when(none, "unknown").otherwise(F.col("m.market_cap_bucket")).alias("market_cap_bucket"))
        return stored.select(*names).unionByName(saved(found, "metadata"))

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            rows = []
            for ticker in batch.column(0).to_pylist():
                try:
                    rows.append((ticker, *lookup(ticker)))
                except Exception:
                    rows.append((ticker, "Other", "unknown"))
            yield _batch(rows, [pa.string()] * 3, names)

    # By number and by a hash of its own, or AQE puts these small rows together in one task.
    missing = missing.repartition(int(tickers.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.xxhash64("ticker"))
    return stored.select(*names).unionByName(saved(missing.mapInArrow(run, "ticker string, sector string, market_cap_bucket string"), "metadata"))
