"""Landed pages of a tweet API: a Spark data source for batches and streams, and crawls over
what has landed.

A landing is a folder ``landed=<number>`` of JSON lines, a page each, that counts once its
``_SUCCESS`` file is there.  The data source gives pages as text with their place; a stream's
offset is the number of the last landing it has read, so the checkpoint is the resume cursor.
Crawls, searches and backfills are joins and sums over the pages: no account is followed
page by page, and none of its tweets are gathered in one task.
"""

from __future__ import annotations

import posixpath
import re
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import date

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from ..functions.once import once
from ..functions.timezones import api_time

#: Bytes of pages that one task reads, about.
TASK_BYTES = 64 << 20
#: Bytes that are read at once.
BLOCK = 1 << 20
PAGES = "landed long, file string, at long, page string"
#: A page; tweets stay text.
PAGE = "account string, page int, day string, error string, next_cursor string, has_next_page boolean, tweets array<string>, data struct<tweets: array<string>>"


@dataclass
class Stretch(InputPartition):
    """Bytes ``lo`` to ``hi`` of files: lines that begin there."""

    files: list[tuple[int, str, int, int]]


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def landings(path: str) -> list[int]:
    """The numbers of complete landings, rising."""
    store, root = _opened(path)
    found = store.get_file_info(fs.FileSelector(root, allow_not_found=True))
    numbers = [(int(m[1]), x.path) for x in found if (m := re.fullmatch(r"landed=(\d+)", posixpath.basename(x.path)))]
    done = store.get_file_info([f"{p}/_SUCCESS" for _, p in numbers])
    return sorted(n for (n, _), mark in zip(numbers, done, strict=True) if mark.type == fs.FileType.File)


def stretches(path: str, numbers: list[int], task_bytes: int) -> list[Stretch]:
    """The files of landings, cut where they are long and put together where they are short."""
    store, root = _opened(path)
    out, held, size = [], [], 0
    for n in numbers:
        for x in sorted(store.get_file_info(fs.FileSelector(f"{root}/landed={n}", recursive=True)), key=lambda x: x.path):
            if x.type != fs.FileType.File or posixpath.basename(x.path)[0] in "_.":
                continue
            for lo in range(0, x.size, task_bytes):
                part = (n, x.path, lo, min(x.size, lo + task_bytes))
                if held and size + part[3] - lo > task_bytes:
                    out.append(Stretch(held))
                    held, size = [], 0
                held.append(part)
                size += part[3] - lo
    return [*out, Stretch(held)] if held else out


def _blocks(f, lo: int, hi: int) -> Iterator[tuple[list[int], list[bytes]]]:
    """Places and lines of those lines that begin from ``lo`` to ``hi``, about a block at a time."""
    # The byte before tells whether a line begins at ``lo``.
    at = pos = max(0, lo - 1)
    f.seek(at)
    held = bytearray()
    while at < hi:
        more = f.read(min(BLOCK, hi - pos) if pos < hi else 1 << 16)
        pos += len(more)
        end = more.rfind(b"\n") + 1
        if more and not end:
            held += more
            continue
        places, rows = [], []
        for line in (bytes(held) + more[: end - 1] if more else bytes(held)).split(b"\n"):
            if lo <= at < hi and line.strip():
                places.append(at)
                rows.append(line)
            at += len(line) + 1
        held = bytearray(more[end:])
        if rows:
            yield places, rows
        if not more:
            return


def lines(path: str, stretch: Stretch) -> Iterator[pa.RecordBatch]:
    """The lines of a stretch; of a file no more than a block and its longest line is held."""
    store, _ = _opened(path)
    for number, file, lo, hi in stretch.files:
        with store.open_input_file(file) as f:
            for places, rows in _blocks(f, lo, hi):
                columns = [pa.array([number] * len(rows), pa.int64()), pa.array([posixpath.basename(file)] * len(rows)), pa.array(places, pa.int64()), pa.array(rows, pa.binary()).cast(pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=["landed", "file", "at", "page"])


class _Landed:
    def __init__(self, options):
        self.path, self.task_bytes = options["path"], int(options.get("taskBytes", TASK_BYTES))
        self.after = int(options.get("after", -1))

    def read(self, partition: Stretch) -> Iterator[pa.RecordBatch]:
        return lines(self.path, partition)


class _Batch(_Landed, DataSourceReader):
    def partitions(self) -> list[InputPartition]:
        return stretches(self.path, [n for n in landings(self.path) if n > self.after], self.task_bytes) or [Stretch([])]


class _Stream(_Landed, DataSourceStreamReader):
    def initialOffset(self) -> dict:
        return {"landed": self.after}

    def latestOffset(self) -> dict:
        return {"landed": max([self.after, *landings(self.path)])}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        numbers = [n for n in landings(self.path) if start["landed"] < n <= end["landed"]]
        return stretches(self.path, numbers, self.task_bytes) or [Stretch([])]


class LandedPages(DataSource):
    """``format("landed_pages")``: options ``path``, ``after`` (a landing's number; only later
    ones are read) and ``taskBytes``.  A folder without landings has no rows."""

    @classmethod
    def name(cls) -> str:
        return "landed_pages"

    def schema(self) -> str:
        return PAGES

    def reader(self, schema) -> DataSourceReader:
        return _Batch(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Stream(self.options)


def land(pages: DataFrame, path: str, number: int) -> None:
    """Write ``pages`` as landing ``number``; a repetition takes the place of the first one."""
    pages.write.mode("overwrite").json(f"{path.rstrip('/')}/landed={number}")


def read_landed(spark: SparkSession, path: str, stream: bool = False, **options) -> DataFrame:
    """Landed pages as ``(landed, account, page, day, error, next_cursor, tweets)``."""
    spark.dataSource.register(LandedPages)
    source = (spark.readStream if stream else spark.read).format("landed_pages").options(**options).load(path=path)
    return parsed(source)


def parsed(pages: DataFrame) -> DataFrame:
    """Pages of JSON text; unreadable ones are left out, those without an account have an empty one."""
    p = pages.select("landed", once(F.from_json("page", PAGE)).alias("p")).where("p is not null")
    return p.select("landed", F.coalesce("p.account", F.lit("")).alias("account"), "p.page", F.col("p.day").cast("date").alias("day"), "p.error", "p.next_cursor", F.coalesce("p.tweets", "p.data.tweets", F.array().cast("array<string>")).alias("tweets"))


def latest(pages: DataFrame) -> DataFrame:
    """Of pages that landed more than once (a failed one that was fetched again) the last."""
    newest = pages.groupBy("account", "page", "day").agg(F.max_by(F.struct("error", "next_cursor", "tweets"), F.struct("landed", F.col("error").isNull())).alias("p"))
    return newest.select("account", "page", "day", "p.*")


def tweets_of(pages: DataFrame) -> DataFrame:
    """``(account, page, day, place, id, created, json_data)``, one row per tweet."""
    # Pages without tweets go with the null ids: a test of their arrays would parse the pages again.
    each = pages.select("account", "page", "day", F.posexplode_outer("tweets").alias("place", "json_data"))
    body = once(F.from_json("json_data", "id string, createdAt string"))
    return each.withColumn("b", body).select("account", "page", "day", "place", "b.id", F.col("b.createdAt").alias("created"), "json_data").where("id is not null")


def texts_of(pages: DataFrame) -> DataFrame:
    """``(json_data)``, one row per tweet; a page without tweets has a null."""
    return pages.select(F.explode_outer("tweets").alias("json_data"))


def _known(known: DataFrame | None, rows: DataFrame) -> DataFrame:
    if known is None:
        return rows.withColumn("seen", F.lit(False))
    ids = known.select(F.col("id").alias("known_id")).distinct()
    return rows.join(ids, F.col("id") == F.col("known_id"), "left").withColumn("seen", F.col("known_id").isNotNull()).drop("known_id")


def crawl(pages: DataFrame, known: DataFrame | None = None, until: date | None = None, most: int | None = None, cursors: DataFrame | None = None) -> DataFrame:
    """``(account, id, created, json_data, error)``: new tweets of all accounts' pages.

    Pages are numbered from the newest on and tweets in a page lie newest first.  Without
    ``until`` an account ends with its first known id; with it known ids are skipped, and the
    crawl ends with the page that holds an older tweet (its older tweets go).  A failed page
    ends the account and is a row without an id.  ``most``: so many new tweets of an account
    at most; ``cursors`` ``(account, cursor)``: only pages from that number on.  Ids that pages
    repeat come once, from the first page; null ids are left out.
    """
    pages = latest(pages)
    if cursors is not None:
        pages = pages.join(cursors.select("account", F.col("cursor").cast("int").alias("from_page")), "account", "left").where("from_page is null or page >= from_page").drop("from_page")
    failed = pages.where("error is not null").groupBy("account").agg(F.min_by(F.struct("page", "error"), "page").alias("f")).select("account", F.col("f.page").alias("failed_page"), "f.error")
    rows = _known(known, tweets_of(pages)).withColumn("pos", F.struct("page", "place"))
    once = rows.groupBy("account", "id").agg(F.min_by(F.struct("pos", "created", "json_data", "seen"), "pos").alias("r")).select("account", "id", "r.*")
    old = F.to_date(api_time(F.col("created"))) < F.lit(until) if until else F.lit(False)
    once = once.withColumn("old", F.coalesce(old, F.lit(False)))
    ends = once.groupBy("account").agg(
        F.min(F.when(F.col("seen"), F.col("pos")) if until is None else F.lit(None).cast("struct<page: int, place: int>")).alias("stop"),
        F.min(F.when(F.col("old"), F.col("pos.page"))).alias("last_page"),
    )
    ends = ends.join(failed, "account", "full_outer")
    kept = once.join(ends.drop("error"), "account", "left")
    kept = kept.where("not seen and not old and (stop is null or pos < stop) and (last_page is null or pos.page <= last_page) and (failed_page is null or pos.page < failed_page)")
    if most is not None:
        # Counted by pages first, so that only a page's tweets are ranked together.
        each = kept.groupBy("account", "pos.page").agg(F.count("*").alias("n"))
        before = F.sum("n").over(Window.partitionBy("account").orderBy("page").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
        each = each.select("account", F.col("page").alias("page_number"), before.alias("before")).where(F.col("before") < most)
        kept = kept.join(each.withColumnRenamed("account", "of"), (F.col("account") == F.col("of")) & (F.col("pos.page") == F.col("page_number")))
        rank = F.row_number().over(Window.partitionBy("account", "page_number").orderBy("pos"))
        kept = kept.withColumn("rank", F.col("before") + rank).where(F.col("rank") <= most)
    reached = ends.where("error is not null and (stop is null or failed_page < stop.page) and (last_page is null or failed_page <= last_page)")
    if most is not None:
        full = kept.groupBy("account").agg(F.count("*").alias("n")).where(F.col("n") >= most)
        reached = reached.join(full, "account", "left_anti")
    none = F.lit(None).cast("string")
    return kept.select("account", "id", "created", "json_data", none.alias("error")).unionByName(reached.select("account", none.alias("id"), none.alias("created"), none.alias("json_data"), "error"))


def _asked(ranges: DataFrame) -> DataFrame:
    return ranges.select("account", "since", "until", F.explode(F.sequence("since", F.date_sub("until", 1))).alias("day")).where("day >= since")


def search(ranges: DataFrame, pages: DataFrame, known: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """New tweets ``(account, since, id, created, json_data)`` of ``(account, since, until)``
    ranges (``until`` excluded), and a journal ``(account, since, until, calls, n_new,
    n_skipped, error)``.

    A range counts as a whole: one failed page (that hasn't landed again since) leaves none
    of its tweets.  A range without pages is one call.  Tweets of known ids are skipped and
    counted, and so are those that two ranges share: the least (account, since) has them.
    """
    asked = _asked(ranges.where("since < until"))
    found = asked.join(latest(pages), ["account", "day"])
    state = found.groupBy("account", "since").agg(F.count("*").alias("calls"), F.min("error").alias("error"))
    rows = tweets_of(found.where("error is null").select("account", "page", "day", "tweets", "since").withColumn("account", F.struct("account", "since")))
    rows = rows.select("account.account", "account.since", "id", "created", "json_data").join(state.where("error is not null").select("account", "since"), ["account", "since"], "left_anti")
    per = rows.groupBy("account", "since").agg(F.count("*").alias("n"))
    first = rows.groupBy("id").agg(F.min_by(F.struct("account", "since", "created", "json_data"), F.struct("account", "since")).alias("r")).select("id", "r.*")
    new = _known(known, first).where("not seen").select("account", "since", "id", "created", "json_data")
    fresh = new.groupBy("account", "since").agg(F.count("*").alias("n_new"))
    journal = ranges.select("account", "since", "until").join(state, ["account", "since"], "left").join(per, ["account", "since"], "left").join(fresh, ["account", "since"], "left")
    zero = {c: F.coalesce(c, F.lit(0)).cast("long") for c in ("n", "n_new")}
    return new, journal.select("account", "since", "until", F.greatest(F.coalesce("calls", F.lit(0)), F.lit(1)).cast("long").alias("calls"), zero["n_new"].alias("n_new"), (zero["n"] - zero["n_new"]).alias("n_skipped"), "error")


def backfill(accounts: DataFrame, journal: DataFrame, pages: DataFrame, first: date, today: date, known: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """New tweets and journal of the days from ``first`` to yesterday that ``journal`` lacks.

    Each (account, day) counts as a whole; today isn't over and is left out.
    """
    days = accounts.select("account").distinct().withColumn("since", F.lit(first))
    days = days.withColumn("since", F.explode(F.sequence("since", F.date_sub(F.lit(today), 1)))) if first < today else days.limit(0)
    days = days.join(journal.select("account", F.col("fetch_date").alias("since")), ["account", "since"], "left_anti")
    return search(days.withColumn("until", F.date_add("since", 1)), pages, known)


def page_of(account: Column, page: Column, day: Column, error: Column, next_cursor: Column, tweets: Column) -> list[Column]:
    """The columns of a page as ``land`` writes them."""
    return [account.cast("string").alias("account"), page.cast("int").alias("page"), day.cast("string").alias("day"), error.alias("error"), next_cursor.cast("string").alias("next_cursor"), next_cursor.isNotNull().alias("has_next_page"), tweets.alias("tweets")]
