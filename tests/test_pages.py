"""Landed pages: the data source, its stretches of files, streams that start again."""

import json

import pytest
from pyspark.sql import functions as F

from tidemark.plans import landed_queries as Q
from tidemark.sources import crawl, pages
from tidemark.streaming.ingest import sync_landed


def folder(tmp_path, number, files, done=True):
    where = tmp_path / f"landed={number}"
    where.mkdir(parents=True)
    for name, text in files.items():
        (where / name).write_bytes(text)
    if done:
        (where / "_SUCCESS").touch()


@pytest.mark.parametrize("size", [1, 3, 7, 10, 64, 1 << 20])
def test_every_line_is_read_once_however_files_are_cut(tmp_path, size):
    lines = [b"a", b"", b"bb b", "é".encode() * 9, b"x" * 40, b"last"]
    folder(tmp_path, 2, {"part-0": b"\n".join(lines), "part-1": b"one\n", "part-2": b"", "_skip": b"no\n", ".crc": b"no\n"})
    folder(tmp_path, 3, {"part-0": b"not yet\n"}, done=False)
    folder(tmp_path, 10, {"part-0": b"\n\nten\n"})
    assert pages.landings(str(tmp_path)) == [2, 10] and pages.landings(str(tmp_path / "none")) == []
    got = []
    for s in pages.stretches(str(tmp_path), [2, 10], size):
        for b in pages.lines(str(tmp_path), s):
            got += zip(*(b.column(k).to_pylist() for k in range(4)), strict=True)
    want, at = [], 0
    for line in lines:
        want += [(2, "part-0", at, line.decode())] if line else []
        at += len(line) + 1
    assert sorted(got) == sorted([*want, (2, "part-1", 0, "one"), (10, "part-0", 2, "ten")])


def test_a_stretch_is_read_in_blocks(tmp_path, monkeypatch):
    """A task holds a block, not its stretch; lines longer than a block are whole."""
    texts = [b"%d " % k + b"x" * (k % 90) for k in range(3000)] + [b"y" * 70_000, b"z" * 500, b"end"]
    folder(tmp_path, 1, {"part-0": b"\n".join(texts)})
    monkeypatch.setattr(pages, "BLOCK", 1000, raising=False)
    for size in (777, 50_000, 1 << 30):
        batches = [b.column(3).to_pylist() for s in pages.stretches(str(tmp_path), [1], size) for b in pages.lines(str(tmp_path), s)]
        assert [x for b in batches for x in b] == [x.decode() for x in texts]
        assert max(sum(map(len, b)) for b in batches if max(map(len, b)) < 1000) <= 3000


def land(tmp_path, number, rows):
    folder(tmp_path, number, {"part-0": b"".join(json.dumps(x).encode() + b"\n" for x in rows)})


def tweet(i):
    return {"id": str(i), "createdAt": f"Wed Jan {10 + i:02d} 10:00:00 +0000 2024", "text": f"tweet {i} on $ABC, which is long enough to count"}


def test_a_stream_goes_on_where_it_stopped(spark, tmp_path):
    path, store = str(tmp_path / "in"), str(tmp_path / "out")
    land(tmp_path / "in", 1, [{"account": "a", "page": 0, "tweets": [tweet(3), tweet(2)]}, {"account": "b", "page": 0, "error": "lost"}, "no page"])
    sync_landed(spark, path, store, str(tmp_path / "cp")).awaitTermination()
    raw = lambda: {(x.id, x.batch) for x in spark.read.parquet(f"{store}/raw").collect()}
    assert raw() == {("3", 0), ("2", 0)}
    sync_landed(spark, path, store, str(tmp_path / "cp")).awaitTermination()
    assert raw() == {("3", 0), ("2", 0)}
    # A known tweet and a late one; the failed page comes again.
    land(tmp_path / "in", 2, [{"account": "a", "page": 0, "data": {"tweets": [tweet(4), tweet(3), tweet(1)]}}])
    land(tmp_path / "in", 5, [{"account": "b", "page": 0, "tweets": [tweet(9)]}])
    folder(tmp_path / "in", 6, {"part-0": b"half written"}, done=False)
    sync_landed(spark, path, store, str(tmp_path / "cp")).awaitTermination()
    assert {i for i, _ in raw()} == {"3", "2", "4", "1", "9"}
    assert spark.read.parquet(f"{store}/processed").where("ticker = 'ABC'").count() == 5


def test_crawls_of_odd_pages(spark, tmp_path):
    rows = [
        {"account": "a", "page": 0, "tweets": [tweet(5), tweet(4), tweet(4), {"text": "no id"}]},
        {"account": "a", "page": 1, "tweets": [tweet(4), tweet(3)]},
        {"account": "b", "page": 0, "tweets": []},
        {"account": "c", "page": 0, "tweets": [tweet(8)]},
        {"account": "c", "page": 1, "error": "lost"},
        {"account": "c", "page": 2, "tweets": [tweet(7)]},
        {"account": None, "page": 0, "tweets": [tweet(6)]},
    ]
    land(tmp_path, 1, rows)
    read = pages.read_landed(spark, str(tmp_path), taskBytes=50)
    ids = lambda df: sorted((x.account or "", x.id or x.error) for x in df.collect())
    assert ids(pages.crawl(read)) == [("", "6"), ("a", "3"), ("a", "4"), ("a", "5"), ("c", "8"), ("c", "lost")]
    assert ids(pages.crawl(read, most=1)) == [("", "6"), ("a", "5"), ("c", "8")]
    known = spark.createDataFrame([("4",)], "id string")
    assert ids(pages.crawl(read, known)) == [("", "6"), ("a", "5"), ("c", "8"), ("c", "lost")]
    assert pages.read_landed(spark, str(tmp_path / "none")).collect() == []
    assert pages.crawl(pages.read_landed(spark, str(tmp_path), after=1)).collect() == []


def test_pages_are_tried_again(spark, tmp_path):
    asked = str(tmp_path / "asked")

    def page(account, cursor):
        with open(asked, "a+") as f:
            f.write("x")
            f.seek(0)
            if len(f.read()) < 3:
                raise TimeoutError("again")
        return [{"id": "1", "createdAt": None}], None

    accounts = spark.createDataFrame([("a",)], "account string")
    assert [x.id for x in crawl.crawled(accounts, page, retries=3).collect()] == ["1"]


def test_a_range_with_a_failed_page_leaves_nothing(spark, sf):
    new, journal = Q.P.search(Q._ranges(spark, sf), Q.landed(spark, sf))
    bad = {x.account for x in journal.where("error is not null").collect()}
    assert bad and not bad & {x.account for x in new.select(F.col("account")).collect()}
