"""Landed stores as services: functions for ``crawl`` that answer from files all nodes reach."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow.compute as pc
import pyarrow.dataset as ds
from pyarrow import fs

from .pages import _opened


def _dataset(path: str) -> ds.Dataset:
    store, root = _opened(path)
    return ds.dataset(root, filesystem=store, format="parquet", partitioning="hive")


def bar_fetcher(path: str, time: str = "bar_date") -> Callable[[list[str]], list[dict]]:
    """``fetch(symbols)`` from a parquet store partitioned by symbol; one without bars raises."""

    def fetch(symbols: list[str]) -> list[dict]:
        found = _dataset(path).to_table(filter=pc.field("symbol").isin(symbols)).to_pylist()
        if none := sorted(set(symbols) - {r["symbol"] for r in found}):
            raise LookupError(f"no bars of {', '.join(none)}")
        return [{"symbol": str(r["symbol"]), **{c: r[c] for c in (time, "open", "high", "low", "close", "volume")}} for r in found]

    return fetch


def contract_checker(path: str) -> Callable[[list[str]], list[str]]:
    """``check(symbols)``: those of which the store has a folder."""

    def check(symbols: list[str]) -> list[str]:
        store, root = _opened(path)
        from urllib.parse import unquote

        there = {unquote(x.base_name.removeprefix("symbol=")) for x in store.get_file_info(fs.FileSelector(root)) if x.type == fs.FileType.Directory}
        return [s for s in symbols if s in there]

    return check
