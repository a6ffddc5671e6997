"""Shared helpers: workers' memory, vectorised word hashing, names."""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import SparkSession

from ..scratch import clear_scratch, saved, saved_in_steps, scratch_path, scratch_root  # noqa: F401  operators take them from here

U64 = np.uint64


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def fresh(name: str, taken: list[str]) -> str:
    """``name``, or ``name`` and underscores, that no column of ``taken`` has in any case."""
    held = {c.lower() for c in taken}
    while name.lower() in held:
        name += "_"
    return name


# ---------------------------------------------------------------- Python workers

_of_stage: dict = {}


def _new_stage() -> None:
    stage = context.stageId() if (context := TaskContext.get()) else None
    if _of_stage.get("stage") != stage:
        _of_stage.clear()
        _of_stage["stage"] = stage


def kept_in_stage(key: str, make: Callable):
    """``make()``, once for each worker process; the next stage's first task there drops it."""
    _new_stage()
    if key not in _of_stage:
        _of_stage[key] = make()
    return _of_stage[key]


def give_back() -> None:
    """Return memory that was freed to the system, as worker processes outlive their tasks."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def tidy(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A function over batches that leaves nothing of itself, or of an earlier stage, behind."""

    @functools.wraps(run)
    def task(batches):
        _new_stage()
        try:
            yield from run(batches)
        finally:
            give_back()

    return task


# ---------------------------------------------------------------- word hashing

#: The word separators: blank, and tab to carriage return.
SEPARATORS = b"\x20\x09\x0a\x0b\x0c\x0d"


def _random_u64(seed: int, n: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(seed)).integers(1, 2**64, n, dtype=np.uint64)


def _byte_table() -> np.ndarray:
    """A random word for each byte; A-Z share those of a-z, separators count nothing."""
    table = _random_u64(11, 256) | U64(1)
    table[65:91] = table[97:123]
    table[list(SEPARATORS)] = 0
    return table


BYTES = _byte_table()
BLANK = np.isin(np.arange(256), list(SEPARATORS))
MIX = [U64(0xFF51AFD7ED558CCD), U64(0xC4CEB9FE1A85EC53)]
LANES = _random_u64(13, 64) | U64(1)
POSITION = U64(0x9E3779B97F4A7C15)


def finish(h: np.ndarray) -> np.ndarray:
    """Scramble 64-bit words so that each output bit hangs on each input bit."""
    h = h ^ (h >> U64(33))
    h *= MIX[0]
    h ^= h >> U64(33)
    h *= MIX[1]
    h ^= h >> U64(33)
    return h


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the row bounds in it; null rows are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[bounds[0] : bounds[-1]], bounds - bounds[0]


def word_hashes(raw: np.ndarray, bounds: np.ndarray, separators: np.ndarray = BLANK) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words, lower-cased in A-Z, and the row bounds among them.

    A word's hash is the sum over its bytes of table[byte] * odd**position, scrambled.
    ``separators`` says of each byte whether it parts words.
    """
    hashes, at, _, _ = placed_words(raw, bounds, separators)
    return hashes, at


def placed_words(raw: np.ndarray, bounds: np.ndarray, separators: np.ndarray = BLANK) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """As ``word_hashes``, and where words start and how far they and what parts them reach."""
    rows = len(bounds) - 1
    none = np.zeros(0, np.uint64), np.zeros(rows + 1, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    if not len(raw):
        return none
    blank = separators[raw]
    start = ~blank
    at = bounds[:-1][bounds[:-1] < len(raw)]
    first = start[at]
    start[1:] &= blank[:-1]
    start[at] |= first
    starts = np.flatnonzero(start)
    if not len(starts):
        return none
    lengths = np.diff(np.append(starts, len(raw)))
    place = np.arange(starts[0], len(raw), dtype=np.int64)
    place -= np.repeat(starts, lengths)
    powers = np.multiply.accumulate(np.concatenate([[U64(1)], np.full(int(lengths.max()), POSITION)]).astype(np.uint64))
    values = np.where(separators, U64(0), BYTES)[raw[starts[0] :]]
    values *= powers[place]
    return finish(np.add.reduceat(values, starts - starts[0])), np.searchsorted(starts, bounds), starts, lengths


def slices(bounds: np.ndarray, limit: int = 1 << 19):
    """Consecutive row ranges of about ``limit`` bytes each (a longer row stands alone)."""
    i, n = 0, len(bounds) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(bounds, bounds[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def signed(a: np.ndarray) -> np.ndarray:
    return a.view(np.int64)


def ragged_ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices of the ranges [start, start + length), one after another."""
    if not len(lengths) or not lengths.sum():
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(ends[-1], dtype=np.int64) + np.repeat(starts - ends + lengths, lengths)
