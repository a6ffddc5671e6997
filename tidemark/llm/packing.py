"""Best-fit packing of token pieces into sequences.

Only the histogram over lengths (at most ``capacity`` numbers) reaches the driver.  Its
configuration linear program - how many sequences of each filling - is solved by
multiplicative weights: lengths that are covered least weigh most, a knapsack dynamic
program prices the best fillings at these weights, and each is used as far as its scarcest
length allows.  The fractional numbers are rounded to what the pieces allow, the program
is solved again for what is left, and less than a sequence in the end is put into the
rooms.  Pieces then find their place by their number within their length.
"""

from __future__ import annotations

import math
import os
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterable
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import SEPARATORS, give_back, kept_in_stage, placed_words, ragged_ranges, saved, slices, text_buffers, tidy

#: Rows of one length that one numbering group gets at most, more or less.
NUMBER_ROWS = 250_000
#: Words that a worker's cache holds before it starts anew (some 60 bytes each).
CACHE_WORDS = 1_500_000
#: Words that the tokenizer gets at a time.
LEARN_WORDS = 8192
#: Rates of the multiplicative weights, and tokens that handling a piece costs, that are tried
#: until a plan is next to the lower bound.  Of equally full fillings that of few and long
#: pieces is the dearer; a high cost prefers it to fuller ones, which helps where short
#: pieces are scarce.
TRIES = ((0.03, 0.02), (0.03, 2.0), (0.03, 20.0))
#: A plan of this many times the lower bound is good enough not to try on.
GOOD = 1.0005
#: Fillings that one pricing yields, each about another length that coverage lags behind in.
BATCH = 128
#: A filling's step, as a share of what its scarcest length allows: smaller ones, which come
#: closer to the optimum, where there are few lengths and pricing is cheap.
STEP, LEAST_STEP = 0.5, 0.02


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class HashTable:
    """Numbers by 64-bit keys other than 0: open addressing, many keys at a time."""

    def __init__(self, bits: int = 12):
        self.mask, self.held = np.uint64((1 << bits) - 1), 0
        self.keys, self.values = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.int32)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The numbers of ``keys``, -1 for those that aren't held."""
        out, active, slot = np.full(len(keys), -1, np.int64), np.arange(len(keys)), (keys & self.mask).astype(np.int64)
        while len(active):
            at = slot[active]
            held = self.keys[at]
            hit = held == keys[active]
            out[active[hit]] = self.values[at[hit]]
            active = active[~hit & (held != 0)]
            slot[active] = (slot[active] + 1) & int(self.mask)
        return out

    def add(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Hold distinct new keys; the table is half full at most."""
        self.held += len(keys)
        if 2 * self.held > len(self.keys):
            used = self.keys != 0
            keys, values = np.concatenate([self.keys[used], keys]), np.concatenate([self.values[used], values])
            bits = (2 * self.held).bit_length()
            self.mask = np.uint64((1 << bits) - 1)
            self.keys, self.values = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.int32)
        active, slot = np.arange(len(keys)), (keys & self.mask).astype(np.int64)
        while len(active):
            free = active[self.keys[slot[active]] == 0]
            first = free[np.unique(slot[free], return_index=True)[1]]
            self.keys[slot[first]], self.values[slot[first]] = keys[first], values[first]
            active = np.setdiff1d(active, first, assume_unique=True)
            slot[active] = (slot[active] + 1) & int(self.mask)


class WordEncoder:
    """Token ids of whole texts, one tokenizer call for each new run of non-blanks.

    Right for tokenizers that lower-case and whose tokens never reach over ASCII white
    space.  Runs are known by a 64-bit hash that folds A-Z; texts with ``<|``, which may be
    a special token in one case only, are encoded as they are.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.clear()

    @classmethod
    def shared(cls, path: str) -> WordEncoder:
        """This worker process's encoder in this stage, so that tasks find what earlier ones learnt."""
        return kept_in_stage(f"encoder {path}", lambda: cls(path))

    def clear(self) -> None:
        self.table, self.words, self.filled = HashTable(), 0, 0
        self.starts, self.lengths, self.ids = np.zeros(1024, np.int64), np.zeros(1024, np.int64), np.zeros(4096, np.uint32)

    def learn(self, keys: np.ndarray, words: list[str]) -> None:
        for at in range(0, len(words), LEARN_WORDS):  # the tokenizer's own results are large
            self._learn(keys[at : at + LEARN_WORDS], words[at : at + LEARN_WORDS])

    def _learn(self, keys: np.ndarray, words: list[str]) -> None:
        ids = [x.ids for x in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        lengths = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.fromiter(chain.from_iterable(ids), np.uint32, int(lengths.sum()))
        n, m = self.words + len(words), self.filled + len(flat)
        while n > len(self.starts):
            self.starts, self.lengths = np.resize(self.starts, 2 * len(self.starts)), np.resize(self.lengths, 2 * len(self.lengths))
        while m > len(self.ids):
            self.ids = np.resize(self.ids, 2 * len(self.ids))
        self.starts[self.words : n], self.lengths[self.words : n] = self.filled + np.cumsum(lengths) - lengths, lengths
        self.ids[self.filled : m] = flat
        self.table.add(keys, np.arange(self.words, n))
        self.words, self.filled = n, m

    def encode(self, raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the rows of UTF-8 bytes, one row after another, and their bounds."""
        keys, at, starts, reach = placed_words(raw, bounds)
        keys = np.maximum(keys, np.uint64(1))
        if self.words > CACHE_WORDS:
            self.clear()
        code = self.table.find(keys)
        if (new := np.flatnonzero(code < 0)).size:
            fresh, where = np.unique(keys[new], return_index=True)
            data = raw.tobytes()
            words = [data[s : s + n].rstrip(SEPARATORS).decode() for s, n in zip(starts[new[where]].tolist(), reach[new[where]].tolist(), strict=True)]
            self.learn(fresh, words)
            code[new] = self.table.find(keys[new])
        lengths = self.lengths[code]
        ends = np.concatenate([[0], np.cumsum(lengths)])
        return self.ids[ragged_ranges(self.starts[code], lengths)], ends[at]

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)


def pieces(docs: DataFrame, id_col: str, text_col: str, capacity: int, path: str) -> DataFrame:
    """``(doc_id, row, piece, start, length, ids_crc32)``; each document ends with id 0."""

    def run(batches):
        encoder = WordEncoder.shared(path)
        row = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 32
        for batch in batches:
            out: list[list] = [[], [], [], [], [], []]
            raw, bounds = text_buffers(batch.column(1))
            for i, j in slices(bounds):
                part = raw[bounds[i] : bounds[j]]
                ids, at = encoder.encode(part, bounds[i : j + 1] - bounds[i])
                data = part.tobytes()
                special = b"<|" in data
                for k, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True), i):
                    own = ids[a:b]
                    if special and b"<|" in (text := raw[bounds[k] : bounds[k + 1]].tobytes()):
                        own = encoder.whole(text.decode())
                    whole = np.zeros(len(own) + 1, "<u4")
                    whole[:-1] = own
                    for p, start in enumerate(range(0, len(whole), capacity)):
                        piece = whole[start : start + capacity]
                        for column, value in zip(out, (k, row, p, start, len(piece), zlib.crc32(piece.tobytes())), strict=True):
                            column.append(value)
                    row += 1
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(out[0], pa.int64())), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int32()), *(pa.array(c, pa.int64()) for c in out[3:])], names=["doc_id", "row", "piece", "start", "length", "ids_crc32"])

    kind = dict(docs.dtypes)[id_col]
    return docs.select(id_col, text_col).mapInArrow(tidy(run), f"doc_id {kind}, row long, piece int, start long, length long, ids_crc32 long")


class Knapsack:
    """The dearest filling of each room, of ``most`` pieces of each length at most."""

    def __init__(self, value: np.ndarray, lengths: np.ndarray, most: np.ndarray, capacity: int):
        self.lengths, self.steps = lengths, []
        for k, (length, limit) in enumerate(zip(lengths.tolist(), np.minimum(most, capacity // lengths).tolist(), strict=True)):
            each = 1
            while limit > 0:  # 1, 2, 4, ... pieces, and the rest
                self.steps.append((k, min(each, limit), length * min(each, limit)))
                limit, each = limit - each, 2 * each
        self.worth, self.taken = np.zeros(capacity + 1), np.zeros((len(self.steps), capacity + 1), bool)
        for taken, (k, pieces, weight) in zip(self.taken, self.steps, strict=True):
            with_it = self.worth[: capacity + 1 - weight] + pieces * value[k]
            np.greater(with_it, self.worth[weight:], out=taken[weight:])
            np.maximum(with_it, self.worth[weight:], out=self.worth[weight:])

    def fillings(self, rooms: np.ndarray) -> np.ndarray:
        """(room, length) numbers of pieces."""
        out, rest = np.zeros((len(rooms), len(self.lengths)), np.int64), rooms.copy()
        for taken, (k, pieces, weight) in zip(self.taken[::-1], reversed(self.steps), strict=True):
            hit = taken[rest]
            out[hit, k] += pieces
            rest[hit] -= weight
        return out


def configuration_lp(lengths: np.ndarray, counts: np.ndarray, capacity: int, rate: float, handling: float) -> tuple[list[tuple[float, np.ndarray, np.ndarray]], float]:
    """Fillings that cover each length's pieces once, and a lower bound of their numbers' sum.

    A filling is its fractional number, the places of its lengths, and the pieces of each.

    Covering by multiplicative weights: a length's worth starts at its size and falls by
    ``exp(rate)`` each time that its pieces are covered once more.  The knapsack at these
    worths prices, for each of the ``BATCH`` lengths that are covered least, the dearest
    filling about it; every filling is used for a share of what its scarcest length allows.
    Fillings are then taken back as far as all their lengths are covered more than once.
    The bound is the program's dual at the best of the worths met: all pieces' worth over
    that of the dearest filling.
    """
    covered, part = np.zeros(len(lengths)), min(STEP, max(LEAST_STEP, len(lengths) / 256))
    used: dict[tuple, float] = {}  # fillings as pairs of length and number, some of many lengths
    bound = 0.0
    while (least := covered.min()) < 1:
        worth = lengths * np.exp(-rate * (covered - least))
        worth = np.maximum(worth - handling, 1e-3 * worth)
        knapsack = Knapsack(worth, lengths, counts, capacity)
        bound = max(bound, float(worth @ counts) / float(knapsack.worth[capacity]))
        about = np.argsort(covered, kind="stable")[:BATCH]
        about = about[covered[about] < 1]
        fillings = knapsack.fillings(capacity - lengths[about])
        fillings[np.arange(len(about)), about] += 1
        for filling in np.minimum(fillings, counts):
            some = np.flatnonzero(filling)
            number = part * float((counts[some] / filling[some]).min())
            covered[some] += filling[some] * number / counts[some]
            key = (some.tobytes(), filling[some].tobytes())
            used[key] = used.get(key, 0.0) + number
    out = []
    for key, number in used.items():  # from the first on, priced at worths that were furthest off
        some, each = (np.frombuffer(x, np.int64) for x in key)
        share = each / counts[some]
        spare = min(number, max(0.0, float(((covered[some] - 1) / share).min())))
        covered[some] -= share * spare
        if number > spare:
            out.append((number - spare, some, each))
    return out, bound


def rounded(fractions: list[tuple[float, np.ndarray, np.ndarray]], lengths: np.ndarray, counts: np.ndarray) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """Whole numbers of fillings that the pieces at hand allow, for half of the tokens.

    Those about the longest pieces come first, of these the fullest: long pieces fit few
    fillings.  Numbers are rounded down, and single ones added where that places less than
    half.  What is left is a program of its own.
    """
    order = sorted(fractions, key=lambda x: (-int(x[1][-1]), -int(x[2] @ lengths[x[1]]), int(x[2].sum()), -x[0]))
    left, out, open_tokens = counts.copy(), [], int(counts @ lengths) // 2
    for whole in (True, False):
        for x, some, each in order:
            if open_tokens <= 0 and out:
                return out
            number = min(int(x) if whole else 1, int((left[some] // each).min()))
            if number:
                left[some] -= number * each
                open_tokens -= number * int(each @ lengths[some])
                out.append((number, some, each))
    return out


def program_plan(histogram: dict[int, int], capacity: int, rate: float, handling: float) -> tuple[list[tuple[int, dict[int, int]]], float]:
    """Fillings from the program: solved, rounded, and solved again for what is left.

    Each turn places half of the tokens or more, until less than a sequence is left; that
    is put into the rooms of the fillings, or sequences of its own, by best fit.
    """
    lengths = np.array(sorted(histogram), np.int64)
    counts = np.array([histogram[int(x)] for x in lengths], np.int64)
    out: list[tuple[int, dict[int, int]]] = []
    bound = 0.0
    while int(counts @ lengths) >= capacity:
        fractions, value = configuration_lp(lengths, counts, capacity, rate, handling)
        bound = bound or value
        for number, some, each in rounded(fractions, lengths, counts):
            counts[some] -= number * each
            out.append((number, dict(zip(lengths[some].tolist(), each.tolist(), strict=True))))
        lengths, counts = lengths[counts > 0], counts[counts > 0]
    return best_fit(dict(zip(lengths.tolist(), counts.tolist(), strict=True)), capacity, out), bound


def plan(histogram: dict[int, int], capacity: int, tries: tuple[tuple[float, float], ...] = TRIES) -> list[tuple[int, dict[int, int]]]:
    """Fillings ``(number of sequences, {length: pieces in each})`` that hold all pieces.

    The program is solved in each way of ``tries`` until the number of sequences is next to its lower bound;
    the plan with the fewest is taken.
    """
    left = {k: n for k, n in histogram.items() if k != capacity and n}
    out = [(histogram[capacity], {capacity: 1})] if histogram.get(capacity) else []
    best, fewest = [], float("inf")
    for rate, handling in tries if left else ():
        fillings, bound = program_plan(left, capacity, rate, handling)
        number = sum(n for n, _ in fillings)
        if number < fewest:
            best, fewest = fillings, number
        if number <= math.ceil(bound * GOOD - 1e-6):
            break
    return out + best


def best_fit(histogram: dict[int, int], capacity: int, fillings: Iterable[tuple[int, dict[int, int]]] = ()) -> list[tuple[int, dict[int, int]]]:
    """Best-fit decreasing into ``fillings`` and new ones; like sequences are handled together."""
    rooms: dict[int, list[tuple[int, dict[int, int]]]] = {}
    order: list[int] = []

    def put(room: int, number: int, filling: dict[int, int]) -> None:
        if room not in rooms:
            rooms[room] = []
            insort(order, room)
        rooms[room].append((number, filling))

    for number, filling in fillings:
        put(capacity - sum(k * n for k, n in filling.items()), number, filling)
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            at = bisect_left(order, length)
            if at == len(order):
                each = capacity // length
                number = left // each
                if number:
                    put(capacity - each * length, number, {length: each})
                if left % each:
                    put(capacity - left % each * length, 1, {length: left % each})
                break
            room = order[at]
            number, filling = rooms[room].pop()
            if not rooms[room]:
                del rooms[room], order[at]
            each = min(room // length, left)
            taken = min(number, left // each)
            if number > taken:
                put(room, number - taken, filling)
            put(room - each * length, taken, filling | {length: filling.get(length, 0) + each})
            left -= taken * each
    return [x for groups in rooms.values() for x in groups]


def places(fillings: list[tuple[int, dict[int, int]]], capacity: int) -> dict[str, np.ndarray]:
    """For each length the runs of piece numbers that go to like sequences.

    Run ``length, first`` holds pieces ``first`` on: ``each`` of them in every sequence
    from ``base``, at ``offset`` and behind.
    """
    seen: dict[int, int] = {}
    rows, base = [], 0
    for number, filling in fillings:
        offset = 0
        for length, each in sorted(filling.items(), reverse=True):
            first = seen.get(length, 0)
            rows.append((length, first, each, base, offset))
            seen[length] = first + number * each
            offset += length * each
        base += number
    rows.sort()
    table = np.array(rows, np.int64).reshape(-1, 5).T
    return dict(zip(("length", "first", "each", "base", "offset"), table, strict=True))


def packed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048, path: str | None = None) -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32, sequence_id, offset)``, one row per piece.

    A document is its token ids and a closing 0 (a null or blank text: only that); longer
    ones than ``capacity`` are cut into pieces of that length and a rest.  Equal rows are
    documents of their own; a null id stays null; other columns are ignored; no rows give
    none.  Sequence ids are distinct numbers without a meaning.
    """
    table = saved(pieces(docs, id_col, text_col, capacity, path or tokenizer_path()), "pieces")
    histogram = {r["length"]: r["n"] for r in table.groupBy("length").agg(F.count("*").alias("n")).collect()}  # capacity rows at most
    runs = places(plan(histogram, capacity), capacity)
    give_back()
    rows = sum(histogram.values())
    groups = max(1, min(64, rows // 500), rows // NUMBER_ROWS)  # a third of all rows may have one length
    salted = table.withColumn("salt", F.pmod(F.xxhash64("row", "piece"), F.lit(groups)))
    sizes = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
    bases = sizes.select("length", "salt", before.alias("before"))
    number = F.row_number().over(Window.partitionBy("length", "salt").orderBy("row", "piece")) - 1
    numbered = salted.withColumn("number", number).join(bases, ["length", "salt"]).withColumn("number", F.col("number") + F.col("before"))

    def place(batches):
        # Runs are sorted by (length, first): a piece's run is the last not behind it.
        bounds = np.searchsorted(runs["length"], np.arange(capacity + 2))
        for batch in batches:
            length, k = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("length", "number"))
            at = np.zeros(len(k), np.int64)
            for x in np.unique(length).tolist():
                own = length == x
                a, b = bounds[x], bounds[x + 1]
                at[own] = a + np.searchsorted(runs["first"][a:b], k[own], "right") - 1
            step = k - runs["first"][at]
            sequence = runs["base"][at] + step // runs["each"][at]
            offset = runs["offset"][at] + step % runs["each"][at] * length
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in kept), pa.array(sequence), pa.array(offset)], names=[*kept, "sequence_id", "offset"])

    kept = ["doc_id", "piece", "start", "length", "ids_crc32"]
    kind = dict(docs.dtypes)[id_col]
    return numbered.select(*kept, "number").mapInArrow(tidy(place), f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
