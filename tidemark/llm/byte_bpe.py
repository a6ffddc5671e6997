"""Byte-level BPE by a tree of halves.

Encodings of neighbouring texts are joined, not made again: ``encode(a + b)`` follows from
``encode(a)``, ``encode(b)`` and a window around the cut.  A text is halved down to leaves,
leaves are encoded by themselves, and neighbours are joined up the tree.

Two things can change at a cut, and each has its own window:

*  Where the pattern cuts.  It goes from left to right and knows nothing of what it has
   passed, and where a match ends hangs on the ``AHEAD`` characters behind it at most.  So
   the left part's matches that end so far before the cut hold; from there the pattern runs
   on over the cut until one of its settled matches ends where one of the right part's does.
   All behind that is as it was.  While there is no such place, the window grows.
*  How a match that is long by itself is merged.  Its halves' last and first tokens are
   merged again in a window; a row of tokens is the encoding of its bytes just if each two
   neighbours are the encoding of theirs, as a merge across the border of two tokens would
   be made in the encoding of those two alone.  So the result stands once both borders of
   the window pass that test.  While one doesn't, the window grows.

Decoding concatenates up the same kind of tree.
"""

from __future__ import annotations

import base64
from dataclasses import dataclass
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import kept_in_stage, tidy

#: Characters of a leaf of texts, and bytes of a leaf of one long match.
LEAF, PIECE_LEAF = 8192, 1024
#: Characters behind a match's start, and behind its end, that can decide where it ends: a
#: contraction is an apostrophe and two letters, blanks give one back before a word.
AHEAD_START, AHEAD_END = 4, 2
#: Characters of the first window at a cut; tokens of the first window in a long match.
WINDOW, PIECE_WINDOW = 64, 8
#: Matches that a worker remembers (it forgets all of them beyond that), and their length.
REMEMBERED, REMEMBERED_LENGTH = 1 << 17, 48
#: Bytes of texts, and tokens, that a batch of results holds.
BATCH_TOKENS = 1 << 20


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def tokenizer_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as file:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}


@dataclass
class Part:
    """The encoding of ``text[lo:hi]``: where matches start, their tokens' numbers, all ids."""

    lo: int
    hi: int
    starts: np.ndarray
    counts: np.ndarray
    ids: np.ndarray


def _joined(*arrays: np.ndarray) -> np.ndarray:
    return np.concatenate(arrays)


class Encoder:
    """Texts to ids and back by ranks of byte strings, without special tokens."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, leaf: int = LEAF, piece_leaf: int = PIECE_LEAF, window: int = WINDOW, piece_window: int = PIECE_WINDOW):
        import regex
        import tiktoken

        self.pattern = regex.compile(pattern)
        self.merge = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})._encode_single_piece
        self.bytes_of = {v: k for k, v in ranks.items()}
        self.longest = max(map(len, ranks))
        self.leaf, self.piece_leaf, self.window, self.piece_window = leaf, max(piece_leaf, self.longest + 1), window, piece_window
        self.known: dict[str, tuple[int, ...]] = {}

    # ------------------------------------------------------------ one match of the pattern

    def match(self, piece: str) -> tuple[int, ...]:
        """The ids of one match, remembered where it is short."""
        ids = self.known.get(piece)
        if ids is None:
            raw = piece.encode()
            ids = tuple(self.merge(raw) if len(raw) <= self.piece_leaf else self.long_match(raw))
            if len(piece) <= REMEMBERED_LENGTH:
                if len(self.known) >= REMEMBERED:
                    self.known.clear()
                self.known[piece] = ids
        return ids

    def long_match(self, raw: bytes) -> list[int]:
        if len(raw) <= self.piece_leaf:
            return self.merge(raw)
        half = len(raw) // 2
        return self.join_tokens(self.long_match(raw[:half]), self.long_match(raw[half:]))

    def neighbours(self, a: int, b: int) -> bool:
        """Whether two tokens are the encoding of their bytes."""
        return self.merge(self.bytes_of[a] + self.bytes_of[b]) == [a, b]

    def join_tokens(self, left: list[int], right: list[int]) -> list[int]:
        """The encoding of two neighbours within one match.

        A window is longer than any token, so that no token stands for it unmerged.
        """
        k = self.piece_window
        while True:
            a, b = left[-k:], right[:k]
            raw = b"".join(map(self.bytes_of.__getitem__, a + b))
            if whole := k >= len(left) and k >= len(right):
                return self.merge(raw)
            if len(raw) > self.longest and not whole:
                ids = self.merge(raw)
                if (k >= len(left) or self.neighbours(left[-k - 1], ids[0])) and (k >= len(right) or self.neighbours(ids[-1], right[k])):
                    return left[:-k] + ids + right[k:]
            k *= 2

    # ------------------------------------------------------------ texts

    def leaf_part(self, text: str, lo: int, hi: int) -> Part:
        pieces = self.pattern.findall(text, lo, hi)
        ends = np.fromiter(accumulate(map(len, pieces), initial=lo), np.int64, len(pieces) + 1)
        known = self.known
        tokens = [known.get(p) or self.match(p) for p in pieces]
        counts = np.fromiter(map(len, tokens), np.int64, len(tokens))
        return Part(lo, hi, ends[:-1], counts, np.fromiter(chain.from_iterable(tokens), np.int32, int(counts.sum())))

    def join(self, text: str, left: Part, right: Part) -> Part:
        """The encoding of two neighbours' text."""
        edge = left.hi
        # Matches are settled where what decides their end lies before the cut.
        held = min(int(np.searchsorted(left.starts[1:], edge - AHEAD_END, "right")), int(np.searchsorted(left.starts, edge - AHEAD_START, "right")))
        start, reach = int(left.starts[held]), self.window
        while True:
            stop = min(right.hi, edge + reach)
            part = self.leaf_part(text, start, stop)
            ends = _joined(part.starts[1:], [stop])
            settled = len(ends) if stop == right.hi else int(np.count_nonzero((ends + AHEAD_END <= stop) & (part.starts + AHEAD_START <= stop)))
            at = np.searchsorted(right.starts, ends[:settled])
            meets = (ends[:settled] >= edge) & (ends[:settled] == np.append(right.starts, right.hi)[at])
            if meets.any():
                k = int(meets.argmax())
                j, keep = int(at[k]), k + 1
                break
            reach *= 4
        return Part(
            left.lo, right.hi,
            _joined(left.starts[:held], part.starts[:keep], right.starts[j:]), _joined(left.counts[:held], part.counts[:keep], right.counts[j:]),
            _joined(left.ids[: int(left.counts[:held].sum())], part.ids[: int(part.counts[:keep].sum())], right.ids[int(right.counts[:j].sum()) :]),
        )

    def part(self, text: str, lo: int, hi: int) -> Part:
        if hi - lo <= self.leaf:
            return self.leaf_part(text, lo, hi)
        half = (lo + hi) // 2
        return self.join(text, self.part(text, lo, half), self.part(text, half, hi))

    def encode(self, text: str) -> np.ndarray:
        return self.part(text, 0, len(text)).ids if text else np.zeros(0, np.int32)

    def decode(self, ids: list[int]) -> bytes:
        if len(ids) <= self.leaf:
            return b"".join(map(self.bytes_of.__getitem__, ids))
        half = len(ids) // 2
        return self.decode(ids[:half]) + self.decode(ids[half:])


def _encoder(sent, pattern: str) -> Encoder:
    return kept_in_stage("byte-bpe", lambda: Encoder(sent.value, pattern))


def encoded(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranks: dict[bytes, int] | None = None, pattern: str | None = None) -> DataFrame:
    """``(doc_id, ids array<int>)``, one row per row of ``docs``, of whole texts of any length.

    A null or empty text has no ids; repeated rows and null ids are rows of their own; other
    columns are left out; no rows give none.  ``ranks`` (a vocabulary, so of bounded size) is
    broadcast.  The windows at cuts hold for ``tokenizer_pattern()``, the default pattern.
    """
    sent = docs.sparkSession.sparkContext.broadcast(ranks or read_ranks(tokenizer_path()))
    pattern = pattern or tokenizer_pattern()

    def run(batches):
        encoder = _encoder(sent, pattern)
        for batch in batches:
            held, first, size = [], 0, 0
            for k, text in enumerate(batch.column(1)):
                held.append(encoder.encode(text.as_py() or ""))
                size += len(held[-1])
                if size >= BATCH_TOKENS or k + 1 == batch.num_rows:
                    offsets = pa.array(np.cumsum([0, *map(len, held)]), pa.int32())
                    lists = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(held)))
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(held)), lists], names=["doc_id", "ids"])
                    held, first, size = [], k + 1, 0

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(tidy(run), f"doc_id {kind}, ids array<int>")


def decoded(rows: DataFrame, ids_col: str = "ids", ranks: dict[bytes, int] | None = None, pattern: str | None = None, into: str = "decoded") -> DataFrame:
    """``rows`` with the bytes of their ids as the column ``into`` (null and empty lists: none).

    An id that the vocabulary lacks, or a null one, is an error that names it.
    """
    sent = rows.sparkSession.sparkContext.broadcast(ranks or read_ranks(tokenizer_path()))
    pattern, at = pattern or tokenizer_pattern(), rows.columns.index(ids_col)

    def run(batches):
        encoder = _encoder(sent, pattern)
        for batch in batches:
            held, first, size = [], 0, 0
            for k, ids in enumerate(batch.column(at)):
                held.append(encoder.decode(ids.values.to_pylist() if ids.is_valid else []))
                size += len(held[-1])
                if size >= 4 * BATCH_TOKENS or k + 1 == batch.num_rows:
                    part = batch.slice(first, len(held))
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(held, pa.binary())], names=[*batch.schema.names, into])
                    held, first, size = [], k + 1, 0

    return rows.mapInArrow(tidy(run), ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + f", `{into}` binary")
