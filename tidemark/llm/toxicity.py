"""Toxicity scores: FTRL-proximal logistic regression over hashed word n-grams.

Features of a text are its distinct words, word pairs and pairs with one word between
(skip-grams), hashed to ``2**bits`` slots; words are runs of letters, digits and non-ASCII
bytes, lower-cased in A-Z.  Learning is FTRL-proximal (McMahan et al. 2013): each slot has
its own rate, and L1 keeps most weights at zero, so what is broadcast is a few thousand
numbers and never more than ``2**bits``.  The sample for learning is bounded by
``sample`` rows; scoring covers all rows and whole texts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LANES, U64, finish, slices, text_buffers, tidy, word_hashes

BITS = 20
#: Labelled rows that the model is fitted on, at most (those with the least hash of their id).
SAMPLE = 20_000
#: Features of those rows that the model is fitted on, at most (4 bytes each): the sample ends
#: with the row that passes it.
SAMPLE_FEATURES = 40_000_000
EPOCHS = 4
THRESHOLD = 0.3


def _separators() -> np.ndarray:
    byte = np.arange(256)
    word = (byte >= 128) | (byte >= 48) & (byte <= 57) | (byte >= 65) & (byte <= 90) | (byte >= 97) & (byte <= 122)
    return ~word


NOT_WORD = _separators()


def features(column: pa.Array, bits: int = BITS):
    """Per slice of rows: first row, number of rows, row and slot of each feature."""
    raw, bounds = text_buffers(column)
    shift = U64(64 - bits)
    for i, j in slices(bounds):
        words, at = word_hashes(raw[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i], NOT_WORD)
        row = np.repeat(np.arange(j - i), np.diff(at))
        slots, rows = [finish(words * LANES[0]) >> shift], [row]
        for gap, lane in ((1, 1), (2, 2)):
            both = row[:-gap] == row[gap:] if len(row) > gap else np.zeros(0, bool)
            left, right = words[: max(0, len(words) - gap)], words[gap:]
            slots.append((finish(left * LANES[2 * lane] + right * LANES[2 * lane + 1]) >> shift)[both])
            rows.append(row[: max(0, len(row) - gap)][both])
        yield i, j - i, np.concatenate(rows), np.concatenate(slots).astype(np.int64)


class Ftrl:
    """Per-coordinate FTRL-proximal for logistic loss; slot ``2**bits`` is the bias."""

    def __init__(self, size: int, alpha: float = 0.3, beta: float = 1.0, l1: float = 6.0, l2: float = 1e-3):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros(size), np.zeros(size)

    def weights(self, i) -> np.ndarray:
        z, n = self.z[i], self.n[i]
        shrunk = np.sign(z) * np.maximum(np.abs(z) - self.l1, 0)
        return -shrunk / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)

    def learn(self, i: np.ndarray, label: float) -> None:
        w = self.weights(i)
        p = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35)))
        g = p - label
        n = self.n[i]
        self.z[i] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[i] = n + g * g


def held_out(id_col: str) -> Column:
    """Rows that labels are never learnt from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE, bits: int = BITS, epochs: int = EPOCHS) -> tuple[np.ndarray, np.ndarray]:
    """Slots and weights other than zero; empty where there are no labelled rows.

    Of labels that repeat an id the largest holds; null ids and labels are left out.
    """
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col))
    known = known.groupBy(F.col(id_col).alias("label_id")).agg(F.max(label_col).cast("double").alias("y"))
    known = known.orderBy(F.xxhash64("label_id"), "label_id").limit(sample)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    rows = texts.join(F.broadcast(known), F.col("id") == F.col("label_id")).select("id", "y", "text")

    def extract(batches):
        for batch in batches:
            for first, count, row, slot in features(batch.column(2), bits):
                key = np.unique(row << np.int64(bits) | slot)
                at = np.searchsorted(key >> bits, np.arange(count + 1))
                slots = (key & ((1 << bits) - 1)).astype(np.int32)
                lists = [slots[a:b].tobytes() for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0)[first : first + count], batch.column(1)[first : first + count], pa.array(lists, pa.binary())], names=["id", "y", "slots"])

    def train(batches):
        examples, held = [], 0
        for batch in batches:
            for slots, y in zip(batch.column(2), batch.column(1).to_pylist(), strict=True):
                if held <= SAMPLE_FEATURES:
                    examples.append((np.append(np.frombuffer(slots.as_buffer(), np.int32), 1 << bits), y))
                    held += len(examples[-1][0])
        model = Ftrl((1 << bits) + 1)
        for epoch in range(epochs if examples else 0):
            for k in np.random.Generator(np.random.PCG64(epoch)).permutation(len(examples)):
                model.learn(*examples[k])
        w = model.weights(np.arange((1 << bits) + 1))
        slot = np.flatnonzero(w)
        yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array(w[slot])], names=["slot", "weight"])

    kind = dict(texts.dtypes)["id"]
    found = rows.mapInArrow(tidy(extract), f"id {kind}, y double, slots binary")
    # One task, over ``sample`` rows at most (repeated ids too), in an order that does not
    # hang on partitions.
    learnt = found.orderBy(F.xxhash64("id"), "id", "slots").limit(sample).mapInArrow(tidy(train), "slot long, weight double").toPandas()
    return learnt["slot"].to_numpy(np.int64), learnt["weight"].to_numpy(np.float64)


def _sums(model: tuple[np.ndarray, np.ndarray], bits: int):
    """From a column of texts to the sum of weights of each row's distinct features."""
    slots, weights = model
    table, own = np.zeros(1 << bits), slots < 1 << bits
    table[slots[own]] = weights[own]
    bias = float(weights[~own].sum())

    def sums(column: pa.Array) -> np.ndarray:
        total = np.full(len(column), bias)
        for first, count, row, slot in features(column, bits):
            some = table[slot] != 0
            key = np.unique(row[some] << np.int64(bits) | slot[some])
            total[first : first + count] += np.bincount(key >> bits, table[key & ((1 << bits) - 1)], count)
        return total

    return sums


def scored(docs: DataFrame, model: tuple[np.ndarray, np.ndarray], id_col: str = "doc_id", text_col: str = "text", bits: int = BITS, threshold: float = THRESHOLD) -> DataFrame:
    """``(doc_id, held_out, score, predicted)``, one row per row of ``docs``.

    A null or empty text has no features: its score is that of the bias.  Without labelled
    rows nothing is known and every score is 0.  A null id counts as not held out.
    """

    def run(batches):
        sums = _sums(model, bits)
        for batch in batches:
            total = sums(batch.column(2))
            score = 1 / (1 + np.exp(-np.clip(total, -35, 35))) if len(model[0]) else np.zeros(len(total))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score), pa.array((score >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    kind = dict(docs.dtypes)[id_col]
    return docs.select(F.col(id_col).alias("doc_id"), held_out(id_col).alias("held_out"), text_col).mapInArrow(tidy(run), f"doc_id {kind}, held_out boolean, score double, predicted int")


def toxicity_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` by a model fitted on ``labels``.

    One row per row of ``docs``: equal texts have equal scores, null and empty ones that of
    the bias, long ones count as a whole.  A null id isn't held out and never learnt from.
    Columns other than the two named, and those of ``labels`` other than the id and
    ``toxic``, are ignored.  No rows give none; without labels every score is 0.
    """
    return scored(docs, fit(docs, labels, id_col, text_col), id_col, text_col)


def clean(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = BITS, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` whose score is below the threshold, with all their columns.

    Rows are judged one by one by their whole texts, so equal texts stay or go together, and
    null ids, repeated rows and ties need no rule; null and empty texts are judged by the
    bias.  Without labels all rows stay; no rows give none.
    """
    model = fit(docs, labels, id_col, text_col)
    place = docs.columns.index(text_col)
    limit = float(np.log(threshold / (1 - threshold))) if len(model[0]) else np.inf

    def run(batches):
        sums = _sums(model, bits)
        for batch in batches:
            yield batch.filter(pa.array(sums(batch.column(place)) < limit))

    return docs.mapInArrow(tidy(run), docs.schema)
