"""Hard-negative mining by blocked dense products of anchors and candidates.

Anchors are a small share of all rows, but one that grows with them, so they are dealt by a
hash of their id into blocks of a bounded size.  A block of anchors is broadcast and meets
all candidates where they lie: no candidate is shuffled.  Scores are products of matrices in
float64 whose entries are whole numbers, so they are exact below 2^53.

1.  Each task keeps the best positives of each anchor of the block; tasks' lists are merged
    by score and id.
2.  The positives' scores set a window for each (anchor, positive).  A second pass keeps the
    best rows of other labels in each window, merged in the same way.

A task reads its candidates by rising id, so that of rows that tie the first ones stay and
later ones are passed over by one comparison, however many rows share a vector.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import saved, tidy

#: Bytes of a block of anchors, in 32-bit numbers, on average.
ANCHOR_BYTES = 1 << 24
#: Scores that a task holds at a time.
SCORES = 1 << 21
#: Whole numbers up to here are exact in a float64.
EXACT = 2.0**53


def whole(batch: pa.RecordBatch, dims: int, scale: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, labels and floored vectors of the usable rows of an ``(id, label, v)`` batch."""
    ids, labels, vectors = (batch.column(k) for k in range(3))
    fine = ids.is_valid().to_numpy(False) & labels.is_valid().to_numpy(False) & vectors.is_valid().to_numpy(False)
    fine &= vectors.value_lengths().fill_null(0).to_numpy(False) == dims
    keep = pa.array(fine)
    x = vectors.filter(keep).flatten().cast(pa.float64()).fill_null(np.nan).to_numpy(False).reshape(-1, dims)
    finite = np.isfinite(x).all(1)
    return ids.filter(keep).to_numpy(False)[finite], labels.filter(keep).to_numpy(False)[finite], np.floor(x[finite] * scale)


def _usable(vectors: DataFrame, id_col: str, label_col: str, vector_col: str) -> DataFrame:
    """``(id, label, v)``; of rows that share an id the one with the least label and vector."""
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).alias("v"))
    fine = F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull()
    rows = rows.where(fine)
    again = saved(rows.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id"), "repeated-ids")
    if again.isEmpty():
        return rows
    least = rows.join(again, "id", "left_semi").groupBy("id").agg(F.min(F.struct("label", "v")).alias("r"))
    return rows.join(again, "id", "left_anti").unionByName(least.select("id", "r.label", "r.v"))


def _shapes(rows: DataFrame, scale: float) -> DataFrame:
    """Rows and the largest number of each length of vectors, counted in Arrow batches."""

    def run(batches):
        for batch in batches:
            lengths = batch.column(2).value_lengths().fill_null(0).to_numpy(False)
            for d in np.unique(lengths[lengths > 0]).tolist():
                ids, _, x = whole(batch, d, scale)
                if len(ids):
                    yield pa.RecordBatch.from_arrays([pa.array([d]), pa.array([len(ids)]), pa.array([float(np.abs(x).max())])], names=["dims", "n", "most"])

    return rows.mapInArrow(tidy(run), "dims long, n long, most double").groupBy("dims").agg(F.sum("n").alias("n"), F.max("most").alias("most"))


class Best:
    """The ``k`` best (score, id) of each of ``n`` slots; ids come by rising number."""

    def __init__(self, n: int, k: int):
        self.k, self.scores, self.ids = k, np.full((n, k), -np.inf), np.zeros((n, k), np.int64)

    @property
    def last(self) -> np.ndarray:
        """What a row's score must exceed."""
        return self.scores[:, -1]

    def add(self, slot: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        better = score > self.last[slot]
        slot, score, ids = slot[better], score[better], ids[better]
        if not len(slot):
            return
        own = np.unique(slot)
        held = self.scores[own] > -np.inf
        slot = np.concatenate([np.repeat(own, self.k)[held.ravel()], slot])
        score = np.concatenate([self.scores[own][held], score])
        ids = np.concatenate([self.ids[own][held], ids])
        order = np.lexsort((ids, -score, slot))
        slot, score, ids = slot[order], score[order], ids[order]
        first = np.searchsorted(slot, slot)
        place = np.arange(len(slot)) - first
        top = place < self.k
        self.scores[own] = -np.inf
        self.scores[slot[top], place[top]], self.ids[slot[top], place[top]] = score[top], ids[top]

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        slot, place = np.nonzero(self.scores > -np.inf)
        return slot, self.ids[slot, place], self.scores[slot, place]


def _chunks(batches, dims: int, scale: float):
    """Usable rows, few at first so that later ones meet good bounds, by label and id."""
    size, most = 128, max(128, min(4096, (1 << 22) // dims))
    for batch in batches:
        at = 0
        while at < batch.num_rows:
            ids, labels, x = whole(batch.slice(at, size), dims, scale)
            at, size = at + size, min(most, 4 * size)
            if len(ids):
                order = np.lexsort((ids, labels))
                yield ids[order], labels[order], x[order]


def _ranges(labels: np.ndarray) -> dict[int, slice]:
    """Where each label lies among sorted ones."""
    found, at = np.unique(labels, return_index=True)
    return {label: slice(a, b) for label, a, b in zip(found.tolist(), at.tolist(), [*at[1:].tolist(), len(labels)], strict=True)}


def _positives(anchors, dims: int, scale: float, k: int):
    """From batches of candidates to each anchor's ``k`` best rows of its label."""

    def run(batches):
        a_ids, a_labels, a_x = (*anchors.value[:2], anchors.value[2].astype(np.float64))
        best, where = Best(len(a_ids), k), _ranges(a_labels)
        for ids, labels, x in _chunks(batches, dims, scale):
            for label, own in _ranges(labels).items():
                if label not in where:
                    continue
                step = max(1, SCORES // (own.stop - own.start))
                for lo in range(where[label].start, where[label].stop, step):
                    hi = min(where[label].stop, lo + step)
                    score = a_x[lo:hi] @ x[own].T
                    row, col = np.nonzero(score > best.last[lo:hi, None])
                    other = ids[own][col] != a_ids[lo:hi][row]
                    row, col = row[other], col[other]
                    best.add(row + lo, score[row, col], ids[own][col])
        slot, found, score = best.rows()
        yield pa.RecordBatch.from_arrays([pa.array(a_ids[slot]), pa.array(found), pa.array(score.astype(np.int64))], names=["anchor_id", "other", "score"])

    return run


def _negatives(anchors, windows, dims: int, scale: float, k: int):
    """From batches of candidates to the ``k`` best rows of each window of each anchor."""

    def run(batches):
        a_ids, a_labels, a_x = (*anchors.value[:2], anchors.value[2].astype(np.float64))
        low, high = windows.value  # (anchor, positive), empty ones from inf to -inf
        each = low.shape[1]
        best, where = Best(low.size, k), _ranges(a_labels)
        for ids, labels, x in _chunks(batches, dims, scale):
            own = _ranges(labels)
            step = max(1, SCORES // len(ids))
            for lo in range(0, len(a_ids), step):
                hi = min(len(a_ids), lo + step)
                score = a_x[lo:hi] @ x.T
                for label, at in own.items():
                    if label in where and where[label].start < hi and where[label].stop > lo:
                        score[max(lo, where[label].start) - lo : min(hi, where[label].stop) - lo, at] = -np.inf
                # Once a window is full only scores above its last one count: whole numbers.
                floor = np.maximum(low[lo:hi], best.last.reshape(-1, each)[lo:hi] + 1)
                row, col = np.nonzero((score >= floor.min(1)[:, None]) & (score <= high[lo:hi].max(1)[:, None]))
                s, name = score[row, col], ids[col]
                for p in range(each):
                    inside = (s >= floor[row, p]) & (s <= high[lo + row, p])
                    best.add((lo + row[inside]) * each + p, s[inside], name[inside])
        slot, found, score = best.rows()
        yield pa.RecordBatch.from_arrays([pa.array(a_ids[slot // each]), pa.array((slot % each).astype(np.int32)), pa.array(found), pa.array(score.astype(np.int64))], names=["anchor_id", "place", "other", "score"])

    return run


def _first(found: DataFrame, keys: list[str], k: int) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "other")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def hard_negatives(
    vectors: DataFrame, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding", *,
    every: int = 100, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100, scale: float = 256.0, anchor_bytes: int = ANCHOR_BYTES,
) -> DataFrame:
    """``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)``.

    Numbers are floored after a multiplication by ``scale``; a row's score is its inner
    product with the anchor.  Anchors are the rows whose id ``every`` divides; their first
    ``positives`` other rows of the same label each get the first ``negatives`` rows of other
    labels with ``low * positive <= 100 * negative <= high * positive``.  Higher scores come
    first, ties go to the smaller id.

    Rows with a null id or label, with a null vector or with a null or non-finite number take
    no part, nor do vectors of another length than the most frequent one and empty ones; of
    rows that share an id the one with the least label and vector counts.  Other columns are
    ignored; no usable rows give none.  Where a score could reach 2^53 an error says so.
    """
    spark = vectors.sparkSession
    kind = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    rows = _usable(vectors, id_col, label_col, vector_col)
    shape = _shapes(rows, scale).orderBy(F.desc("n"), "dims").first()
    if shape is None:
        return spark.createDataFrame([], kind)
    dims = shape["dims"]
    rows = rows.where(F.size("v") == dims)

    anchors = rows.where(F.col("id") % every == 0)
    count = anchors.count()
    if count and shape["most"] ** 2 * dims >= EXACT:
        raise ValueError(f"numbers of up to {shape['most']:g} in {dims} places give scores beyond 2^53")
    blocks = max(1, -(-count * dims * 4 // anchor_bytes))
    anchors = saved(anchors.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")), "anchors")
    ordered, out = rows.sortWithinPartitions("id"), []
    for number in range(blocks):
        # About ``anchor_bytes``, and 5 positives of each of them: bounded, whatever the table's size.
        batch = anchors.where(F.col("block") == number).select("id", "label", "v").toArrow().combine_chunks()
        ids, labels, x = whole(batch.to_batches()[0], dims, scale) if batch.num_rows else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, dims)))
        if not len(ids):
            continue
        order = np.lexsort((ids, labels))
        ids, labels = ids[order], labels[order]
        sent = spark.sparkContext.broadcast((ids, labels, x[order].astype(np.int32 if shape["most"] < 1 << 31 else np.int64)))
        found = ordered.mapInArrow(tidy(_positives(sent, dims, scale, positives)), "anchor_id long, other long, score long")
        best = saved(_first(found, ["anchor_id"], positives).select("anchor_id", (F.col("rank") - 1).alias("place"), F.col("other").alias("positive_id"), F.col("score").alias("positive_score")), "positives")

        known = best.toArrow()
        at = {name: k for k, name in enumerate(ids.tolist())}
        row = np.array([at[name] for name in known.column("anchor_id").to_pylist()], np.int64)
        place, score = known.column("place").to_numpy(), known.column("positive_score").to_numpy()
        windows = np.full((2, len(ids), positives), np.inf)
        windows[1] = -np.inf
        windows[0, row, place], windows[1, row, place] = -(-score * low // 100), score * high // 100
        bounds = spark.sparkContext.broadcast((windows[0], windows[1]))
        found = ordered.mapInArrow(tidy(_negatives(sent, bounds, dims, scale, negatives)), "anchor_id long, place int, other long, score long")
        mined = _first(found, ["anchor_id", "place"], negatives).join(best, ["anchor_id", "place"])
        mined = mined.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("other").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
        out.append(saved(mined, "mined"))
        bounds.destroy()
        sent.destroy()
    return reduce(DataFrame.unionByName, out) if out else spark.createDataFrame([], kind)
