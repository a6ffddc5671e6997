"""A network over numbers, category embeddings and hashed words, trained by sums of gradients.

Rows stay where they are.  A step broadcasts the parameters (some hundred kilobytes, whatever
the table's size), each task adds up the gradients of its rows, the tasks' sums are added up in
a tree, and the driver moves the parameters with what it keeps of earlier steps (Adam).  After
each epoch the validation rows are scored; the epoch with the best macro F1 is the result, and
training ends when ``patience`` epochs have not been better.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import metrics as M
from ..scratch import saved
from .model import CATEGORICAL

#: Numbers of a category's embedding.
EMBEDDING = {"author": 16, "category": 8, "market_regime": 4, "sector": 8, "market_cap_bucket": 4}
#: Slots of categories and of words: values beyond share one by their number or hash.
SLOTS, WORDS, WORD_NUMBERS, HIDDEN = 4096, 4096, 16, 64
#: Partial sums that the driver adds up.
SUMS = 8


@dataclass
class Network:
    """Parameters by name, and what Adam keeps of them between steps."""

    numerical: list[str]
    categorical: list[str]
    values: dict[str, np.ndarray]
    first: dict[str, np.ndarray] = field(default_factory=dict)
    second: dict[str, np.ndarray] = field(default_factory=dict)
    steps: int = 0

    def copy(self) -> Network:
        return Network(self.numerical, self.categorical, {k: v.copy() for k, v in self.values.items()})

    def move(self, gradients: dict[str, np.ndarray], rate: float) -> None:
        self.steps += 1
        for k, g in gradients.items():
            m = self.first[k] = 0.9 * self.first.get(k, 0.0) + 0.1 * g
            v = self.second[k] = 0.999 * self.second.get(k, 0.0) + 0.001 * g * g
            self.values[k] = self.values[k] - rate * (m / (1 - 0.9**self.steps)) / (np.sqrt(v / (1 - 0.999**self.steps)) + 1e-8)


def fresh(numerical: Sequence[str], categorical: Sequence[str], seed: int = 0) -> Network:
    r = np.random.Generator(np.random.PCG64(seed))
    width = len(numerical) + sum(EMBEDDING.get(c, 8) for c in categorical) + WORD_NUMBERS
    values = {c: r.normal(0, 0.1, (SLOTS, EMBEDDING.get(c, 8))) for c in categorical}
    values |= {"words": r.normal(0, 0.1, (WORDS, WORD_NUMBERS)), "w1": r.normal(0, (2 / width) ** 0.5, (width, HIDDEN)), "b1": np.zeros(HIDDEN), "w2": r.normal(0, (2 / HIDDEN) ** 0.5, (HIDDEN, 3)), "b2": np.zeros(3)}
    return Network(list(numerical), list(categorical), values)


def inputs(rows: DataFrame, numerical: Sequence[str], categorical: Sequence[str]) -> DataFrame:
    """``rows`` with ``x`` (numbers), ``c`` (slots of categories) and ``t`` (slots of words)."""
    slot = lambda c: F.pmod(F.coalesce(F.col(f"{c}_idx"), F.lit(0)), F.lit(SLOTS)).cast("int")
    words = F.filter(F.split(F.lower(F.coalesce("text", F.lit(""))), r"\s+"), lambda w: w != "")
    return rows.withColumns({"x": F.array(*[F.coalesce(F.col(c), F.lit(0.0)).cast("double") for c in numerical]), "c": F.array(*map(slot, categorical)), "t": F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(WORDS)).cast("int"))})


def _batch(x: Iterator, c: Iterator, t: Iterator) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Numbers, slots of categories, rows and slots of words."""
    words = list(t)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    flat = np.concatenate([np.asarray(w, np.int64) for w in words]) if sizes.sum() else np.zeros(0, np.int64)
    return np.array(list(x), float).reshape(len(words), -1), np.array(list(c), np.int64).reshape(len(words), -1), np.repeat(np.arange(len(words)), sizes), flat


def forward(net: Network, x, c, row, word) -> tuple[np.ndarray, ...]:
    v = net.values
    share = 1 / np.maximum(np.bincount(row, minlength=len(x)), 1)
    bag = np.zeros((len(x), WORD_NUMBERS))
    np.add.at(bag, row, v["words"][word])
    joined = np.concatenate([x, *[v[k][c[:, i]] for i, k in enumerate(net.categorical)], bag * share[:, None]], 1)
    hidden = np.maximum(joined @ v["w1"] + v["b1"], 0)
    z = hidden @ v["w2"] + v["b2"]
    p = np.exp(z - z.max(1, keepdims=True))
    return joined, hidden, p / p.sum(1, keepdims=True), share


def gradients(net: Network, x, c, row, word, label: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
    """Sums over rows of the gradients of ``weight`` times the cross-entropy."""
    joined, hidden, p, share = forward(net, x, c, row, word)
    up = p.copy()
    up[np.arange(len(label)), label] -= 1
    up *= weight[:, None]
    back = (up @ net.values["w2"].T) * (hidden > 0)
    out = {"w2": hidden.T @ up, "b2": up.sum(0), "w1": joined.T @ back, "b1": back.sum(0)}
    low = back @ net.values["w1"].T
    at = x.shape[1]
    for i, k in enumerate(net.categorical):
        width = net.values[k].shape[1]
        out[k] = np.zeros_like(net.values[k])
        np.add.at(out[k], c[:, i], low[:, at : at + width])
        at += width
    out["words"] = np.zeros_like(net.values["words"])
    np.add.at(out["words"], word, (low[:, at:] * share[:, None])[row])
    return out


def _packed(parts: dict[str, np.ndarray], names: Sequence[str], total: float) -> bytes:
    return np.concatenate([[total], *[parts[k].ravel() for k in names]]).tobytes()


def summed_gradients(rows: DataFrame, net: Network) -> tuple[dict[str, np.ndarray], float]:
    """Over all rows the sum of gradients, and of weights; in the same order each time."""
    spark, names = rows.sparkSession, sorted(net.values)
    sent = spark.sparkContext.broadcast(net.copy())

    def each(batches: Iterator[pa.RecordBatch]):
        total, weights = None, 0.0
        for b in batches:
            label, weight = b.column(3).to_numpy(False).astype(np.int64), b.column(4).to_numpy(False)
            found = gradients(sent.value, *_batch(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()), label, weight)
            total = found if total is None else {k: total[k] + found[k] for k in names}
            weights += float(weight.sum())
        if total is not None:
            from pyspark import TaskContext

            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([_packed(total, names, weights)], pa.binary())], names=["part", "sums"])

    def together(batches: Iterator[pa.RecordBatch]):
        total, first = None, None
        for b in batches:
            for part, blob in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                one = np.frombuffer(blob)
                total, first = (one.copy(), part) if total is None else (total + one, first)
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([first], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["part", "sums"])

    kind = "part int, sums binary"
    parts = rows.select("x", "c", "t", "label", "weight").mapInArrow(each, kind)
    parts = parts.repartition(SUMS, F.pmod("part", F.lit(SUMS))).sortWithinPartitions("part").mapInArrow(together, kind)
    found = [np.frombuffer(r["sums"]) for r in sorted(parts.collect(), key=lambda r: r["part"])]  # ``SUMS`` rows at most
    sent.destroy()
    total, out, at = sum(found) if found else np.zeros(1 + sum(v.size for v in net.values.values())), {}, 1
    for k in names:
        size = net.values[k].size
        out[k] = total[at : at + size].reshape(net.values[k].shape)
        at += size
    return out, float(total[0])


def predicted(net: Network, rows: DataFrame, key: str = "tweet_hash") -> DataFrame:
    """``(id, p_sell, p_hold, p_buy, pred, label, ret)`` of rows with ``x, c, t``."""
    sent = rows.sparkSession.sparkContext.broadcast(net.copy())

    def run(frames: Iterator[pd.DataFrame]):
        for f in frames:
            p = forward(sent.value, *_batch(f["x"], f["c"], f["t"]))[2]
            yield pd.DataFrame({"id": f["id"], "p_sell": p[:, 0], "p_hold": p[:, 1], "p_buy": p[:, 2], "label": f["label"], "ret": f["ret"]})

    ret = F.col("return_to_next_open") if "return_to_next_open" in rows.columns else F.lit(None)
    out = rows.select(F.col(key).cast("string").alias("id"), "x", "c", "t", "label", ret.cast("double").alias("ret")).mapInPandas(run, "id string, p_sell double, p_hold double, p_buy double, label int, ret double")
    best = M.confidence()
    return out.withColumn("pred", F.when(F.col("p_sell") == best, 0).when(F.col("p_hold") == best, 1).otherwise(2))


def trained(rows: DataFrame, numerical: Sequence[str], categorical: Sequence[str] = CATEGORICAL, *, epochs: int = 20, batches: int = 4, rate: float = 3e-3, patience: int = 3, seed: int = 0) -> tuple[Network, list[float]]:
    """The network of the best epoch and the macro F1 of each epoch on the validation rows.

    ``rows`` have ``split, label, weight, tweet_hash`` and ``model.prepared``'s features.  They
    are dealt by their hash and sorted, and sums are added in a fixed order, so that a second
    run gives the same network.
    """
    made = inputs(rows, numerical, categorical).select("split", "label", "weight", "tweet_hash", "x", "c", "t")
    n = int(made.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    made = made.withColumn("batch", F.pmod(F.xxhash64("tweet_hash"), F.lit(batches)).cast("int"))
    made = saved(made.repartition(n, "tweet_hash").sortWithinPartitions("tweet_hash", "label", "t", "x", "c"), "network-rows")
    train, val = made.where("split = 'train' and label is not null"), made.where("split = 'val' and label is not null")
    net, best, history = fresh(numerical, categorical, seed), None, []
    for _ in range(epochs):
        for b in range(batches):
            sums, weight = summed_gradients(train.where(F.col("batch") == b), net)
            if weight > 0:
                net.move({k: g / weight for k, g in sums.items()}, rate)
        history.append(M.scores(predicted(net, val)).first()["f1_macro"] or 0.0)
        if best is None or history[-1] > history[best[0]]:
            best = len(history) - 1, net.copy()
        if len(history) - 1 - best[0] >= patience:
            break
    return best[1] if best else net, history


def stored(net: Network, spark: SparkSession) -> DataFrame:
    """The network as a table, a row for each array of parameters."""
    rows = [(k, list(v.shape), v.ravel().tolist(), net.numerical, net.categorical) for k, v in net.values.items()]
    return spark.createDataFrame(rows, "name string, shape array<int>, numbers array<double>, numerical array<string>, categorical array<string>")


def loaded(table: DataFrame) -> Network:
    rows = table.collect()  # an array of parameters each
    return Network(list(rows[0]["numerical"]), list(rows[0]["categorical"]), {r["name"]: np.array(r["numbers"]).reshape(r["shape"]) for r in rows})
