"""Maximum inner product search with score-aware quantisation and four-bit tables.

Vectors are cut into blocks of two numbers, each named by one of 16 centres (4 bits).
Centres and codes minimise the anisotropic loss of Guo et al. (2020): the part of the
residual along the vector costs ``eta`` times the part across it, as that part shifts high
inner products.  A query's table of 16 products per block, rounded to bytes, is added up
over all rows' codes; the best of each data block are scored exactly on their vectors.

Queries and data meet in blocks: every row of the data is scanned for every query.  A block
of data moves once, is encoded once, and the queries stream past it in bounded memory; what
grows with the number of blocks is how often the queries move, so blocks are as large as a
task's memory allows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import partitions, saved, tidy

#: Vectors that the centres are fitted on, at most (those with the least hash of their id).
SAMPLE = 10_000
CENTRES = 16
#: Threshold of the score-aware loss, as a share of the vector's length.
T = 0.2
#: The most that the residual along a vector costs, times that across: on wide vectors of
#: which all are about as near, more costs recall (1024 Gaussian numbers: 0.87 at 43, 1.0 at 4).
MOST = 4.0
#: Rows that are scored exactly for each query: so many of up to ``RERANK_ROWS`` rows, and
#: with the root of their number beyond.  At 51,282 and at 5,000 rows of 64 numbers the 20
#: nearest are among the first 400 and 150 with a share of 0.99.
RERANK, RERANK_ROWS = 600, 50_000
#: Bytes of a block's vectors, at most.
BLOCK_BYTES = 1 << 25


def anisotropy(dims: int, t: float = T) -> float:
    """How much more the residual along a vector costs than the residual across it."""
    return min(MOST, max(1.0, (dims - 1) * t * t / (1 - t * t)))


def _blocks(x: np.ndarray) -> np.ndarray:
    """Rows as (row, block, 2), a zero behind an odd number."""
    if x.shape[1] % 2:
        x = np.concatenate([x, np.zeros((len(x), 1), x.dtype)], 1)
    return x.reshape(len(x), -1, 2)


def encode(x: np.ndarray, centres: np.ndarray, eta: float, rounds: int = 2) -> np.ndarray:
    """Codes (row, block): nearest centres, then coordinate descent on the loss."""
    parts = _blocks(x)
    unit = _blocks(x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-30))
    rest = parts[:, :, None, :] - centres[None]
    across = (rest**2).sum(3)
    along = (rest * unit[:, :, None, :]).sum(3)
    codes = across.argmin(2)
    rows = np.arange(len(x))
    total = np.take_along_axis(along, codes[:, :, None], 2)[:, :, 0].sum(1)
    for _ in range(rounds):
        for m in range(parts.shape[1]):
            others = total - along[rows, m, codes[:, m]]
            codes[:, m] = (across[:, m] + (eta - 1) * (others[:, None] + along[:, m]) ** 2).argmin(1)
            total = others + along[rows, m, codes[:, m]]
    return codes


def fit(x: np.ndarray, eta: float, rounds: int = 8, seed: int = 5) -> np.ndarray:
    """Centres (block, 16, 2): codes and least squares under the loss in turn."""
    parts = _blocks(x)
    unit = _blocks(x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-30))
    pick = np.random.Generator(np.random.PCG64(seed)).choice(len(x), CENTRES, replace=len(x) < CENTRES)
    centres = parts[pick].transpose(1, 0, 2).copy()
    for r in range(rounds):
        weight = eta if r > rounds // 2 else 1.0
        codes = np.concatenate([encode(x[i : i + 1024], centres, weight, 1) for i in range(0, len(x), 1024)])
        rest = parts - centres[np.arange(parts.shape[1]), codes]
        along = (rest * unit).sum(2)
        total = along.sum(1)
        for m in range(parts.shape[1]):
            u, p = unit[:, m], parts[:, m]
            others = total - along[:, m]
            left = np.eye(2)[None] + (weight - 1) * u[:, :, None] * u[:, None, :]
            right = p + (weight - 1) * u * (others + (p * u).sum(1))[:, None]
            for c in np.unique(codes[:, m]):
                own = codes[:, m] == c
                centres[m, c] = np.linalg.solve(left[own].sum(0) + 1e-9 * np.eye(2), right[own].sum(0))
    return centres


def packed_codes(codes: np.ndarray) -> np.ndarray:
    """Two four-bit codes a byte, as (byte, row)."""
    if codes.shape[1] % 2:
        codes = np.concatenate([codes, np.zeros((len(codes), 1), codes.dtype)], 1)
    return np.ascontiguousarray((codes[:, ::2] << 4 | codes[:, 1::2]).astype(np.uint8).T)


def byte_tables(query: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """(byte, 256) sums of two 16-entry tables of products, each rounded to 0..255."""
    table = (centres * _blocks(query[None])[0][:, None, :]).sum(2)
    table -= table.min(1, keepdims=True)
    table = np.rint(table * (255 / max(float(table.max()), 1e-30))).astype(np.uint16)
    if len(table) % 2:
        table = np.concatenate([table, np.zeros((1, CENTRES), np.uint16)])
    return (table[::2, :, None] + table[1::2, None, :]).reshape(len(table) // 2, 256)


def scan(query: np.ndarray, codes: np.ndarray, centres: np.ndarray, keep: int) -> np.ndarray:
    """The rows with the highest sums of table entries, ``keep`` of them."""
    n = codes.shape[1]
    if n <= keep:
        return np.arange(n)
    tables = byte_tables(query, centres)
    score = np.zeros(n, np.uint16 if int(tables.max(1).sum(dtype=np.int64)) < 1 << 16 else np.uint32)
    for table, code in zip(tables, codes, strict=True):
        score += table[code]
    return np.argpartition(score, n - keep)[n - keep :]


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``(id, v)`` of rows that take part: an id, and a finite vector other than zero.

    Of rows that share an id the one with the least vector is taken.  Numbers stay floats
    where they are, else they are doubles.
    """
    v = F.col(vector_col)
    if dict(vectors.dtypes)[vector_col] != "array<float>":
        v = v.cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & fine).select(F.col(id_col).cast("long").alias("id"), v.alias("v"))
    # Only ids are shuffled to find those that repeat, not all vectors.
    again = saved(rows.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id"), "repeated-ids")
    if again.isEmpty():
        return rows
    return rows.join(again, "id", "left_anti").unionByName(rows.join(again, "id", "left_semi").groupBy("id").agg(F.min("v").alias("v")))


class Block:
    """A block of data: distinct vectors, their codes, and the ids that have each."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, centres: np.ndarray, eta: float):
        order = np.argsort(ids)
        self.ids = ids[order]
        # Equal vectors are scanned once; of their ids the k + 1 least can rank.
        self.distinct, where = np.unique(x[order], axis=0, return_inverse=True)
        self.by = np.argsort(where, kind="stable")
        self.bounds = np.searchsorted(where[self.by], np.arange(len(self.distinct) + 1))
        self.centres = centres
        self.codes = np.concatenate([packed_codes(encode(self.distinct[s : s + 2048].astype(np.float64), centres, eta)) for s in range(0, len(self.distinct), 2048)], 1)

    def nearest(self, name: int, vector: np.ndarray, k: int, rerank: int) -> list[tuple[float, int]]:
        """``(-score, id)`` of the ``k`` best rows but the query's own."""
        hits = scan(vector, self.codes, self.centres, rerank)
        score = self.distinct[hits].astype(np.float64) @ vector
        order = np.argsort(-score, kind="stable")[: k + 1]
        found = [(-s, int(self.ids[self.by[j]])) for h, s in zip(hits[order].tolist(), score[order].tolist(), strict=True) for j in range(self.bounds[h], min(self.bounds[h + 1], self.bounds[h] + k + 1))]
        return sorted(x for x in found if x[1] != name)[:k]


def share_of(rerank: int, blocks: int, k: int) -> int:
    """Rows that one block scores exactly so that all blocks' best ``rerank`` are among them:
    rows are dealt by a hash, so a block has its share of them and four deviations at most."""
    mean = -(-rerank // blocks)
    return min(rerank, mean + 4 * int(np.ceil(np.sqrt(mean))) + k)


def nearest(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", every: int = 20, k: int = 20, sample: int = SAMPLE, rerank: int = RERANK, blocks: int | None = None) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the ``k`` rows of largest inner product.

    Queries are the rows whose id ``every`` divides; a query's own row (all rows of its
    id) is no candidate; ties go to the smaller id.  Null, zero and non-finite vectors and
    null ids take no part, nor do vectors of another length than the most frequent one;
    repeated ids are ranked once.  Other columns are ignored; no usable rows give none.
    """
    spark = vectors.sparkSession
    rows = usable(vectors, id_col, vector_col)
    shape = rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").first()
    if shape is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dims, n = shape["d"], shape["n"]
    rows = rows.where(F.size("v") == dims)
    eta = anisotropy(dims)
    fitted = rows.orderBy(F.xxhash64("id"), "id").limit(sample).toPandas()  # bounded by ``sample``
    centres = fit(np.stack(fitted["v"].to_numpy()).astype(np.float64), eta)

    width = 4 if dict(rows.dtypes)["v"] == "array<float>" else 8
    blocks = blocks or max(min(partitions(spark), -(-n // 512)), -(-n * dims * width // BLOCK_BYTES))
    own = share_of(int(rerank * max(1.0, n / RERANK_ROWS) ** 0.5), blocks, k)
    data = rows.select(F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block"), F.lit(False).alias("query"), "id", "v")
    queries = rows.where(F.col("id") % every == 0).select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(True).alias("query"), "id", "v")

    def search(batches):
        held, block, at = [], None, None
        for batch in batches:
            number, query, ids = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            x = batch.column(3).flatten().to_numpy().reshape(len(ids), dims)
            cut = np.flatnonzero((number[1:] != number[:-1]) | (query[1:] != query[:-1])) + 1
            out: list[list] = [[], [], []]
            for a, b in zip([0, *cut.tolist()], [*cut.tolist(), len(ids)], strict=True):
                if a == b:
                    continue
                if number[a] != at:
                    held, block, at = [], None, number[a]
                if not query[a]:
                    held.append((ids[a:b].copy(), x[a:b].copy()))
                    continue
                if block is None and held:
                    block, held = Block(*(np.concatenate(parts) for parts in zip(*held, strict=True)), centres, eta), []
                for name, vector in zip(ids[a:b].tolist(), x[a:b].astype(np.float64), strict=True) if block else ():
                    found = block.nearest(name, vector, k, own)
                    out[0] += [name] * len(found)
                    out[1] += [v for _, v in found]
                    out[2] += [-s for s, _ in found]
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.float64())], names=["query_id", "vec_id", "score"])

    met = data.unionByName(queries).repartition(max(1, min(blocks, partitions(spark) * 8)), "block").sortWithinPartitions("block", "query")
    found = met.mapInArrow(tidy(search), "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
