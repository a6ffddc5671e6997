"""Exact duplicates by a Golomb-coded fingerprint exchange.

1.  Every task hashes the normalised texts of as many splits as give ``BLOCK_ROWS`` rows
    (SHA-256; 60 bits are the fingerprint) and keeps blocks of rows whose fingerprints are
    sorted.
2.  A block (``BLOCK_ROWS`` rows) sends each owner its distinct fingerprints as Golomb-Rice codes of the sorted
    gaps: about log2(range / entries) + 1.5 bits each, and one per block for a hot text.
3.  The owner of a range answers with one bit per fingerprint: met in two blocks or more.
4.  Only rows with a set bit, or with a twin in their own block, are suspects; their texts
    are shuffled (after map-side grouping) and grouped by their bytes.  Groups are equal
    SHA-256 digests, and that each digest of a suspect stands for one text only is verified
    on the bytes: a clash is an error.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, partitions, saved, tidy

PRINT_BITS = 60
#: Fingerprints that one owner gets on average.
OWNER_ROWS = 4_000_000
#: Rows of a block: the more, the denser each owner's list, and the fewer bits a gap takes.
BLOCK_ROWS = 250_000
#: Suspect rows up to which their ids (16 bytes each) are broadcast; beyond, ids are joined.
BROADCAST_ROWS = 250_000
#: Groups of copies up to which their table (100 bytes each) is broadcast; beyond, it is joined.
BROADCAST_GROUPS = 50_000


def normalised(text: Column) -> Column:
    """The text without blanks and tab to carriage return; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), " \t\n\x0b\x0c\r", "")


def rice_encode(values: np.ndarray) -> tuple[int, bytes, bytes]:
    """Sorted distinct numbers from 0 on as (k, unary quotients, k-bit remainders) of gaps."""
    gaps = np.diff(values, prepend=0)
    k = max(0, int(np.mean(gaps)).bit_length() - 1)
    quotients = gaps >> k
    unary = np.zeros(int(quotients.sum()) + len(gaps), np.uint8)
    unary[np.cumsum(quotients + 1) - 1] = 1
    rest = (gaps[:, None] >> np.arange(k)) & 1 if k else np.zeros((0, 0))
    return k, np.packbits(unary).tobytes(), np.packbits(rest.astype(np.uint8).ravel()).tobytes()


def rice_decode(n: int, k: int, unary: bytes, rest: bytes) -> np.ndarray:
    stops = np.flatnonzero(np.unpackbits(np.frombuffer(unary, np.uint8)))[:n]
    gaps = (np.diff(stops, prepend=-1) - 1) << k
    if k:
        bits = np.unpackbits(np.frombuffer(rest, np.uint8), count=n * k).reshape(n, k)
        gaps = gaps + (bits.astype(np.int64) << np.arange(k)).sum(1)
    return np.cumsum(gaps)


def _blocks(rows: DataFrame, owner_bits: int, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Rows with their place in a block (kind 0), and the coded lists (kind 1)."""
    shift = PRINT_BITS - owner_bits
    kind_of_id = dict(rows.dtypes)["doc_id"]

    def gathered(batches):
        """Blocks of ``block_rows`` rows, the partition's last one shorter."""
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= block_rows:
                yield pa.concat_batches(held)
                held, n = [], 0
        if n:
            yield pa.concat_batches(held)

    def run(batches):
        number = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 32
        for batch in gathered(batches):
            fp = batch.column(3).to_numpy()
            order = np.argsort(fp, kind="stable")
            prints, inverse, counts = np.unique(fp, return_inverse=True, return_counts=True)
            owner = prints >> shift
            first = np.searchsorted(owner, owner)
            slot = np.arange(len(prints)) - first
            taken = batch.take(pa.array(order))
            place = inverse[order]
            n, block = batch.num_rows, number
            number += n
            none = pa.nulls(n, pa.binary())
            placed = pa.RecordBatch.from_arrays([
                pa.array(np.zeros(n, np.int32)), taken.column(0), taken.column(1), taken.column(2),
                pa.array(block + np.arange(n)), pa.array(counts[place] > 1),
                pa.array(np.full(n, block)), pa.array(owner[place]), pa.array(slot[place]), pa.array(np.zeros(n, np.int32)), none, none,
            ], names=names)
            yield from (placed.slice(i, 10_000) for i in range(0, n, 10_000))
            heads = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]])) if n else np.zeros(0, int)
            coded = []
            for a, b in zip(heads.tolist(), [*heads[1:].tolist(), len(owner)], strict=True):
                k, unary, rest = rice_encode(prints[a:b] - (owner[a] << shift))
                coded.append((owner[a], b - a, k, unary, rest))
            if coded:
                o, m, k, unary, rest = zip(*coded, strict=True)
                c = len(coded)
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.ones(c, np.int32)), pa.nulls(c, taken.schema.field(0).type), pa.nulls(c, pa.string()), pa.nulls(c, pa.int64()),
                    pa.nulls(c, pa.int64()), pa.nulls(c, pa.bool_()), pa.array(np.full(c, block)), pa.array(np.array(o)), pa.array(np.array(m, np.int64)), pa.array(np.array(k, np.int32)), pa.array(unary, pa.binary()), pa.array(rest, pa.binary()),
                ], names=names)

    fields = [("kind", "int"), ("doc_id", kind_of_id), ("text_sha256", "string"), ("points", "long"), ("row", "long"), ("twin", "boolean"), ("block", "long"), ("owner", "long"), ("slot", "long"), ("k", "int"), ("unary", "binary"), ("rest", "binary")]
    names = [n for n, _ in fields]
    return rows.mapInArrow(tidy(run), ", ".join(f"{n} {t}" for n, t in fields))


def _answers(coded: DataFrame) -> DataFrame:
    """Owners decode all lists of their range and return a bitmap for each block."""

    def answer(rows):
        lists = [rice_decode(r["slot"], r["k"], r["unary"], r["rest"]) for r in rows]
        values = np.concatenate(lists)
        _, inverse, counts = np.unique(values, return_inverse=True, return_counts=True)
        bits = (counts > 1)[inverse]
        at = np.cumsum([0, *map(len, lists)])
        for r, a, b in zip(rows, at[:-1].tolist(), at[1:].tolist(), strict=True):
            if bits[a:b].any():
                yield r["block"], r["owner"], np.packbits(bits[a:b], bitorder="little").tobytes()

    def run(batches):
        def flush(rows):
            out = list(answer(rows))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["block", "owner", "bits"])

        held: list[dict] = []
        for batch in batches:
            for row in batch.to_pylist():
                if held and held[-1]["owner"] != row["owner"]:
                    yield from flush(held)
                    held = []
                held.append(row)
        if held:
            yield from flush(held)

    lists = coded.select("block", "owner", "slot", "k", "unary", "rest")
    return lists.repartition(partitions(coded.sparkSession), "owner").sortWithinPartitions("owner").mapInArrow(tidy(run), "block long, owner long, bits binary")


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, keep_id, group_size, kept, text_sha256)``, one row per row of ``docs``.

    Texts are equal when they are the same bytes after white space goes (null: empty).  Of
    equal ones the row with the most code points stays, then the least id (a null id last),
    then one of the rows that tie in both.  Other columns are ignored, whatever their names;
    no rows give none.
    """
    spark = docs.sparkSession
    count = docs.count()
    owners = max(partitions(spark) * 2, count // OWNER_ROWS)
    bits = max(1, (owners - 1).bit_length())
    digest = F.sha2(normalised(F.col(text_col)).cast("binary"), 256)
    rows = docs.select(F.col(id_col).alias("doc_id"), digest.alias("text_sha256"), F.coalesce(F.char_length(text_col), F.lit(0)).cast("long").alias("points"))
    rows = rows.withColumn("print", F.conv(F.substring("text_sha256", 1, 15), 16, 10).cast("long"))
    # A split of texts has too few rows for dense lists: a task hashes those of many splits, one
    # after another, and codes what is left of them together; nothing is shuffled for that.
    table = saved(_blocks(rows.coalesce(max(partitions(spark), -(-count // BLOCK_ROWS))), bits), "prints")
    members = table.where("kind = 0").select("doc_id", "text_sha256", "points", "row", "twin", "block", "owner", "slot")

    bitmaps = saved(_answers(table.where("kind = 1")), "bitmaps")
    met = F.expr("coalesce(getbit(cast(conv(hex(substring(bits, cast(slot div 8 as int) + 1, 1)), 16, 10) as int), cast(slot % 8 as int)) = 1, false)")
    suspects = members.join(bitmaps, ["block", "owner"], "left").where(F.col("twin") | met)
    suspects = saved(suspects.select("doc_id", "text_sha256", "points", "row"), "suspects")

    ids = suspects.select(F.col("doc_id").alias("__suspect")).distinct()
    few = ids.count() <= BROADCAST_ROWS
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    texts = texts.join(F.broadcast(ids) if few else ids, F.col("doc_id").eqNullSafe(F.col("__suspect")), "left_semi")
    bodies = texts.select(normalised(F.col("text")).alias("body")).groupBy("body").agg(F.count("*").alias("copies"))
    checked = bodies.select(F.sha2(F.col("body").cast("binary"), 256).alias("text_sha256")).groupBy("text_sha256").agg(F.count("*").alias("texts"))
    checked = checked.select("text_sha256", F.when(F.col("texts") > 1, F.raise_error(F.lit("two texts share a SHA-256 digest")).cast("int")).alias("clash"))

    best = F.min(F.struct((-F.col("points")).alias("p"), F.col("doc_id").isNull().alias("u"), F.col("doc_id").alias("i"), F.col("row").alias("r")))
    groups = suspects.groupBy("text_sha256").agg(best.alias("best"), F.count("*").alias("group_size")).where("group_size > 1")
    groups = groups.join(checked, "text_sha256").where("clash is null").select("text_sha256", F.col("best.i").alias("keep"), F.col("best.r").alias("keep_row"), "group_size")
    # As a table of its own, so that a hot text's rows are split where the join shuffles.
    groups = saved(groups, "groups")
    if groups.count() <= BROADCAST_GROUPS:
        groups = F.broadcast(groups)
    out = members.select("doc_id", "text_sha256", "row").join(groups, "text_sha256", "left")
    alone = F.col("keep_row").isNull()
    return out.select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("keep")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("keep_row") == F.col("row"))).alias("kept"),
        "text_sha256",
    )


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: one of each text.

    Which one is as in ``exact_duplicates``; of rows with one id and one text, any of those
    with the most code points.  Null ids are ids like others, null texts are empty, no rows
    give none, and columns may have any names.
    """
    found = saved(exact_duplicates(docs, id_col, text_col), "decisions")
    name, sha, points = (fresh(c, docs.columns) for c in ("__id", "__sha", "__points"))
    per_id = found.groupBy("doc_id").agg(F.sum(F.col("kept").cast("int")).alias("stay"), F.count("*").alias("rows"))
    changed = saved(per_id.where("stay < rows").select(F.col("doc_id").alias(name), "stay"), "changed")
    same = docs[id_col].eqNullSafe(F.col(name))
    plain = docs.join(changed.select(name), same, "left_anti")
    mixed = changed.where("stay > 0").select(name)
    if mixed.isEmpty():
        return plain
    # An id with rows that stay and rows that go: match the rows by text, one of a tie.
    stay = found.where("kept").join(mixed, F.col("doc_id").eqNullSafe(F.col(name)), "left_semi").select(F.col("doc_id").alias(name), F.col("text_sha256").alias(sha))
    part = docs.join(mixed, same, "left_semi").withColumn(points, F.struct(F.coalesce(F.char_length(text_col), F.lit(0)).alias("n"), F.sha2(normalised(F.col(text_col)).cast("binary"), 256).alias("sha")))
    part = part.join(stay, part[id_col].eqNullSafe(F.col(name)) & (F.col(f"{points}.sha") == F.col(sha)), "left_semi")
    best = part.groupBy(id_col, f"{points}.sha").agg(F.max_by(F.struct(*[F.col(c) for c in docs.columns]), f"{points}.n").alias(name))
    return plain.unionByName(best.select(f"{name}.*"))
