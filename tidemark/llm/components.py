"""Connected components of a link table, without gathering a component anywhere."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved, tidy

#: Links that one task's union-find holds (two numbers each and as many dict entries).
TASK_LINKS = 1_000_000


def _forest(batches):
    """Union-find over one partition's links: one link to the smallest node each."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        top = x
        while (up := parent.get(top, top)) != top:
            top = up
        while (up := parent.get(x, x)) != top:
            parent[x], x = top, up
        return top

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = root(a), root(b)
            if a != b:
                lo, hi = (a, b) if a < b else (b, a)
                parent[hi] = lo
                parent.setdefault(lo, lo)
    pairs = [(x, root(x)) for x in parent if parent[x] != x]
    out = np.array(pairs, np.int64).reshape(-1, 2)
    for i in range(0, len(out), 100_000):
        part = out[i : i + 100_000]
        yield pa.RecordBatch.from_arrays([pa.array(part[:, 0]), pa.array(part[:, 1])], names=["a", "b"])


def contracted(links: DataFrame) -> DataFrame:
    """The same components with at most one link per node and partition."""
    return links.select("a", "b").mapInArrow(tidy(_forest), "a long, b long")


def _star(links: DataFrame, large: bool) -> DataFrame:
    """One large-star or small-star step: neighbours of a node move to its least one."""
    if large:
        near = links.union(links.select("b", "a")).toDF("u", "v")
        keep = F.col("v") > F.col("u")
    else:
        near = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        keep = F.lit(True)
    least = near.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("m", "u").alias("m"))
    moved = near.join(least, near.u == least.w).where(keep).select(F.col("v").alias("a"), F.col("m").alias("b"))
    if not large:
        moved = moved.union(least.select("w", "m"))
    return moved.where("a <> b").distinct()


def _settled(links: DataFrame) -> bool:
    """Whether each node has one link, and that to a node without one."""
    heads = links.groupBy("a").agg(F.count("*").alias("n"))
    ends = links.select(F.col("b").alias("end")).distinct()
    return heads.join(ends, heads.a == ends.end, "left").where("n > 1 or end is not null").isEmpty()


def components(links: DataFrame, name: str = "components", task_links: int = TASK_LINKS) -> DataFrame:
    """``(node, root)`` for every linked node; root is the component's least node.

    Union-find runs within partitions of ``task_links`` links.  What fits one partition is
    done then; more alternates large-star and small-star rounds (Kiveris et al. 2014) with
    union-find until each node has one link to a root, in rounds that grow with the
    logarithm of the longest path.  Links with a null end are ignored; no links give no rows.
    """
    links = saved(links.select("a", "b").where("a <> b"), name)
    while True:
        parts = -(-links.count() // task_links)
        links = saved(contracted(links.coalesce(max(1, parts))), name)
        if parts <= 1 or _settled(links):
            return links.select(F.col("a").alias("node"), F.col("b").alias("root"))
        links = saved(_star(_star(links, True), False), name)
