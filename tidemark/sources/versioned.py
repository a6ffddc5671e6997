"""A table that is changed in place: versioned buckets under a manifest.

Rows lie in buckets by a hash of their key.  A merge reads the buckets that its changes touch,
writes those anew under the next version's folder, and then publishes a manifest that names
each bucket's folder; untouched buckets stay where they are.  A manifest appears whole by one
rename to a name that no other merge can take, so a reader sees one version or the next, and
the later of two merges at once fails and may be repeated.  What a reader has open stays until
``vacuum``.

    root/manifests/000000000007.json
    root/data/v=7/bucket=12/part-...
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable, Sequence
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Buckets of a new store; a merge of a few keys rewrites a share of it that falls with them.
BUCKETS = 64
BUCKET = "bucket"


class Conflict(RuntimeError):
    """Another merge has published the version that this one began to write."""


@dataclass
class Manifest:
    version: int = 0
    buckets: int = BUCKETS
    keys: list[str] = field(default_factory=list)
    schema: dict | None = None
    #: Of each bucket that has rows the folder it lies in.
    folders: dict[str, str] = field(default_factory=dict)
    #: Of each writer that numbers its batches the last one that is in.
    writers: dict[str, int] = field(default_factory=dict)


class Files:
    """The few file operations that Spark's own readers and writers lack."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm, self.root = spark._jvm, root.rstrip("/")
        self.fs = self.path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def names(self, folder: str) -> list[str]:
        where = self.path(folder)
        return sorted(x.getPath().getName() for x in self.fs.listStatus(where)) if self.fs.exists(where) else []

    def read(self, name: str) -> str:
        stream = self.fs.open(self.path(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def publish(self, name: str, text: str) -> bool:
        """Write ``name`` as a whole; False if it is there already."""
        part = self.path(f"{name}.{uuid.uuid4().hex}.tmp")
        stream = self.fs.create(part)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        # Hadoop's rename does not replace a file; local file systems are asked first.
        if self.fs.exists(self.path(name)) or not self.fs.rename(part, self.path(name)):
            self.fs.delete(part, False)
            return False
        return True

    def delete(self, name: str) -> None:
        self.fs.delete(self.path(name), True)


class Store:
    """A versioned table at ``root``, made by its first merge."""

    def __init__(self, spark: SparkSession, root: str, keys: Sequence[str] = (), buckets: int = BUCKETS):
        self.spark, self.files = spark, Files(spark, root)
        self.keys, self.buckets = list(keys), buckets

    def versions(self) -> list[int]:
        return [int(m[1]) for n in self.files.names("manifests") if (m := re.fullmatch(r"(\d{12})\.json", n))]

    def manifest(self, version: int | None = None) -> Manifest:
        """The newest version's, or that of ``version``; an empty one before any merge."""
        there = self.versions()
        if version is None and not there:
            return Manifest(buckets=self.buckets, keys=self.keys)
        return Manifest(**json.loads(self.files.read(f"manifests/{max(there) if version is None else version:012d}.json")))

    def _rows(self, m: Manifest, buckets: Sequence[str] | None = None) -> DataFrame | None:
        if m.schema is None:
            return None
        schema = StructType.fromJson(m.schema)
        folders = [f"{self.files.root}/{m.folders[b]}" for b in (m.folders if buckets is None else buckets) if b in m.folders]
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def read(self, version: int | None = None) -> DataFrame | None:
        """The rows of one version, whatever is merged meanwhile; None before any merge."""
        return self._rows(self.manifest(version))

    def bucket(self, m: Manifest) -> Column:
        return F.pmod(F.xxhash64(*[F.col(f"`{k}`") for k in m.keys]), F.lit(m.buckets)).cast("int")

    def merge(self, changes: DataFrame, how: Callable[[DataFrame, DataFrame], DataFrame], *, order: Sequence[str] = (), batch: tuple[str, int] | None = None) -> int:
        """The version after ``how(stored, changes)`` in the buckets that changes touch.

        ``how`` gets the stored rows of those buckets and all changes, and returns rows whose
        keys lie in them; equal keys stay together, so it may group and join by key.  ``batch``
        ``(writer, number)``: a number that isn't above the writer's last one is left out, so
        that a repeated batch changes nothing.  ``order`` sorts rows within files.  Without
        changed rows no version is made.  Keys may be null; a bucket is written by several
        tasks where it is large, and Spark's own splits read it.
        """
        m = self.manifest()
        if batch and m.writers.get(batch[0], -1) >= batch[1]:
            return m.version
        if not m.keys:
            raise ValueError("a new store needs its keys")
        touched = sorted(r[0] for r in changes.select(self.bucket(m).alias(BUCKET)).distinct().collect())  # ``buckets`` at most
        if not touched:
            return m.version
        stored = self._rows(m, [str(b) for b in touched])
        merged = how(changes.limit(0) if stored is None else stored, changes)
        number = m.version + 1
        folder = f"data/v={number}-{uuid.uuid4().hex[:8]}"
        # A bucket that grows is cut by AQE, as rebalanced partitions may be.
        rows = merged.withColumn(BUCKET, self.bucket(m)).hint("rebalance", BUCKET)
        if order:
            rows = rows.sortWithinPartitions(BUCKET, *order)
        rows.write.partitionBy(BUCKET).parquet(f"{self.files.root}/{folder}")
        written = {n.removeprefix(f"{BUCKET}="): f"{folder}/{n}" for n in self.files.names(folder) if n.startswith(f"{BUCKET}=")}
        folders = {b: f for b, f in m.folders.items() if int(b) not in touched} | written
        after = Manifest(number, m.buckets, m.keys, json.loads(merged.schema.json()), folders, m.writers | ({batch[0]: batch[1]} if batch else {}))
        if not self.files.publish(f"manifests/{number:012d}.json", json.dumps(asdict(after))):
            self.files.delete(folder)
            raise Conflict(f"version {number} was published by another merge")
        return number

    def vacuum(self, keep: int = 2) -> None:
        """Remove what only versions before the last ``keep`` need."""
        there = sorted(self.versions())
        held = {f.split("/")[1] for v in there[-keep:] for f in self.manifest(v).folders.values()}
        for v in there[:-keep]:
            self.files.delete(f"manifests/{v:012d}.json")
        for name in self.files.names("data"):
            if name not in held and int(name.removeprefix("v=").split("-")[0]) <= there[-1]:
                self.files.delete(f"data/{name}")


def upserted(keys: Sequence[str], newest: str | None = None) -> Callable[[DataFrame, DataFrame], DataFrame]:
    """Changes take the place of stored rows of their key; of changes that share a key the one
    with the largest ``newest`` counts (and of those that tie the largest row)."""

    def how(stored: DataFrame, changes: DataFrame) -> DataFrame:
        rest = [c for c in stored.columns if c not in keys]
        order = F.struct(*([F.col(newest)] if newest else []), *rest)
        once = changes.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("r")).select(*keys, "r.*")
        on = [F.col(f"s.{k}").eqNullSafe(F.col(f"c.{k}")) for k in keys]
        kept = stored.alias("s").join(once.select(*keys).alias("c"), on, "left_anti")
        return kept.unionByName(once.select(*stored.columns))

    return how
