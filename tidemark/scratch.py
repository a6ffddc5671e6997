"""Tables written on the way, in the folder that all nodes share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def scratch_root(spark: SparkSession) -> str:
    """Folder for intermediate tables: below ``spark.checkpoint.dir``, which all nodes share.

    Where that setting is absent, a single machine (tests) gets a temporary folder; on a
    cluster executors couldn't see each other's, so that is an error.
    """
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir", "") or spark.conf.get("spark.checkpoint.dir", "")
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all nodes share")
        root = "file://" + tempfile.mkdtemp(prefix="tidemark-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/tidemark-{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"


#: Folders of the tables that this driver has saved, in order.
_saved: list[str] = []


def saved(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage of ``df``: write it once to the shared folder and read it back."""
    spark, path = df.sparkSession, scratch_path(df.sparkSession, name)
    df.write.mode("overwrite").parquet(path)
    _saved.append(path)
    return spark.read.schema(df.schema).parquet(path)


def saved_in_steps(df: Callable[[], DataFrame], name: str) -> DataFrame:
    """Save what ``df()`` gives, and remove the tables that were saved on the way to it.

    Nothing else may read those: they are the steps of this one result.
    """
    before = len(_saved)
    out = saved(df(), name)
    for path in _saved[before:-1]:
        remove(out.sparkSession, path)
    del _saved[before:-1]
    return out


def remove(spark: SparkSession, path: str) -> None:
    """Remove a folder, if it is there."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def clear_scratch(spark: SparkSession) -> None:
    """Remove this application's intermediate tables (call when results are written)."""
    remove(spark, scratch_root(spark))
    _saved.clear()
