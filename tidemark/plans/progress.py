"""Progress of plans and streams, counted in the pass that does the work."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener


def observed(df: DataFrame, observation: Observation | str | None, **tests: Column) -> DataFrame:
    """``df``, of which an observation gets ``rows`` and how many rows pass each test.

    A batch plan takes an ``Observation``, whose ``get`` has the counts once a job has run; a
    stream takes a name, under which its batches' progress has them.  None: nothing is counted.
    """
    if observation is None:
        return df
    return df.observe(observation, F.count("*").alias("rows"), *[F.count_if(t).alias(name) for name, t in tests.items()])


class Progress(StreamingQueryListener):
    """Calls ``report`` with each batch's query, number, input rows and observed counts, and
    with the error (or None) of each query that ends.  What ``report`` raises is Spark's to log.

    ``spark.streams.addListener(Progress(print))``
    """

    def __init__(self, report: Callable[[dict], None]):
        self.report = report

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        counts = {name: row.asDict() for name, row in p.observedMetrics.items()}
        self.report({"query": p.name or str(p.id), "batch": p.batchId, "rows": p.numInputRows, "seconds": p.batchDuration / 1000, "counts": counts})

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.report({"query": str(event.id), "ended": True, "error": event.exception})
