"""Counters out of running streams."""

from __future__ import annotations

import logging
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

log = logging.getLogger(__name__)


class CounterListener(StreamingQueryListener):
    """Turns what streams ``observe`` into a table ``stream, batch_id, counter, n`` below ``path``, a folder per trigger.

    Register it with ``spark.streams.addListener``. ``names`` are the observations to keep (see ``metrics.observe_counters``). A
    repeated batch replaces its folder. Counting costs the stream nothing but the observation.
    """

    def __init__(self, spark: SparkSession, path: str, *names: str):
        self.spark, self.path, self.names = spark, path, names
        self.seen: dict[str, int] = {}

    def onQueryStarted(self, event) -> None:
        self.seen[str(event.runId)] = 0

    def onQueryProgress(self, event) -> None:
        progress = event.progress
        rows = [(str(progress.id), progress.batchId, counter, int(n)) for name in self.names
                for counter, n in (progress.observedMetrics[name].asDict().items() if name in progress.observedMetrics else ()) if n]
        if rows:
            (self.spark.createDataFrame(rows, "stream string, batch_id long, counter string, n long").coalesce(1)
             .write.mode("overwrite").parquet(f"{self.path}/trigger={progress.id}-{progress.batchId}"))
        self.seen[str(progress.runId)] = self.seen.get(str(progress.runId), 0) + 1

    def onQueryTerminated(self, event) -> None:
        if event.exception:
            log.warning("stream %s ended: %s", event.id, event.exception)

    def wait_for(self, query: StreamingQuery, patience: float = 60.0) -> None:
        """Until all progress of an ended query has been taken in: events reach a listener with a delay."""
        end = time.monotonic() + patience
        while self.seen.get(str(query.runId), 0) < len(query.recentProgress):
            if time.monotonic() > end:
                raise TimeoutError("the listener did not get all progress of the query")
            time.sleep(0.05)

    def totals(self) -> DataFrame:
        """``counter, n`` over all triggers so far."""
        return (self.spark.read.schema("stream string, batch_id long, counter string, n long").parquet(self.path)
                .groupBy("counter").agg(F.sum("n").alias("n")))
