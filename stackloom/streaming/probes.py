"""Probe spans of a stream of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from stackloom.operators.probes import scopes_and_open
from stackloom.operators.sequence import HOUR_NS
from stackloom.session import remove_dir
from stackloom.streaming.report import Flush


class ScopePairing:
    """A flush that pairs the edges of every batch and keeps open scopes between batches.

    The state is a table: one row per thread with an open scope, a folder per batch below ``state_path``.
    A repeated batch reads the state of the batch before it and writes the same folder again, so results
    survive restarts. Pairing itself is the batch operator, so a busy thread is cut into slices here too.
    Edges of a thread have to arrive in time order from batch to batch. Scopes stay open however long they last, as in
    the batch operator, at one row per open thread; a ``lifetime_ns`` forgets those that are open for longer. Of the
    state folders only the last two are needed; older ones are removed.
    """

    def __init__(self, keys: list[str], state_path: str, flush: Flush, width: int = HOUR_NS,
                 lifetime_ns: int | None = None):
        self.keys, self.state_path, self.flush = keys, state_path, flush
        self.width, self.lifetime_ns = width, lifetime_ns

    def _state(self, edges: DataFrame, batch_id: int) -> DataFrame | None:
        spark = edges.sparkSession
        return spark.read.parquet(f"{self.state_path}/{batch_id - 1}") if batch_id else None

    def __call__(self, edges: DataFrame, batch_id: int) -> None:
        edges.persist()
        try:
            state = self._state(edges, batch_id)
            spans, still_open = scopes_and_open(edges, self.keys, self.width, state)
            self.flush(spans, batch_id)
            if self.lifetime_ns is not None:
                latest = edges.agg(F.max("ts_ns")).first()[0] or 0
                still_open = still_open.where(F.col("open_ns") >= F.lit(latest - self.lifetime_ns))
            still_open.write.mode("overwrite").parquet(f"{self.state_path}/{batch_id}")
            remove_dir(edges.sparkSession, f"{self.state_path}/{batch_id - 2}")
        finally:
            edges.unpersist()

    def start(self, edges: DataFrame, checkpoint: str, interval: str | None = "5 seconds") -> StreamingQuery:
        """Pair a stream of edges; without ``interval`` the query works off what is there and ends."""
        writer = edges.writeStream.foreachBatch(self).option("checkpointLocation", checkpoint)
        return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()
