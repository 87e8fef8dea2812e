"""Reporting in intervals: every flush writes what came in since the last one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from stackloom.schema import LABEL_TTL_NS, SECOND_NS
from stackloom.session import remove_dir, shared_dir
from stackloom.sources.tables import with_rotation

Flush = Callable[[DataFrame, int], None]


def parquet_flush(path: str, *partition_by: str) -> Flush:
    """A flush that writes each batch to a folder of its own; a repeated batch replaces its folder."""
    def write(batch: DataFrame, batch_id: int) -> None:
        (batch.write.mode("overwrite").partitionBy(*partition_by).option("compression", "zstd")
         .parquet(f"{path}/batch_id={batch_id}"))
    return write


class NewestTime:
    """The newest event time that a stream has seen, kept per batch below ``path``.

    A batch finds what the batches before it have left, also after a restart, and a repeated batch finds the same again. Two
    folders of one row stay.
    """

    def __init__(self, path: str):
        self.path = path

    def _kept(self, spark: SparkSession) -> list[tuple[int, int]]:
        target = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        if not target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target):
            return []
        rows = spark.read.schema("newest long, batch_id long").parquet(self.path)
        return sorted((r["batch_id"], r["newest"]) for r in rows.collect())

    def advance(self, batch: DataFrame, batch_id: int, time: str = "ts_ns") -> int | None:
        """The newest time up to and with this batch; None before any."""
        spark = batch.sparkSession
        kept = self._kept(spark)
        before = [newest for number, newest in kept if number < batch_id]
        own = batch.agg(F.max(time)).first()[0]
        newest = max([t for t in (*before, own) if t is not None], default=None)
        if newest is not None:
            (spark.createDataFrame([(newest,)], "newest long").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/batch_id={batch_id}"))
            for number in [number for number, _ in kept if number < batch_id][:-1]:
                remove_dir(spark, f"{self.path}/batch_id={number}")
        return newest


def splitting_flush(flush: Flush, late_flush: Flush, watermark_ns: int = LABEL_TTL_NS, state_path: str | None = None) -> Flush:
    """A flush that sends rows older than ``watermark_ns`` before the newest row seen so far to a side table.

    The newest time is that of the batch itself or of an earlier batch, whichever is later; it lives in a table below
    ``state_path``, so a restarted stream and a repeated batch split as the first run did; without a path it is a folder of this run
    alone. Rows without a time are in time. The batch is worked out once.
    """
    times = NewestTime(state_path) if state_path else None

    def each(batch: DataFrame, batch_id: int) -> None:
        nonlocal times
        times = times or NewestTime(shared_dir(batch.sparkSession, "newest"))
        batch = batch.persist()
        try:
            newest = times.advance(batch, batch_id)
            good, late = (batch, batch.limit(0)) if newest is None else late_rows(batch, newest, watermark_ns)
            flush(good, batch_id)
            late_flush(late, batch_id)
        finally:
            batch.unpersist()
    return each


def stream_report(stream: DataFrame, flush: Flush, checkpoint: str, interval: str | None = "5 seconds") -> StreamingQuery:
    """Flush the samples of every interval; an interval without samples is skipped.

    Without ``interval`` the query works off what is there and ends. The batch is kept while it is looked at
    and flushed, so that it is worked out, and counted by ``observe``, only once.
    """
    def each(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        try:
            if not batch.isEmpty():
                flush(batch, batch_id)
        finally:
            batch.unpersist()

    writer = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    writer = writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)
    return writer.start()


def stream_rotated(samples: DataFrame, path: str, checkpoint: str, interval: str | None = "5 seconds",
                   rotation_ns: int = 600 * SECOND_NS) -> StreamingQuery:
    """Samples into one compressed folder per rotation interval."""
    return stream_report(with_rotation(samples, rotation_ns), parquet_flush(path, "rotation"), checkpoint, interval)


def new_stacks_stream(samples: DataFrame, rotation_ns: int = 600 * SECOND_NS, watermark: str | None = None) -> DataFrame:
    """Each stack once per output file. State is dropped once the watermark has passed the interval.

    ``ts`` is the event time. State is kept for as long as the watermark, which therefore must not be shorter than the
    rotation interval; by default it is the longer of that and the label lifetime.
    """
    delay = watermark or f"{max(LABEL_TTL_NS, rotation_ns) // SECOND_NS} seconds"
    length = samples.sparkSession.sql(
        f"SELECT unix_micros(timestamp'1970-01-01 00:00:00' + INTERVAL {delay}) - unix_micros(timestamp'1970-01-01 00:00:00') AS us").first()["us"]
    if length * 1000 < rotation_ns:
        raise ValueError(f"a watermark of {delay} is shorter than the rotation interval: stacks would be written twice")
    return (with_rotation(samples, rotation_ns).withWatermark("ts", delay)
            .dropDuplicatesWithinWatermark(["rotation", "stacktrace_id"]))


def late_rows(samples: DataFrame, batch_time_ns: int, watermark_ns: int = LABEL_TTL_NS) -> tuple[DataFrame, DataFrame]:
    """A batch split into rows in time and rows the watermark has already passed (for a side table)."""
    late = F.coalesce(F.col("ts_ns") < F.lit(batch_time_ns - watermark_ns), F.lit(False))
    return samples.where(~late), samples.where(late)
