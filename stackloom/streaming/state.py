"""Keyed state of streams: answers with a lifetime, and retries by timers.

Both processors see the rows of one key in order of time, so what they say does not depend on how a stream is cut into
micro-batches: what a batch says of the same rows is what a stream says of them. State is one small value per key.
"""

from __future__ import annotations

import time
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from stackloom.functions.host import container_from_cgroup
from stackloom.operators.fleet import UPLOAD_RETRY_NS
from stackloom.schema import SECOND_NS

# Fixed value: how long a container id, and a failed look-up, is remembered.
CONTAINER_TTL_NS = 60 * SECOND_NS
LOOKUP = "node string, pid long, ts_ns long, container_id string, container_env int, answer string"
CHANGE = "file_id string, ts_ns long, action string"
LookupRow, ChangeRow = (Row(*[c.split()[0] for c in schema.split(", ")]) for schema in (LOOKUP, CHANGE))

# ---- container ids and failed look-ups ---------------------------------------------------------


def _looked(requests: DataFrame) -> DataFrame:
    """Requests with what a look-up at their time would find; ``found`` is false where the control group could not be read."""
    found = container_from_cgroup(F.col("cgroup_line"))
    return requests.select("node", "pid", "ts_ns", F.col("cgroup_line").isNotNull().alias("found"),
                           found["container_id"].alias("container_id"), found["env"].cast("int").alias("container_env"))


def _answers(rows: Iterable, held: tuple | None, ttl_ns: int) -> Iterator[tuple[tuple, tuple]]:
    """(output row, entry in force) for each row in order of time; an entry is (looked-up time, found, container, technology)."""
    values = ((r["node"], r["pid"], r["ts_ns"], r["found"], r["container_id"], r["container_env"]) for r in rows)
    for node, pid, ts_ns, found, container_id, env in sorted(values, key=lambda v: (v[2], v[4] or "", v[3])):
        if held is not None and ts_ns - held[0] <= ttl_ns:
            answer = "cached" if held[1] else "deferred"
        else:
            held = (ts_ns, found, container_id, env)
            answer = "looked_up" if found else "failed"
        yield (node, pid, ts_ns, held[2], held[3], answer), held


class _ContainerState(StatefulProcessor):
    def __init__(self, ttl_ns: int, evict_ms: int):
        self.ttl_ns, self.evict_ms = ttl_ns, evict_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.entry = handle.getValueState("entry", "ts_ns long, found boolean, container_id string, container_env int", self.evict_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        kept = self.entry.get()
        held = before = tuple(kept) if kept is not None else None
        for out, held in _answers(rows, before, self.ttl_ns):
            yield LookupRow(*out)
        if held is not before:  # each call to the store is a round trip, so only the last entry goes there
            self.entry.update(held)

    def close(self) -> None:
        pass


def container_lookups_stream(requests: DataFrame, ttl_ns: int = CONTAINER_TTL_NS, evict: int = 10) -> DataFrame:
    """Container id and technology of each request of a process (``node, pid, ts_ns, cgroup_line``), looked up once per lifetime.

    ``answer`` tells how: looked_up or cached, or, where the control group could not be read, failed, and deferred while the
    failure is remembered. Lifetimes go by the times of the rows; state is dropped ``evict`` lifetimes after its last
    look-up by the clock. A process's rows have to arrive in time order from batch to batch.
    """
    return _looked(requests).groupBy("node", "pid").transformWithState(
        _ContainerState(ttl_ns, evict * ttl_ns // 1_000_000), LOOKUP, "Append", "ProcessingTime")


def container_lookups(requests: DataFrame, ttl_ns: int = CONTAINER_TTL_NS) -> DataFrame:
    """The same of a table. A task holds the rows of one process at a time."""
    def answer(table: pa.Table) -> pa.Table:
        out = [row for row, _ in _answers(table.to_pylist(), None, ttl_ns)]
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.string())
        names = ("node", "pid", "ts_ns", "container_id", "container_env", "answer")
        return pa.table({n: pa.array([o[i] for o in out], k) for i, (n, k) in enumerate(zip(names, kinds))})

    return _looked(requests).groupBy("node", "pid").applyInArrow(answer, LOOKUP)


# ---- the work list of uploads ------------------------------------------------------------------

_DONE = ("uploaded", "final")
_RANK = {"seen": 0, "in_progress": 1, "uploaded": 2, "final": 2}


class _UploadState(StatefulProcessor):
    """Per file: queued, waiting until a time, or done."""

    def __init__(self, retry_ns: int, by_clock: bool):
        self.retry_ns, self.by_clock = retry_ns, by_clock

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", "status string, due_ns long")

    def _clear_timers(self) -> None:
        for due in list(self.handle.listTimers()):
            self.handle.deleteTimer(due)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        status, due = self.state.get() if self.state.exists() else (None, None)
        before = (status, due)
        for r in sorted(rows, key=lambda r: (r["ts_ns"], _RANK.get(r["status"], 3))):
            if status == "waiting" and not self.by_clock and due <= r["ts_ns"]:
                yield ChangeRow(key[0], due, "retry")  # was due before this row
                status, due = "queued", None
            if status == "done":
                break
            if r["status"] in _DONE:
                status, due = "done", None
            elif r["status"] == "in_progress":
                now = timerValues.getCurrentProcessingTimeInMs() * 1_000_000 if self.by_clock else r["ts_ns"]
                status, due = "waiting", now + self.retry_ns
            elif status is None:
                status = "queued"
                yield ChangeRow(key[0], r["ts_ns"], "upload")
        if (status, due) != before and status is not None:
            self._clear_timers()
            if due is not None:
                self.handle.registerTimer(-(-due // 1_000_000))
            self.state.update((status, due))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        status, due = self.state.get() if self.state.exists() else (None, None)
        if status == "waiting":
            self.state.update(("queued", None))
            yield ChangeRow(key[0], due, "retry")

    def close(self) -> None:
        pass


def worklist_changes_stream(files: DataFrame, retry_ns: int = UPLOAD_RETRY_NS, watermark: str = "10 minutes", by_clock: bool = False) -> DataFrame:
    """What is to be uploaded, when (``file_id, ts_ns, action``): ``upload`` for a file new to the work list, ``retry`` after a refusal.

    ``files`` holds ``file_id, ts_ns, ts, status``: seen, in_progress (somebody else is at it), uploaded or final. A refused file
    comes back ``retry_ns`` later unless it is uploaded, final or refused anew before; done files never do. Timers go by the
    times of the rows and fire when the watermark passes; ``by_clock`` makes them go by the clock of the cluster.
    """
    mode = "ProcessingTime" if by_clock else "EventTime"
    # event-time timers need a watermark, not an event-time output
    return files.withWatermark("ts", watermark).groupBy("file_id").transformWithState(
        _UploadState(retry_ns, by_clock), CHANGE, "Append", mode)


def stop_when_idle(query: StreamingQuery) -> None:
    """Stop a query that goes by the clock, and so never ends by itself, after a trigger that found nothing new.

    A trigger may take any time. The first one may repeat an empty batch of an earlier run without looking for rows, so an
    empty trigger counts from the second on.
    """
    while query.isActive:
        rows = [p["numInputRows"] for p in query.recentProgress]
        if rows and not rows[-1] and (any(rows) or len(rows) > 1):
            break
        time.sleep(0.1)
    failure = query.exception()
    query.stop()
    if failure:
        raise failure


@contextmanager
def state_store(spark: SparkSession) -> Iterator[None]:
    """Keyed state needs a store that holds several values per key; the session's own setting comes back afterwards."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(name, before) if before else spark.conf.unset(name)
