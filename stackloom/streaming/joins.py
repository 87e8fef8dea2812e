"""Stream-stream joins and labelling of streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stackloom.operators.stacks import requested_stacktraces
from stackloom.schema import CUDA, LABEL_TTL_NS
from stackloom.streaming.report import Flush


def gpu_kernel_times_stream(
    launches: DataFrame, timings: DataFrame, bound: str = "1 minute", watermark: str = "10 minutes", how: str = "inner"
) -> DataFrame:
    """Launches joined to kernel timings that lie within ``bound`` of them, whichever comes first.

    Both sides hold ``node, pid, correlation_id, ts``: process and correlation ids repeat over machines. State on either side is dropped when the watermark says
    that no partner can come any more; ``how='leftOuter'`` shows the launches dropped that way.
    """
    left = launches.withWatermark("ts", watermark).alias("l")
    right = timings.withWatermark("ts", watermark).alias("t")
    span = F.expr(f"INTERVAL {bound}")
    same = ((F.col("l.node") == F.col("t.node")) & (F.col("l.pid") == F.col("t.pid"))
            & (F.col("l.correlation_id") == F.col("t.correlation_id")) & F.col("t.ts").between(F.col("l.ts") - span, F.col("l.ts") + span))
    kept = [F.col(f"l.{c}") for c in launches.columns if c not in ("raw_value", "origin")]
    return left.join(right, same, how).select(
        *kept, F.col("t.kernel_name"), F.col("t.duration_ns").alias("raw_value"), F.lit(CUDA).alias("origin"))


def gpu_unmatched_stream(launches: DataFrame, timings: DataFrame, bound: str = "1 minute", watermark: str = "10 minutes") -> DataFrame:
    """``side, correlation`` columns of entries that are cleared unmatched: a launch without kernels, a timing without its launch.

    Entries of a key that follow each other within ``bound`` form a session, so partners lie in the same one. A session comes out
    when the watermarks of both sides say that nothing can join it any more, which is when its state is dropped: one row for a launch
    with all its timings, where a full outer join would keep each entry twice. :func:`cleared_counts` counts them per trigger.
    Entries without a time stay out.
    """
    keys = ["node", "pid", "correlation_id"]
    span = F.expr(f"INTERVAL {bound}")
    entries = lambda rows, side: rows.withWatermark("ts", watermark).select(*keys, "ts", F.lit(side).alias("side"))
    times = lambda side: F.collect_list(F.when(F.col("side") == side, F.col("ts"))).alias(side)
    alone = lambda side, other: F.transform(
        F.filter(side, lambda x: ~F.exists(other, lambda y: y.between(x - span, x + span))), lambda _: F.lit(side))
    # an end of a session is no longer in it, and entries exactly ``bound`` apart are partners
    sessions = entries(launches, "launch").unionByName(entries(timings, "timing")).groupBy(
        *keys, F.session_window("ts", f"{bound} 1 microsecond")).agg(times("launch"), times("timing"))
    return sessions.select(F.explode(F.concat(alone("launch", "timing"), alone("timing", "launch"))).alias("side"), *keys)


def answered_requests(read_stacks: Callable[[], DataFrame], flush: Flush) -> Flush:
    """Answer the ids that a store asks for (``stacktrace_id``) with their stacks: the second half of the two-phase exchange as a stream.

    ``read_stacks`` opens the stack table, once per batch, so that stacks written meanwhile count. An id asked for twice in a batch is
    answered once; an unknown id gives a placeholder marked ``is_missing``.
    """
    return lambda batch, batch_id: flush(requested_stacktraces(batch, read_stacks()), batch_id)


def cleared_counts(flush: Flush) -> Flush:
    """A flush of the number of entries cleared by side in each trigger."""
    return lambda batch, batch_id: flush(batch.groupBy("side").agg(F.count(F.lit(1)).alias("cleared")), batch_id)


def labelled_flush(
    label: Callable[[DataFrame, DataFrame], DataFrame], read_processes: Callable[[], DataFrame], flush: Flush,
    ttl_ns: int = LABEL_TTL_NS,
) -> Flush:
    """Label every batch before it is flushed.

    ``read_processes`` opens the process table; it is called once per batch, so observations written meanwhile count at once
    (a DataFrame made once would keep the files of that moment). ``label(batch, processes)`` runs the batch operator, whose
    as-of join honours the label lifetime. Only observations that can still matter to the batch reach it: those from
    ``ttl_ns`` before its first row to its last.
    """
    def each(batch: DataFrame, batch_id: int) -> None:
        first, last = batch.agg(F.min("ts_ns"), F.max("ts_ns")).first()
        if first is None:
            return
        fresh = read_processes().where(F.col("observed_ns").between(first - ttl_ns, last))
        flush(label(batch, fresh), batch_id)
    return each
