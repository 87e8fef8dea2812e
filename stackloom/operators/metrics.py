"""Counters of the pipeline itself and time-series arithmetic."""

from __future__ import annotations

import logging
from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stackloom.functions.values import metric_name, ns_to_ts
from stackloom.operators.sequence import HOUR_NS, previous_values
from stackloom.session import stored
from stackloom.schema import CUDA, GPU_PC, MEMORY, OFF_CPU, SAMPLING

log = logging.getLogger(__name__)

# Counter names of the event origins.
EVENT_TYPES = {SAMPLING: "cpu", CUDA: "gpu", GPU_PC: "gpu_pc", OFF_CPU: "offcpu", MEMORY: "memory"}


def pipeline_counters(events: DataFrame, written: DataFrame | None = None) -> DataFrame:
    """``counter, n``: kept events by type, events skipped by rules, events without frames, and rows ``written``.

    ``events`` holds ``origin``, ``keep`` and ``n_frames``. One aggregation over a short array per row.
    """
    name = F.lit(None).cast("string")
    for origin, label in EVENT_TYPES.items():
        name = F.when(F.col("origin") == origin, F.lit(label)).otherwise(name)
    kind = F.coalesce(name, F.lit("unknown"))
    marks = F.array(
        F.when(F.col("keep"), kind),
        F.when(~F.col("keep"), F.lit("skipped_by_relabeling")),
        F.when(F.col("keep") & (F.col("n_frames") == 0), F.lit("empty")))
    counters = (events.select(F.explode(F.filter(marks, lambda m: m.isNotNull())).alias("counter"))
                .groupBy("counter").agg(F.count(F.lit(1)).alias("n")))
    if written is None:
        return counters
    return counters.unionByName(written.agg(F.count(F.lit(1)).alias("n")).select(F.lit("written_rows").alias("counter"), "n"))


def observe_counters(events: DataFrame, name: str = "event_counters") -> DataFrame:
    """The same rows, counted by the way: a stream's progress and an ``Observation`` then hold the counters.

    Reads ``origin``, and ``keep`` and ``n_frames`` or ``frames`` where present. Costs no shuffle. ``streaming.counters`` turns what
    a stream observes into a table.
    """
    keep = F.col("keep") if "keep" in events.columns else F.lit(True)
    counts = [F.count_if(keep & (F.col("origin") == origin)).alias(label) for origin, label in EVENT_TYPES.items()]
    counts.append(F.count_if(keep & ~F.coalesce(F.col("origin").isin(*EVENT_TYPES), F.lit(False))).alias("unknown"))
    counts.append(F.count_if(~keep).alias("skipped_by_relabeling"))
    size = F.col("n_frames") if "n_frames" in events.columns else F.size("frames") if "frames" in events.columns else None
    if size is not None:
        counts.append(F.count_if(keep & (F.coalesce(size, F.lit(0)) <= 0)).alias("empty"))
    return events.observe(name, *counts)


def write_request_totals(requests: DataFrame) -> DataFrame:
    """Write requests by status code, with the bytes of samples and stacks."""
    return requests.groupBy("code").agg(
        F.count(F.lit(1)).alias("requests"), F.sum("sample_bytes").alias("sample_bytes"),
        F.sum("stack_bytes").alias("stack_bytes"))


def metric_points_rollup(points: DataFrame, metric_defs: DataFrame, by: list[str]) -> DataFrame:
    """Per metric: the last value of a gauge, the sum of a counter. Ids without definition are left out.

    Points are reduced per id first; definitions join the reduced rows.
    """
    reduced = points.groupBy(*by, "metric_id").agg(
        F.max_by("value", "ts_ns").alias("_last"), F.sum("value").alias("_sum"))
    defined = reduced.join(metric_defs.select("metric_id", "field", "metric_type", "unit"), "metric_id", "inner")
    return defined.select(
        *by, metric_name(F.col("field")).alias("metric"), "metric_type", "unit",
        F.when(F.col("metric_type") == "gauge", F.col("_last")).otherwise(F.col("_sum")).alias("value"))


def counter_increase(points: DataFrame, series: list[str], width: int = HOUR_NS, tie: str | None = None) -> DataFrame:
    """Points with ``increase`` since the preceding one of their series; a drop means a restart from zero.

    Points of one series and time come in order of ``tie``, or of their value without it.
    """
    steps = previous_values(points, series, "ts_ns", {"value": "_before"}, width, tie)
    value, before = F.col("value"), F.col("_before")
    return (steps.withColumn("increase", F.when(before.isNull(), F.lit(0)).when(value < before, value)
                             .otherwise(value - before)).drop("_before"))


def counter_rate(points: DataFrame, series: list[str], by: list[str], interval: str = "1 hour",
                 width: int = HOUR_NS, tie: str | None = None) -> DataFrame:
    """Increase and per-second rate of counters per window, summed over the series of a label set."""
    steps = counter_increase(points, series, width, tie)
    window = F.window(ns_to_ts(F.col("ts_ns")), interval)
    summed = steps.groupBy(*by, window.alias("w")).agg(F.sum("increase").alias("increase"))
    seconds = F.unix_timestamp("w.end") - F.unix_timestamp("w.start")
    return summed.select(*by, F.col("w.start").alias("window_start"), "increase",
                         (F.col("increase") / seconds).alias("rate"))


def gauge_max(points: DataFrame, by: list[str], interval: str = "1 hour") -> DataFrame:
    window = F.window(ns_to_ts(F.col("ts_ns")), interval)
    return (points.groupBy(*by, window.alias("w")).agg(F.max("value").alias("value"))
            .select(*by, F.col("w.start").alias("window_start"), "value"))


def ratio_of_rates(errors: DataFrame, samples: DataFrame, by: list[str], series: list[str],
                   interval: str = "1 hour", width: int = HOUR_NS, tie: str | None = None) -> DataFrame:
    """Errors per window and reason over all samples of that window. NULL where nothing was counted."""
    top = counter_rate(errors, series, by, interval, width, tie).withColumnRenamed("increase", "errors")
    bottom = counter_rate(samples, series, [], interval, width, tie).withColumnRenamed("increase", "samples")
    return top.drop("rate").join(bottom.drop("rate"), "window_start", "inner").withColumn(
        "ratio", F.try_divide("errors", "samples"))


def histogram_quantile(buckets: DataFrame, q: float, by: list[str]) -> DataFrame:
    """Quantile from cumulative buckets (``le`` double with infinity last, ``cumulative``).

    Linear inside the bucket; the open bucket answers with its lower bound, the first bucket starts at 0.
    """
    group = Window.partitionBy(*by).orderBy("le")
    total = F.max("cumulative").over(Window.partitionBy(*by))
    ranked = (buckets.withColumn("_rank", total * F.lit(q))
              .withColumn("_below", F.coalesce(F.lag("cumulative").over(group), F.lit(0)))
              .withColumn("_low", F.lag("le").over(group)))
    hit = ranked.where((F.col("cumulative") >= F.col("_rank")) & (F.col("cumulative") > 0)).groupBy(*by).agg(
        F.min(F.struct("le", "cumulative", "_rank", "_below", "_low")).alias("h"))
    low = F.coalesce(F.col("h._low"), F.when(F.col("h.le") > 0, F.lit(0.0)))
    share = (F.col("h._rank") - F.col("h._below")) / (F.col("h.cumulative") - F.col("h._below"))
    inside = F.when(F.col("h._low").isNull() & (F.col("h.le") <= 0), F.col("h.le")).otherwise(
        low + (F.col("h.le") - low) * share)
    return hit.select(*by, F.when(F.col("h.le") == float("inf"), F.col("h._low")).otherwise(inside).alias("quantile"))


def hit_ratio(requests: DataFrame, by: list[str]) -> DataFrame:
    """Hits over all requests (``result`` is hit or miss, ``value`` their number)."""
    hits = F.sum(F.when(F.col("result") == "hit", F.col("value")).otherwise(F.lit(0)))
    return requests.groupBy(*by).agg(hits.alias("hits"), F.sum("value").alias("requests")).withColumn(
        "ratio", F.try_divide("hits", "requests"))


MetricProducer = Callable[[], DataFrame]


def metrics_export(producers: dict[str, MetricProducer], resource: dict[str, str]) -> DataFrame | None:
    """The points of all producers in one table, with scope name and resource attributes.

    Each producer's points are worked out and stored on their own, so one that fails while it is built or while it runs is
    logged and its scope stays empty; without any producer left there is nothing.
    """
    attributes = F.create_map(*[F.lit(x) for pair in resource.items() for x in pair])
    table: DataFrame | None = None
    for scope, produce in producers.items():
        try:
            points = stored(produce(), f"metrics-{scope}")
        except Exception:
            log.warning("metrics producer %s failed", scope, exc_info=True)
            continue
        points = points.withColumn("scope", F.lit(scope)).withColumn("resource", attributes)
        table = points if table is None else table.unionByName(points, allowMissingColumns=True)
    return table
