"""Function-scope probes: specs, targets, spans and their samples."""

from __future__ import annotations

import re
from dataclasses import asdict, dataclass

import yaml
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stackloom.functions.re2 import java_pattern
from stackloom.functions.values import floor_div, trim_nul, unpack_probe_cookie
from stackloom.operators.sequence import HOUR_NS, with_slice
from stackloom.session import stored


@dataclass(frozen=True)
class ProbeSpec:
    spec_id: int
    id: str
    file_match: str
    entry_symbol: str
    exit_symbol: str
    main_thread_only: bool = True
    min_duration_ms: int = 0

    @property
    def cookie(self) -> int:
        return self.spec_id << 32 | (self.min_duration_ms & 0x7FFFFFFF) << 1 | int(self.main_thread_only)


def load_probe_specs(text: str) -> list[ProbeSpec]:
    """Specs of a YAML text with a ``probes`` list, numbered from 1."""
    entries = (yaml.safe_load(text) or {}).get("probes") or []
    if not entries:
        raise ValueError("probe config has no `probes` entries")
    specs = []
    for number, entry in enumerate(entries, start=1):
        for name in ("id", "file_match", "entry_symbol", "exit_symbol"):
            if not entry.get(name):
                raise ValueError(f"probe {number}: `{name}` is required")
        try:
            java_pattern(entry["file_match"])
        except ValueError as error:
            raise ValueError(f"probe {number}: bad file_match {entry['file_match']!r}") from error
        flag = entry.get("main_thread_only")
        specs.append(ProbeSpec(
            number, entry["id"], entry["file_match"], entry["entry_symbol"], entry["exit_symbol"],
            True if flag is None else bool(flag), int(entry.get("min_duration_ms") or 0)))
    return specs


def probe_specs_table(spark: SparkSession, specs: list[ProbeSpec]) -> DataFrame:
    """The configured specs as a table; as long as the configuration file."""
    schema = ("spec_id long, id string, file_match string, entry_symbol string, exit_symbol string, "
              "main_thread_only boolean, min_duration_ms long, cookie long")
    return spark.createDataFrame([{**asdict(s), "cookie": s.cookie} for s in specs], schema)


def match_probe_targets(executables: DataFrame, specs: list[ProbeSpec]) -> DataFrame:
    """``file_id, path, spec_id, probe_id`` for each file whose path a spec matches; each file id once.

    The configured patterns become one array expression, so no join is needed.
    """
    path = F.coalesce(F.nullif("path", F.lit("")), F.col("file_name"))
    files = executables.groupBy("file_id").agg(F.min(path).alias("path"))
    hits = F.array(*[
        F.when(F.rlike("path", F.lit(s.file_match)), F.struct(
            F.lit(s.spec_id).cast("long").alias("spec_id"), F.lit(s.id).alias("probe_id"))) for s in specs])
    return files.select("file_id", "path", F.explode(F.filter(hits, lambda h: h.isNotNull())).alias("_hit")).select(
        "file_id", "path", "_hit.*")


def _watched(edges: DataFrame, keys: list[str], width: int) -> DataFrame:
    """Sliced edges that count: of main threads only, where the probe asks for that."""
    columns = list(dict.fromkeys([*keys, "pid", "tid", "comm", "ts_ns", "delta"]))
    flagged = edges.withColumn("_flags", unpack_probe_cookie(F.col("cookie")))
    return with_slice(
        flagged.where((~F.col("_flags.main_thread_only")) | (F.col("tid") == F.col("pid")))
        .select(*columns, F.col("_flags.spec_id").alias("spec_id"), F.col("_flags.min_duration_ms").alias("_min_ms")),
        "ts_ns", width)


def _slice_sums(watched: DataFrame, keys: list[str], initial: DataFrame | None) -> DataFrame:
    """Per slice: sum and lowest point of the running sum, and the depth it starts from."""
    running = Window.partitionBy(*keys, "_slice").orderBy("ts_ns", F.desc("delta")).rowsBetween(Window.unboundedPreceding, 0)
    sums = (watched.select(*keys, "_slice", "ts_ns", "delta").withColumn("_sum", F.sum("delta").over(running))
            .groupBy(*keys, "_slice").agg(F.sum("delta").alias("_total"), F.min("_sum").alias("_low")))
    if initial is not None:  # open scopes stand for a slice before all others
        sums = sums.unionByName(initial.select(
            *keys, F.lit(-(2**62)).alias("_slice"), F.col("depth").cast("long").alias("_total"),
            F.lit(0).cast("long").alias("_low")))
    before = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    return (sums.withColumn("_in", F.coalesce(F.sum("_total").over(before), F.lit(0)))
            .withColumn("_floor", F.least(F.lit(0), F.coalesce(F.min(F.col("_in") + F.col("_low")).over(before), F.lit(0)))))


def _outer_edges(watched: DataFrame, keys: list[str], sums: DataFrame) -> DataFrame:
    """Edges that open or close an outermost scope: at most one of each per span."""
    starts = (sums.withColumn("delta", F.col("_in") - F.col("_floor"))
              .where(F.col("delta") > 0).select(*keys, "_slice", "delta", F.lit(True).alias("_seed")))
    order = Window.partitionBy(*keys, "_slice").orderBy(F.col("_seed").desc(), "ts_ns", F.desc("delta"))
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    depths = (watched.withColumn("_seed", F.lit(False)).unionByName(starts, allowMissingColumns=True)
              .withColumn("_sum", F.sum("delta").over(upto))
              .withColumn("_depth", F.col("_sum") - F.least(F.lit(0), F.min("_sum").over(upto)))
              .withColumn("_was", F.coalesce(F.lag("_depth").over(order), F.lit(0)))
              .where(~F.col("_seed")))
    opens = (F.col("delta") > 0) & (F.col("_depth") == 1) & (F.col("_was") == 0)
    closes = (F.col("delta") < 0) & (F.col("_depth") == 0) & (F.col("_was") == 1)
    return depths.withColumn("_open", opens).where(opens | closes)


def pair_probe_scopes(
    edges: DataFrame, keys: list[str], width: int = HOUR_NS, initial: DataFrame | None = None
) -> DataFrame:
    """Entry and exit edges to outermost spans.

    ``edges`` holds ``keys`` (the thread), ``pid, tid, comm, ts_ns, delta`` (+1 entry, -1 exit) and the
    ``cookie`` of the probe. Nested entries only raise the depth, whatever their probe; an exit without
    entry is dropped; of edges at the same time entries come first; the span takes the probe of its exit. ``initial`` holds scopes open before the first
    edge, as :func:`open_scopes` returns them.

    Depth is a running sum that never goes below zero. Each slice learns its starting depth from the sums
    and lowest points of the slices before it; a span that crosses slices is closed in a second step that
    sees at most two edges per slice.
    """
    watched = _watched(edges, keys, width)
    return _spans(stored(_outer_edges(watched, keys, _slice_sums(watched, keys, initial)), "outer"), keys, initial)


def _spans(outer: DataFrame, keys: list[str], initial: DataFrame | None) -> DataFrame:
    inside = Window.partitionBy(*keys, "_slice").orderBy("ts_ns", F.desc("_open"))
    outer = (outer.withColumn("_from", F.when(F.lag("_open").over(inside), F.lag("ts_ns").over(inside)))
             .withColumn("_closed", F.lead("_open").over(inside).isNotNull()))
    within = outer.where(~F.col("_open") & F.col("_from").isNotNull())
    loose = outer.where((F.col("_open") & ~F.col("_closed")) | (~F.col("_open") & F.col("_from").isNull()))
    if initial is not None:
        loose = loose.unionByName(initial.select(
            *keys, F.col("open_ns").alias("ts_ns"), F.lit(True).alias("_open")), allowMissingColumns=True)
    thread = Window.partitionBy(*keys).orderBy("ts_ns", F.desc("_open"))
    crossing = (loose.withColumn("_from", F.when(F.lag("_open").over(thread), F.lag("ts_ns").over(thread)))
                .where(~F.col("_open") & F.col("_from").isNotNull()))
    spans = within.unionByName(crossing).withColumn("duration_ns", F.col("ts_ns") - F.col("_from"))
    long_enough = (F.col("_min_ms") == 0) | (F.col("duration_ns") >= F.col("_min_ms") * 1_000_000)
    names = list(dict.fromkeys([*keys, "pid", "tid", "comm", "spec_id"]))
    return spans.where(long_enough).select(*names, F.col("ts_ns").alias("end_ns"), "duration_ns")


def open_scopes(
    edges: DataFrame, keys: list[str], width: int = HOUR_NS, initial: DataFrame | None = None
) -> DataFrame:
    """Scopes still open after the last edge: ``keys, depth, open_ns``."""
    return scopes_and_open(edges, keys, width, initial)[1]


def scopes_and_open(
    edges: DataFrame, keys: list[str], width: int = HOUR_NS, initial: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """What :func:`pair_probe_scopes` and :func:`open_scopes` give, out of one pairing."""
    watched = _watched(edges, keys, width)
    sums = stored(_slice_sums(watched, keys, initial), "sums")
    outer = stored(_outer_edges(watched, keys, sums), "outer")
    depth = F.sum("_total") - F.least(F.lit(0), F.min(F.col("_in") + F.col("_low")))
    depths = sums.groupBy(*keys).agg(depth.alias("depth")).where("depth > 0")
    opened = outer.where("_open").select(*keys, F.col("ts_ns").alias("open_ns"))
    if initial is not None:
        opened = opened.unionByName(initial.select(*keys, "open_ns"))
    still_open = depths.join(opened.groupBy(*keys).agg(F.max("open_ns").alias("open_ns")), keys, "inner")
    return _spans(outer, keys, initial), still_open


def probe_event_spec(events: DataFrame, specs: DataFrame) -> DataFrame:
    """Events with the id of their probe; unknown spec ids are dropped."""
    return events.join(specs.select("spec_id", F.col("id").alias("probe_id")), "spec_id", "inner")


def unknown_probe_events(events: DataFrame, specs: DataFrame) -> DataFrame:
    """How many events carry a spec id nobody configured, per id."""
    counts = events.groupBy("spec_id").agg(F.count(F.lit(1)).alias("dropped"))
    return counts.join(specs.select("spec_id"), "spec_id", "left_anti")


def probe_spans(scopes: DataFrame, specs: DataFrame) -> DataFrame:
    """Spans with start, end and attributes."""
    known = probe_event_spec(scopes, specs)
    extra = [c for c in scopes.columns if c not in ("pid", "tid", "comm", "spec_id", "end_ns", "duration_ns")]
    return known.select(
        *extra, "pid", "tid", trim_nul(F.col("comm")).alias("comm"), "spec_id", "probe_id",
        (F.col("end_ns") - F.col("duration_ns")).alias("start_ns"), "end_ns", "duration_ns")


def samples_in_span(samples: DataFrame, spans: DataFrame, keys: list[str], width: int = HOUR_NS) -> DataFrame:
    """Samples of a thread with each span that covers their time, both ends included: a row per sample and span.

    An interval join: a span is laid out over the time slices it touches (its length over ``width``, plus one), samples lie in
    one each, and the two meet by thread and slice before their times are compared. Spans may overlap, as those of
    different probes do. A thread that is busy for days is spread over its slices; Spark splits a hot slice of samples.
    """
    laid = spans.select(
        *keys, F.col("start_ns").alias("span_start_ns"), F.col("end_ns").alias("span_end_ns"), "spec_id", "probe_id",
        F.explode(F.sequence(floor_div(F.col("start_ns"), width), floor_div(F.col("end_ns"), width))).alias("_slice"))
    joined = with_slice(samples, "ts_ns", width).join(laid, [*keys, "_slice"])
    return joined.where(F.col("ts_ns").between(F.col("span_start_ns"), F.col("span_end_ns"))).select(
        *samples.columns, "span_start_ns", "span_end_ns", "spec_id", "probe_id")
