"""Written records, off-line files and streams, read back."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stackloom.functions.labels import labels_string
from stackloom.functions.values import floor_div, ns_to_ts
from stackloom.operators import samples as sample_ops
from stackloom.operators.frames import stack_locations
from stackloom.operators.metrics import observe_counters
from stackloom.plans import inputs
from stackloom.plans.batch_files import BATCH_NS, DAY_NS, FILE_NS, plain_records, write_batch_files
from stackloom.plans.fixtures import Tables
from stackloom.plans.q_probes import _LAUNCHES, _MATCHED, _SPANS, _THREAD, _TIMINGS, _UNMATCHED
from stackloom.plans.registry import query
from stackloom.session import shared_dir, stored
from stackloom.sources import tables
from stackloom.sources.batch_log import REPLAY_COLUMNS, read_batch_log, replay_batch_log
from stackloom.sources.batch_log_sink import write_batch_log
from stackloom.streaming import counters, state
from stackloom.streaming import joins as stream_joins
from stackloom.streaming import probes as stream_probes
from stackloom.streaming import report

_FIXED = """ts_ns, value, sample_type, sample_unit, period_type, period_unit, producer, temporality, period, duration"""


def labelled(t: Tables) -> DataFrame:
    labels = F.create_map(F.lit("node"), F.col("node"), F.lit("comm"), F.col("comm"))
    return inputs.samples(t).withColumn("labels", labels)


# ---- record tables ----------------------------------------------------------------------------


@query("write_samples_v1", f"""
    SELECT comm AS "labels.comm", node AS "labels.node", stack_key AS stacktrace_id, {_FIXED} FROM ox_samples""")
def _(t: Tables):
    path = shared_dir(t.spark, "samples-v1")
    tables.write_samples_v1(labelled(t), path, by_hour=True)
    return t.spark.read.parquet(path).drop("date", "hour")


_LOCATION_TEXT = """coalesce(CAST(address AS VARCHAR), '') || '|' || frame_type || '|' || coalesce(mapping_file, '') || '|'
    || coalesce(mapping_build_id, '') || '|' || coalesce(CAST(line AS VARCHAR), '') || '|' || coalesce({system}, '-') || '|' || coalesce({name}, '-')"""
_V2_TEXT = _LOCATION_TEXT.format(system="function_system_name", name="NULL")
# In v1 records only GPU program counters have a system name; the other lines have an empty one and a function name.
_V1_TEXT = _LOCATION_TEXT.format(
    system="CASE WHEN frame_type = 'cuda-pc' THEN coalesce(function_system_name, '') WHEN has_line THEN '' END",
    name="CASE WHEN frame_type <> 'cuda-pc' THEN function_system_name END")


def _location_text(array: str):
    def text(x):
        line = F.get(x["lines"], F.lit(0))
        return F.concat_ws("|", x["address"].cast("string"), x["frame_type"], F.coalesce(x["mapping_file"], F.lit("")),
                           F.coalesce(x["mapping_build_id"], F.lit("")), F.coalesce(line["line"].cast("string"), F.lit("")),
                           F.coalesce(line["function_system_name"], F.lit("-")), F.coalesce(line["function_name"], F.lit("-")))
    return F.array_join(F.transform(array, text), ";")


@query("write_stacktraces_v1", f"""
    SELECT s.stack_key AS stacktrace_id, coalesce(bool_and(frame_complete), true) AS is_complete,
           CASE WHEN count(l.stack_key) > 0 THEN 0 END AS mapping_sum, string_agg({_V1_TEXT}, ';' ORDER BY frame_idx) AS locations
    FROM fx_stacks s LEFT JOIN ox_locations l ON s.stack_key = l.stack_key GROUP BY 1""")
def _(t: Tables):
    path = shared_dir(t.spark, "stacktraces-v1")
    tables.write_stacktraces_v1(inputs.stacks_resolved(t, "v1"), path)
    zero = F.aggregate("locations", F.lit(0).cast("long"), lambda acc, x: (
        acc + x["mapping_start"] + x["mapping_limit"] + x["mapping_offset"]))
    return t.spark.read.parquet(path).select(
        "stacktrace_id", "is_complete", zero.alias("mapping_sum"),
        _location_text("locations").alias("locations"))


@query("write_samples_v2", f"""
    WITH st AS (SELECT stack_key, string_agg({_V2_TEXT}, ';' ORDER BY frame_idx) AS stack
                FROM ox_locations GROUP BY 1)
    SELECT 'comm=' || comm || ',node=' || node AS labels, st.stack AS stacktrace, s.stack_key AS stacktrace_id, {_FIXED}
    FROM ox_samples s LEFT JOIN st ON s.stack_key = st.stack_key""")
def _(t: Tables):
    path = shared_dir(t.spark, "samples-v2")
    rows = labelled(t)
    # Only stacks that occur in the batch are gathered.
    used = inputs.locations(t).join(rows.select("stacktrace_id").distinct(), "stacktrace_id", "left_semi")
    tables.write_samples_v2(rows, stack_locations(used, "stacktrace_id"), path)
    return t.spark.read.parquet(path).withColumn("labels", labels_string(F.col("labels"))).withColumn(
        "stacktrace", _location_text("stacktrace"))


@query("rotate_output", """
    SELECT make_timestamp(ts_ns // 1000 - (ts_ns // 1000) % 86400000000) AS rotation, sample_type, count(*) AS n, sum(value) AS value
    FROM ox_samples GROUP BY 1, 2""")
def _(t: Tables):
    path = shared_dir(t.spark, "rotated")
    tables.rotate_output(inputs.samples(t), path, DAY_NS)
    return t.spark.read.parquet(path).groupBy(F.col("rotation").cast("timestamp").alias("rotation"), "sample_type").agg(
        F.count(F.lit(1)).alias("n"), F.sum("value").alias("value"))


# ---- off-line files ---------------------------------------------------------------------------


@query("read_batch_log", f"""
    SELECT node || '-' || CAST(ts_ns // {FILE_NS} AS VARCHAR) || '.padata.zst' AS file, 'v1' AS schema_version,
           'comm=' || comm || ',node=' || node AS labels, lpad(to_hex(stack_key), 32, '0') AS stacktrace_id, {_FIXED}
    FROM ox_samples""")
def _(t: Tables):
    samples = read_batch_log(t.spark, write_batch_files(t))
    return samples.select("file", "schema_version", labels_string(F.col("labels")).alias("labels"),
                          F.hex("stacktrace_id").alias("stacktrace_id"), *_FIXED.replace("\n", " ").split(", "))


@query("batch_log_stream", f"""
    SELECT node || '-' || CAST(ts_ns // {FILE_NS} AS VARCHAR) || '.padata' AS file, 'comm=' || comm || ',node=' || node AS labels,
           lpad(to_hex(stack_key), 32, '0') AS stacktrace_id, {_FIXED}
    FROM ox_samples""")
def _(t: Tables):
    path = shared_dir(t.spark, "stream-batch-log")
    samples = read_batch_log(t.spark, write_batch_files(t), streaming=True).select(
        "file", labels_string(F.col("labels")).alias("labels"), F.hex("stacktrace_id").alias("stacktrace_id"), *_FIXED.replace("\n", " ").split(", "))
    _finish(report.stream_report(samples, report.parquet_flush(f"{path}/out"), f"{path}/checkpoint", None))
    return t.spark.read.parquet(f"{path}/out").drop("batch_id")


@query("replay_batch_log", f"""
    WITH b AS (SELECT DISTINCT node || '-' || CAST(ts_ns // {FILE_NS} AS VARCHAR) || '.padata.zst' AS file,
                      ts_ns // {BATCH_NS} AS part, stack_key FROM ox_samples),
    n AS (SELECT *, dense_rank() OVER (PARTITION BY file ORDER BY part) - 1 AS batch FROM b),
    st AS (SELECT s.stack_key, coalesce(bool_and(frame_complete), true) AS is_complete, string_agg({_V1_TEXT}, ';' ORDER BY frame_idx) AS locations
           FROM fx_stacks s LEFT JOIN ox_locations l ON s.stack_key = l.stack_key GROUP BY 1)
    SELECT n.file, n.batch, lpad(to_hex(n.stack_key), 32, '0') AS stacktrace_id, coalesce(st.is_complete, false) AS is_complete, st.locations
    FROM n LEFT JOIN st ON n.stack_key = st.stack_key""")
def _(t: Tables):
    replayed = replay_batch_log(read_batch_log(t.spark, write_batch_files(t), "all", REPLAY_COLUMNS))
    return replayed.select("file", "batch", F.hex("stacktrace_id").alias("stacktrace_id"), "is_complete",
                           _location_text("locations").alias("locations"))


@query("batch_log_inventory", f"""
    SELECT CASE WHEN CAST(substr(node, 6) AS INT) % 2 = 0 THEN 'open' ELSE 'compressed' END AS kind,
           count(DISTINCT node || '-' || CAST(ts_ns // {FILE_NS} AS VARCHAR)) AS files, true AS has_bytes FROM fx_events GROUP BY 1
    UNION ALL SELECT 'unknown', 1, true""")
def _(t: Tables):
    path = shared_dir(t.spark, "inventory")
    rows = plain_records(t)
    even = F.substring_index(F.substring("file", 6, 10), "-", 1).cast("int") % 2 == 0
    write_batch_log(rows.where(even), path, compress=False)
    write_batch_log(rows.where(~even), path)
    t.spark.createDataFrame([("not a batch log",)], "value string").coalesce(1).write.text(f"{path}/notes")
    found = tables.batch_log_inventory(t.spark, path)
    return found.select("kind", "files", (F.col("bytes") > 0).alias("has_bytes"))


# ---- streams ----------------------------------------------------------------------------------

_EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


_EVENT_COLUMNS = {
    "event_id": "event_id", "ts": "cast(ts as timestamp)", "ts_ns": "unix_micros(cast(ts as timestamp)) * 1000",
    "node": "concat('NODE_', user_id % 25)", "pid": "user_id", "tid": "user_id + event_id % 2",
    "comm": "concat('comm-', user_id % 7)",
    "origin": "coalesce(element_at(map('view','sampling','click','off_cpu','purchase','memory','signup','cuda',"
              "'error','gpu_pc'), event_type), 'unknown')",
    "raw_value": "cast(round(value * 100) as bigint)", "stacktrace_id": "user_id * 10 + (event_id * 7) % 10",
    "mem": "named_struct('allocs', event_id % 50, 'frees', (event_id * 3) % 50, 'alloc_bytes', event_id % 50 * 64,"
           " 'free_bytes', (event_id * 3) % 50 * 48)",
    "event_type": "event_type"}


def _in_parts(rows: DataFrame, path: str, run: Callable[[int], None], parts: int = 4) -> None:
    """Lay rows down part by part in order of ``ts`` and let ``run`` take each part in, as one batch of a stream that goes on.

    Parts are of about equal size and written by all tasks. Rows without a time come with the first part; an empty table
    is one empty part.
    """
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    cuts = rows.agg(F.percentile_approx(micros, [i / parts for i in range(1, parts)], 10_000)).first()[0] or []
    bounds = [None, *sorted(set(cuts)), None]
    for number, (low, high) in enumerate(zip(bounds, bounds[1:])):
        inside = F.lit(True) if high is None else micros <= high
        inside = F.coalesce(inside, F.lit(True)) if low is None else inside & (micros > low)
        part = rows.where(inside)
        part.write.mode("append").parquet(path)
        run(number)


def events_in_parts(t: Tables, path: str, run: Callable[[DataFrame], None]) -> None:
    """The events table as a stream of trace events, a part at a time."""
    stream = lambda: tables.read_trace_events(t.spark, path, _EVENT_COLUMNS, schema=_EVENTS, streaming=True)
    _in_parts(t.table("events").withColumn("ts", F.col("ts").cast("timestamp_ntz")), path, lambda _: run(stream()))


def _finish(running) -> None:
    running.awaitTermination()


@query("stream_report", """
    SELECT event_id, ts_ns, stack_key AS stacktrace_id, value, sample_type, period FROM ox_samples""")
def _(t: Tables):
    path = shared_dir(t.spark, "stream-report")
    events_in_parts(t, f"{path}/in", lambda events: _finish(report.stream_report(
        sample_ops.normalize_samples(events), report.parquet_flush(f"{path}/out"), f"{path}/checkpoint", None)))
    schema = sample_ops.normalize_samples(inputs.events(t)).select("event_id", "ts_ns", "stacktrace_id", "value", "sample_type", "period").schema
    return t.spark.read.schema(schema).parquet(f"{path}/out").drop("batch_id")


@query("late_rows_stream", """
    WITH p AS (SELECT quantile_disc(ts_ns, 0.5) AS cut FROM fx_events),
    first_ AS (SELECT max(ts_ns) AS newest FROM fx_events, p WHERE ts_ns <= cut AND event_id % 10 <> 0),
    last_ AS (SELECT max(ts_ns) AS newest FROM fx_events),
    b AS (SELECT event_id, ts_ns, ts_ns < CASE WHEN ts_ns <= cut AND event_id % 10 <> 0 THEN first_.newest ELSE last_.newest END - 864000000000000 AS late
          FROM fx_events, p, first_, last_)
    SELECT late, count(*) AS n, min(ts_ns) AS first_ns, max(ts_ns) AS last_ns FROM b GROUP BY late""")
def _(t: Tables):
    path = shared_dir(t.spark, "stream-late")
    rows = inputs.events(t).select("event_id", "ts_ns")
    cut = rows.agg(F.percentile("ts_ns", 0.5)).first()[0]
    # a tenth of the first half comes with the second; the stream restarts in between
    early = (F.col("ts_ns") <= F.lit(_disc(rows, cut))) & (F.col("event_id") % 10 != 0)
    for part in (rows.where(early), rows.where(~early)):
        part.repartition(2).write.mode("append").parquet(f"{path}/in")
        flush = report.splitting_flush(report.parquet_flush(f"{path}/good"), report.parquet_flush(f"{path}/late"), 10 * DAY_NS, f"{path}/newest")
        _finish(report.stream_report(t.spark.readStream.schema(rows.schema).parquet(f"{path}/in"), flush, f"{path}/checkpoint", None))
    sides = [t.spark.read.schema(rows.schema).parquet(f"{path}/{name}").withColumn("late", F.lit(name == "late")) for name in ("good", "late")]
    return sides[0].unionByName(sides[1]).groupBy("late").agg(
        F.count(F.lit(1)).alias("n"), F.min("ts_ns").alias("first_ns"), F.max("ts_ns").alias("last_ns"))


def _disc(rows: DataFrame, middle: float | None) -> int:
    """The greatest time at or below the median."""
    return rows.where(F.col("ts_ns") <= F.lit(middle)).agg(F.max("ts_ns")).first()[0] or 0


@query("pipeline_counters_stream", """
    WITH e AS (SELECT origin, pid % 10 <> 3 AS keep, event_id % 4 AS n_frames FROM fx_events)
    SELECT CASE WHEN NOT keep THEN 'skipped_by_relabeling' ELSE
           CASE origin WHEN 'sampling' THEN 'cpu' WHEN 'cuda' THEN 'gpu' WHEN 'gpu_pc' THEN 'gpu_pc' WHEN 'off_cpu' THEN 'offcpu'
                WHEN 'memory' THEN 'memory' ELSE 'unknown' END END AS counter, count(*) AS n FROM e GROUP BY 1
    UNION ALL SELECT 'empty', count(*) FROM e WHERE keep AND n_frames = 0""")
def _(t: Tables):
    path = shared_dir(t.spark, "stream-counters")
    listener = counters.CounterListener(t.spark, f"{path}/counters", "event_counters")
    t.spark.streams.addListener(listener)

    def run(events: DataFrame) -> None:
        marked = observe_counters(events.withColumns({"keep": F.expr("pid % 10 <> 3"), "n_frames": F.expr("event_id % 4")}))
        running = report.stream_report(marked, report.parquet_flush(f"{path}/out"), f"{path}/checkpoint", None)
        _finish(running)
        listener.wait_for(running)
    try:
        events_in_parts(t, f"{path}/in", run)
    finally:
        t.spark.streams.removeListener(listener)
    return listener.totals()


@query("new_stacks_stream", f"""
    SELECT DISTINCT ts_ns // {DAY_NS} AS day, stack_key AS stacktrace_id FROM fx_events""")
def _(t: Tables):
    path = shared_dir(t.spark, "stream-stacks")
    events_in_parts(t, f"{path}/in", lambda events: _finish(
        report.new_stacks_stream(events, DAY_NS).select("ts_ns", "stacktrace_id").writeStream.option("checkpointLocation", f"{path}/checkpoint")
        .trigger(availableNow=True).start(f"{path}/out", format="parquet")))
    rows = t.spark.read.schema("ts_ns long, stacktrace_id long").parquet(f"{path}/out")
    return rows.select(floor_div(F.col("ts_ns"), DAY_NS).alias("day"), "stacktrace_id")


@query("requested_stacktraces_stream", f"""
    WITH ids AS (SELECT DISTINCT ts_ns // {DAY_NS} AS day, stack_key FROM fx_events)
    SELECT count(*) FILTER (WHERE k.stack_key IS NULL) AS missing, count(DISTINCT ids.stack_key) AS stacks,
           sum(DISTINCT CASE WHEN k.stack_key IS NOT NULL THEN ids.stack_key END) AS known_sum
    FROM (SELECT DISTINCT stack_key FROM ids) ids LEFT JOIN fx_stacks k ON ids.stack_key = k.stack_key""")
def _(t: Tables):
    path = shared_dir(t.spark, "stream-requests")
    flush = stream_joins.answered_requests(lambda: inputs.stack_table(t), report.parquet_flush(f"{path}/out"))
    events_in_parts(t, f"{path}/in", lambda events: _finish(
        report.stream_report(events.select("stacktrace_id"), flush, f"{path}/checkpoint", None)))
    answers = t.spark.read.schema("stacktrace_id long, is_missing boolean").parquet(f"{path}/out").select("stacktrace_id", "is_missing").distinct()
    return answers.agg(F.count_if("is_missing").alias("missing"), F.count_distinct("stacktrace_id").alias("stacks"),
                       F.sum(F.when(~F.col("is_missing"), F.col("stacktrace_id"))).alias("known_sum"))


@query("pair_probe_scopes_stream", _SPANS + " SELECT * FROM spans")
def _(t: Tables):
    from stackloom.functions.values import probe_cookie

    path = shared_dir(t.spark, "stream-scopes")
    cookie = probe_cookie(1 + F.col("pid") % 4, F.col("pid") % 4 == 0, F.when(F.col("pid") % 4 == 2, 3_600_000).otherwise(0))

    def run(events: DataFrame) -> None:
        edges = events.select("node", "pid", "tid", "comm", "ts_ns", F.when(F.col("event_type").isin("purchase", "error"), -1).otherwise(1).alias("delta"),
                              cookie.alias("cookie"))
        pairing = stream_probes.ScopePairing(_THREAD, f"{path}/state", report.parquet_flush(f"{path}/out"), DAY_NS)
        _finish(pairing.start(edges, f"{path}/checkpoint", None))
    events_in_parts(t, f"{path}/in", run)
    return t.spark.read.parquet(f"{path}/out").drop("batch_id")


def _gpu_in_parts(t: Tables, path: str, run: Callable[[DataFrame, DataFrame], None], closing: bool = False) -> None:
    """Launches and timings as streams, a quarter of the time at a time; ``closing`` adds one late entry to either side."""
    sides = {}
    for name, rows, at in (("launches", t.sql(_LAUNCHES), "ts_ns"), ("timings", t.sql(_TIMINGS), "at_ns")):
        # every part reads them again, and timings are a join of three tables
        sides[name] = stored(rows.withColumn("ts", ns_to_ts(F.col(at))).drop("at_ns"), f"stream-{name}")
    both = sides["launches"].select("ts").unionByName(sides["timings"].select("ts"))
    cuts = both.agg(F.percentile_approx(F.unix_micros("ts"), [0.25, 0.5, 0.75], 10_000)).first()[0] or []
    read = lambda name: t.spark.readStream.schema(sides[name].schema).parquet(f"{path}/{name}")
    bounds = [None, *cuts, None]
    for low, high in zip(bounds, bounds[1:]):
        for name, rows in sides.items():
            micros = F.unix_micros("ts")
            inside = (micros > low if low is not None else F.lit(True)) & (micros <= high if high is not None else F.lit(True))
            rows.where(inside).write.mode("append").parquet(f"{path}/{name}")
        run(read("launches"), read("timings"))
    if closing:  # time goes on: what is still open is cleared
        for name, rows in sides.items():
            late = both.agg((F.max("ts") + F.expr("INTERVAL 1 DAY")).alias("ts")).withColumns({"node": F.lit("later"), "pid": F.lit(0), "correlation_id": F.lit(0)})
            late.select(*[(F.col(f.name) if f.name in late.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in rows.schema]).write.mode(
                "append").parquet(f"{path}/{name}")
        run(read("launches"), read("timings"))


@query("gpu_kernel_times_stream", _MATCHED)
def _(t: Tables):
    path = shared_dir(t.spark, "stream-gpu")
    _gpu_in_parts(t, path, lambda launches, timings: _finish(
        stream_joins.gpu_kernel_times_stream(launches, timings).drop("ts").writeStream.option("checkpointLocation", f"{path}/checkpoint")
        .trigger(availableNow=True).start(f"{path}/out", format="parquet")))
    return t.spark.read.parquet(f"{path}/out")


@query("gpu_unmatched_stream", _UNMATCHED)
def _(t: Tables):
    path = shared_dir(t.spark, "stream-gpu-cleared")
    flush = stream_joins.cleared_counts(report.parquet_flush(f"{path}/out"))
    _gpu_in_parts(t, path, lambda launches, timings: _finish(
        stream_joins.gpu_unmatched_stream(launches, timings).writeStream.foreachBatch(flush).option("checkpointLocation", f"{path}/checkpoint")
        .trigger(availableNow=True).start()), closing=True)
    counts = t.spark.read.schema("side string, cleared long").parquet(f"{path}/out")
    sides = t.spark.createDataFrame([("launch",), ("timing",)], "side string")
    return sides.join(counts, "side", "left").groupBy("side").agg(F.coalesce(F.sum("cleared"), F.lit(0)).alias("cleared"))


# Requests of a process: its control group is unreadable at times, and it moves between containers.
_REQUESTS = """SELECT event_id, @us(ts) * 1000 AS ts_ns, 'NODE_' || CAST(user_id % 25 AS STRING) AS node, user_id AS pid,
                      CASE WHEN event_id % 5 = 0 THEN NULL ELSE '4:memory:/docker/' || md5(CAST(user_id AS STRING)) || md5(CAST(event_id % 3 AS STRING)) END
                      AS cgroup_line FROM events"""
_LOOKUPS = f"""
    WITH RECURSIVE e AS (SELECT node, pid, ts_ns, max(cgroup_line) AS cgroup_line FROM ({_REQUESTS}) GROUP BY node, pid, ts_ns),
    nxt AS (SELECT a.node, a.pid, a.ts_ns, min(b.ts_ns) AS next_ns FROM e a JOIN e b ON a.node = b.node AND a.pid = b.pid AND a.ts_ns + {DAY_NS} < b.ts_ns
            GROUP BY ALL),
    looked AS (SELECT node, pid, min(ts_ns) AS ts_ns FROM e GROUP BY node, pid
               UNION ALL SELECT nxt.node, nxt.pid, nxt.next_ns FROM looked JOIN nxt USING (node, pid, ts_ns)),
    held AS (SELECT e.node, e.pid, e.ts_ns, max(l.ts_ns) AS at FROM e JOIN looked l ON e.node = l.node AND e.pid = l.pid AND e.ts_ns >= l.ts_ns
             GROUP BY ALL)
    SELECT h.node, h.pid, h.ts_ns, coalesce(substr(s.cgroup_line, 18), '') AS container_id,
           CASE WHEN h.ts_ns = h.at THEN CASE WHEN s.cgroup_line IS NULL THEN 'failed' ELSE 'looked_up' END
                ELSE CASE WHEN s.cgroup_line IS NULL THEN 'deferred' ELSE 'cached' END END AS answer
    FROM held h JOIN e s ON s.node = h.node AND s.pid = h.pid AND s.ts_ns = h.at"""


def _requests(t: Tables) -> DataFrame:
    return t.sql(_REQUESTS).groupBy("node", "pid", "ts_ns").agg(F.max("cgroup_line").alias("cgroup_line"))


@query("container_lookups", _LOOKUPS)
def _(t: Tables):
    return state.container_lookups(_requests(t), DAY_NS).drop("container_env")


@query("container_lookups_stream", _LOOKUPS)
def _(t: Tables):
    path = shared_dir(t.spark, "stream-lookups")
    rows = _requests(t).withColumn("ts", ns_to_ts(F.col("ts_ns")))
    stream = lambda: t.spark.readStream.schema(rows.schema).parquet(f"{path}/in")
    with state.state_store(t.spark):
        _in_parts(rows, f"{path}/in", lambda _: state.stop_when_idle(
            state.container_lookups_stream(stream(), DAY_NS).writeStream.option("checkpointLocation", f"{path}/checkpoint")
            .start(f"{path}/out", format="parquet")), parts=2)
    return t.spark.read.schema(state.LOOKUP).parquet(f"{path}/out").drop("container_env")


# Work on an executable: every user is a file.
_UPLOADS = """SELECT md5(CAST(user_id AS STRING)) AS file_id, @us(ts) * 1000 AS ts_ns,
                     CASE event_type WHEN 'view' THEN 'seen' WHEN 'signup' THEN 'seen' WHEN 'click' THEN 'in_progress' WHEN 'purchase' THEN 'uploaded' ELSE 'final' END
                     AS status FROM events"""


@query("worklist_changes_stream", f"""
    WITH u AS (SELECT DISTINCT file_id, ts_ns, status FROM ({_UPLOADS})),
    done AS (SELECT file_id, min(ts_ns) AS done_ns FROM u WHERE status IN ('uploaded', 'final') GROUP BY file_id),
    live AS (SELECT u.*, done_ns FROM u LEFT JOIN done USING (file_id) WHERE done_ns IS NULL OR ts_ns <= done_ns),
    first_ AS (SELECT file_id, min(ts_ns) AS ts_ns, arg_min(status, (ts_ns, status <> 'seen')) AS status FROM live GROUP BY file_id),
    busy AS (SELECT file_id, ts_ns, least(coalesce(lead(ts_ns) OVER (PARTITION BY file_id ORDER BY ts_ns), 9000000000000000000),
                                         coalesce(done_ns, 9000000000000000000)) AS next_ns FROM live WHERE status = 'in_progress')
    SELECT file_id, ts_ns, 'upload' AS action FROM first_ WHERE status = 'seen'
    UNION ALL SELECT file_id, ts_ns + {DAY_NS}, 'retry' FROM busy WHERE ts_ns + {DAY_NS} <= next_ns""")
def _(t: Tables):
    path = shared_dir(t.spark, "stream-uploads")
    rows = t.sql(_UPLOADS).distinct().withColumn("ts", ns_to_ts(F.col("ts_ns")))
    stream = lambda: t.spark.readStream.schema(rows.schema).parquet(f"{path}/in")

    def run(_) -> None:
        with state.state_store(t.spark):
            _finish(state.worklist_changes_stream(stream(), DAY_NS).writeStream.option("checkpointLocation", f"{path}/checkpoint")
                    .trigger(availableNow=True).start(f"{path}/out", format="parquet"))
    _in_parts(rows, f"{path}/in", run, parts=3)
    # time goes on, so that what still waits comes back
    later = rows.agg((F.max("ts_ns") + 10 * DAY_NS).alias("ts_ns")).select(F.lit("later").alias("file_id"), "ts_ns", F.lit("final").alias("status"))
    later.withColumn("ts", ns_to_ts(F.col("ts_ns"))).write.mode("append").parquet(f"{path}/in")
    run(None)
    return t.spark.read.schema(state.CHANGE).parquet(f"{path}/out")
