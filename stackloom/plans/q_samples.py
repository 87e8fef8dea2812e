"""Samples: by origin, sampled, batched, counted."""

from __future__ import annotations

from pyspark.sql import functions as F

from stackloom.operators import metrics, samples as ops, sequence
from stackloom.plans import inputs
from stackloom.plans.fixtures import Tables
from stackloom.plans.registry import query
from stackloom.sources.tables import read_trace_events

_SAMPLE = """event_id, ts_ns, node, pid, tid, cpu, comm, origin, stack_key AS stacktrace_id, value, sample_type,
    sample_unit, period_type, period_unit, producer, temporality, period, duration"""


@query("read_trace_events", """
    SELECT ts_ns, pid, tid, CAST(cpu AS INTEGER) AS cpu, comm, origin, raw_value FROM fx_events""")
def _(t: Tables):
    return read_trace_events(t.spark, f"{t.sf_dir}/events.parquet", {
        "ts_ns": "unix_micros(cast(ts as timestamp)) * 1000", "pid": "user_id", "tid": "user_id * 10 + event_id % 4",
        "cpu": "cast(event_id % 8 as int)", "comm": "concat('comm-', user_id % 7)",
        "origin": "coalesce(element_at(map('view','sampling','click','off_cpu','purchase','memory','signup','cuda',"
                  "'error','gpu_pc'), event_type), 'unknown')",
        "raw_value": "cast(round(value * 100) as bigint)"})


@query("normalize_samples", f"SELECT {_SAMPLE} FROM ox_samples")
def _(t: Tables):
    return inputs.samples(t)


@query("normalize_offcpu_period", """
    SELECT event_id, 'v1' AS schema_version, raw_value AS value, 52631578 AS period FROM fx_events WHERE origin = 'off_cpu'
    UNION ALL SELECT event_id, 'v2', raw_value, 0 FROM fx_events WHERE origin = 'off_cpu'""")
def _(t: Tables):
    offcpu = inputs.events(t).where("origin = 'off_cpu'")
    versions = [
        ops.normalize_samples(offcpu, schema_version=v).select("event_id", F.lit(v).alias("schema_version"), "value", "period")
        for v in ("v1", "v2")]
    return versions[0].unionByName(versions[1])


@query("memory_samples", """
    SELECT event_id, sample_type, sample_unit, value, period, duration, producer, temporality FROM ox_samples
    WHERE origin = 'memory'
    UNION ALL SELECT event_id, 'alloc_objects', 'count', allocs, 524288, 0, 'memory', NULL FROM fx_events WHERE origin = 'memory'
    UNION ALL SELECT event_id, 'alloc_space', 'bytes', alloc_bytes, 524288, 0, 'memory', NULL FROM fx_events
    WHERE origin = 'memory'""")
def _(t: Tables):
    return ops.memory_samples(inputs.events(t), report_allocs=True).select(
        "event_id", "sample_type", "sample_unit", "value", "period", "duration", "producer", "temporality")


@query("gpu_samples", """
    WITH e AS (SELECT *, CASE WHEN pid % 3 = 0 THEN 0 ELSE pid % 5 + 1 END AS ns FROM fx_events
               WHERE origin IN ('cuda', 'gpu_pc'))
    SELECT event_id, 'split' AS mode, CASE origin WHEN 'cuda' THEN 'gpu_kernel_time' ELSE 'gpu_pcsample' END AS sample_type,
           CASE origin WHEN 'cuda' THEN 'nanoseconds' ELSE 'count' END AS sample_unit, raw_value AS value,
           CASE origin WHEN 'cuda' THEN 1 ELSE ns END AS period, NULL AS gpu_view FROM e
    UNION ALL
    SELECT event_id, 'merged', 'gpu_time', 'nanoseconds',
           CASE WHEN origin = 'gpu_pc' AND ns > 0 THEN raw_value * ns ELSE raw_value END, 1,
           CASE origin WHEN 'cuda' THEN 'kernel_time' ELSE 'pc_sample' END FROM e""")
def _(t: Tables):
    events = inputs.events(t).withColumn("ns_per_sample", F.expr("CASE WHEN pid % 3 = 0 THEN NULL ELSE pid % 5 + 1 END"))
    split = ops.gpu_samples(events).withColumn("mode", F.lit("split")).withColumn("gpu_view", F.lit(None).cast("string"))
    merged = ops.gpu_samples(events, merge=True).withColumn("mode", F.lit("merged"))
    names = ["event_id", "mode", "sample_type", "sample_unit", "value", "period", "gpu_view"]
    return split.select(*names).unionByName(merged.select(*names))


@query("empty_stacks", """
    SELECT event_id, stack_key AS stacktrace_id FROM fx_events
    WHERE NOT EXISTS (SELECT 1 FROM fx_frames f WHERE f.stack_key = fx_events.stack_key)""")
def _(t: Tables):
    inline = inputs.events(t).join(inputs.stacks(t), "stacktrace_id", "left")
    return ops.empty_stacks(inline).select("event_id", "stacktrace_id")


@query("oom_frames", """
    SELECT c.c_custkey AS pid, c.c_custkey AS tid, row_number() OVER (PARTITION BY c.c_custkey ORDER BY o.o_orderkey) AS frame_idx,
           'oomprof' AS frame_type, o.o_orderkey * 16 AS address, md5(CAST(c.c_custkey AS VARCHAR)) AS function_name,
           '/usr/bin/' || lower(c.c_mktsegment) AS source_file
    FROM customer c JOIN orders o ON o.o_custkey = c.c_custkey""")
def _(t: Tables):
    profiles = t.sql("""
        SELECT c_custkey AS pid, CAST(0 AS BIGINT) AS ts_ns, 'NODE_' || CAST(c_custkey % 25 AS STRING) AS node,
               lower(c_mktsegment) AS comm, md5(CAST(c_custkey AS STRING)) AS build_id,
               '/usr/bin/' || lower(c_mktsegment) AS executable_path,
               named_struct('allocs', 1L, 'frees', 0L, 'alloc_bytes', 64L, 'free_bytes', 0L) AS mem,
               array_sort(collect_list(o_orderkey * 16)) AS addresses
        FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey, c_mktsegment""")
    return (ops.oom_events(profiles).select("pid", "tid", F.posexplode("frames").alias("pos", "f"))
            .selectExpr("pid", "tid", "CAST(pos + 1 AS BIGINT) AS frame_idx", "f.frame_type", "f.address", "f.function_name",
                        "f.source_file"))


@query("pipeline_counters", """
    WITH e AS (SELECT origin, pid % 10 <> 3 AS keep,
                      (SELECT count(*) FROM fx_frames f WHERE f.stack_key = fx_events.stack_key) AS n_frames FROM fx_events)
    SELECT CASE WHEN NOT keep THEN 'skipped_by_relabeling' ELSE
           CASE origin WHEN 'sampling' THEN 'cpu' WHEN 'cuda' THEN 'gpu' WHEN 'gpu_pc' THEN 'gpu_pc' WHEN 'off_cpu' THEN 'offcpu'
                WHEN 'memory' THEN 'memory' ELSE 'unknown' END END AS counter, count(*) AS n FROM e GROUP BY 1
    UNION ALL SELECT 'empty', count(*) FROM e WHERE keep AND n_frames = 0
    UNION ALL SELECT 'written_rows', count(*) FROM ox_samples""")
def _(t: Tables):
    sizes = inputs.frames(t).groupBy("stacktrace_id").agg(F.count(F.lit(1)).alias("n_frames"))
    events = inputs.events(t).withColumn("keep", F.expr("pid % 10 <> 3")).join(sizes, "stacktrace_id", "left").fillna(
        0, ["n_frames"])
    return metrics.pipeline_counters(events, inputs.samples(t))


@query("report_batches", """
    SELECT node, time_bucket(INTERVAL 5 seconds, make_timestamp(ts_ns // 1000)) AS batch_start, count(*) AS rows
    FROM ox_samples GROUP BY 1, 2""")
def _(t: Tables):
    from stackloom.functions.values import ns_to_ts
    return sequence.report_batches(inputs.samples(t).withColumn("ts", ns_to_ts(F.col("ts_ns"))), ["node"])


@query("probabilistic_gate", """
    SELECT event_id, node, ts_ns FROM fx_events
    WHERE CAST('0x' || substr(md5(node || '|' || CAST(ts_ns // 60000000000 AS VARCHAR) || '|7'), 1, 8) AS BIGINT) % 100 < 35""")
def _(t: Tables):
    return sequence.probabilistic_gate(inputs.events(t), 35, seed="7").select("event_id", "node", "ts_ns")


@query("offcpu_sample", """
    SELECT event_id, origin FROM fx_events WHERE origin <> 'off_cpu' OR
           CAST('0x' || substr(md5(CAST(event_id AS VARCHAR)), 1, 8) AS BIGINT) < 1073741824""")
def _(t: Tables):
    return sequence.offcpu_sample(inputs.events(t), 0.25, ["event_id"]).select("event_id", "origin")


# Times by the hour and by the minute: many rows of a thread or node share one, and the event number decides.


@query("thread_migrations", f"""
    WITH e AS (SELECT node, tid, event_id, cpu, ts_ns // {sequence.HOUR_NS} * {sequence.HOUR_NS} AS ts_ns FROM fx_events)
    SELECT node, tid, ts_ns, cpu, previous_cpu FROM (
        SELECT node, tid, ts_ns, cpu, lag(cpu) OVER (PARTITION BY node, tid ORDER BY ts_ns, event_id) AS previous_cpu FROM e)
    WHERE previous_cpu IS NOT NULL AND cpu <> previous_cpu""")
def _(t: Tables):
    events = inputs.events(t).withColumn("ts_ns", F.expr(f"ts_ns div {sequence.HOUR_NS} * {sequence.HOUR_NS}"))
    return sequence.thread_migrations(events, ["node", "tid"], width=24 * sequence.HOUR_NS, tie="event_id")


@query("run_length_encode", """
    WITH e AS (SELECT node, event_id, ts_ns // 60000000000 * 60000000000 AS ts_ns,
                      CASE WHEN origin = 'unknown' THEN NULL ELSE origin END AS origin FROM fx_events),
    s AS (SELECT *, CASE WHEN lag(ts_ns) OVER w IS NOT NULL AND origin IS NOT DISTINCT FROM lag(origin) OVER w
                         THEN 0 ELSE 1 END AS st FROM e WINDOW w AS (PARTITION BY node ORDER BY ts_ns, event_id)),
    g AS (SELECT *, sum(st) OVER (PARTITION BY node ORDER BY ts_ns, event_id) AS run FROM s)
    SELECT node, min(ts_ns) AS run_start, max(ts_ns) AS run_end, any_value(origin) AS origin, count(*) AS run_length
    FROM g GROUP BY node, run""")
def _(t: Tables):
    events = inputs.events(t).withColumns({
        "origin": F.nullif("origin", F.lit("unknown")), "ts_ns": F.expr("ts_ns div 60000000000 * 60000000000")})
    return sequence.run_length_encode(events, ["node"], "ts_ns", "origin", width=sequence.HOUR_NS, tie="event_id")


@query("clock_align", """
    WITH o AS (SELECT node, ts_ns AS mono_ns, raw_value * 1000 AS offset_ns FROM fx_events WHERE origin = 'sampling')
    SELECT e.event_id, e.node, e.ts_ns AS mono_ns, o.offset_ns, e.ts_ns + o.offset_ns AS ts_ns
    FROM fx_events e ASOF LEFT JOIN o ON e.node = o.node AND e.ts_ns >= o.mono_ns""")
def _(t: Tables):
    events = inputs.events(t).select("event_id", "node", F.col("ts_ns").alias("mono_ns"))
    offsets = inputs.events(t).where("origin = 'sampling'").select(
        "node", F.col("ts_ns").alias("mono_ns"), (F.col("raw_value") * 1000).alias("offset_ns"))
    return sequence.clock_align(events, offsets, ["node"])
