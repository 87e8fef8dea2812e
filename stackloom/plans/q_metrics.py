"""Metrics, logs, fleet tables and work lists."""

from __future__ import annotations

from pyspark.sql import functions as F

from stackloom.functions.labels import labels_string
from stackloom.operators import fleet, metrics, profiles
from stackloom.operators.sequence import HOUR_NS
from stackloom.plans import inputs
from stackloom.plans.fixtures import Tables
from stackloom.plans.registry import query

_DAY = 24 * HOUR_NS


@query("write_request_totals", """
    SELECT o_orderstatus AS code, count(*) AS requests, sum(CAST(floor(o_totalprice) AS BIGINT)) AS sample_bytes,
           sum(o_custkey) AS stack_bytes FROM orders GROUP BY 1""")
def _(t: Tables):
    return metrics.write_request_totals(t.sql("""
        SELECT o_orderstatus AS code, CAST(floor(o_totalprice) AS BIGINT) AS sample_bytes, o_custkey AS stack_bytes FROM orders"""))


@query("metric_points_rollup", """
    WITH r AS (SELECT node, metric_id, arg_max(value, ts_ns) AS last_value, sum(value) AS total FROM fx_points GROUP BY 1, 2)
    SELECT r.node, replace(d.field, '.', '_') AS metric, d.metric_type, d.unit,
           CASE WHEN d.metric_type = 'gauge' THEN last_value ELSE total END AS value
    FROM r JOIN fx_metric_defs d ON r.metric_id = d.metric_id""")
def _(t: Tables):
    return metrics.metric_points_rollup(t.fx("fx_points"), t.fx("fx_metric_defs"), ["node"])


_INCREASE = """
    WITH s AS (SELECT *, lag(value) OVER (PARTITION BY pod, cache ORDER BY ts_ns, event_id) AS before FROM fx_points),
    i AS (SELECT *, CASE WHEN before IS NULL THEN 0 WHEN value < before THEN value ELSE value - before END AS increase,
                 time_bucket(INTERVAL 1 day, make_timestamp(ts_ns // 1000)) AS window_start FROM s)"""


@query("counter_rate", _INCREASE + """
    SELECT cache, window_start, sum(increase) AS increase, CAST(round(CAST(sum(increase) AS DOUBLE) / 86400 * 1000000) AS BIGINT) AS rate_micros FROM i GROUP BY 1, 2""")
def _(t: Tables):
    out = metrics.counter_rate(t.fx("fx_points"), ["pod", "cache"], ["cache"], "1 day", _DAY, tie="event_id")
    return out.select("cache", "window_start", "increase", F.round(F.col("rate") * 1_000_000).cast("long").alias("rate_micros"))


@query("gauge_max", """
    SELECT pod, time_bucket(INTERVAL 1 day, make_timestamp(ts_ns // 1000)) AS window_start, max(value) AS value
    FROM fx_points GROUP BY 1, 2""")
def _(t: Tables):
    return metrics.gauge_max(t.fx("fx_points"), ["pod"], "1 day")


@query("ratio_of_rates", """
    WITH e AS (SELECT *, lag(value) OVER (PARTITION BY pod, cache ORDER BY ts_ns, event_id) AS before FROM fx_points WHERE result = 'miss'),
    a AS (SELECT *, lag(value) OVER (PARTITION BY pod, cache ORDER BY ts_ns, event_id) AS before FROM fx_points),
    ei AS (SELECT cache, time_bucket(INTERVAL 1 day, make_timestamp(ts_ns // 1000)) AS window_start,
                  sum(CASE WHEN before IS NULL THEN 0 WHEN value < before THEN value ELSE value - before END) AS errors
           FROM e GROUP BY 1, 2),
    ai AS (SELECT time_bucket(INTERVAL 1 day, make_timestamp(ts_ns // 1000)) AS window_start,
                  sum(CASE WHEN before IS NULL THEN 0 WHEN value < before THEN value ELSE value - before END) AS samples
           FROM a GROUP BY 1)
    SELECT ei.window_start, ei.cache, errors, samples,
           CAST(round(CAST(errors AS DOUBLE) / nullif(samples, 0) * 1000000) AS BIGINT) AS ratio_micros
    FROM ei JOIN ai ON ei.window_start = ai.window_start""")
def _(t: Tables):
    points = t.fx("fx_points")
    out = metrics.ratio_of_rates(points.where("result = 'miss'"), points, ["cache"], ["pod", "cache"], "1 day", _DAY, tie="event_id")
    return out.select("window_start", "cache", "errors", "samples",
                      F.round(F.col("ratio") * 1_000_000).cast("long").alias("ratio_micros"))


# Latency buckets per node; the value is hundredths.
_BUCKETS = """
    SELECT node, le, sum(n) OVER (PARTITION BY node ORDER BY le) AS cumulative FROM (
        SELECT node, CASE WHEN value <= 500 THEN 500 WHEN value <= 1000 THEN 1000 WHEN value <= 2000 THEN 2000
                          WHEN value <= 4000 THEN 4000 WHEN value <= 8000 THEN 8000 ELSE 1000000 END AS le, count(*) AS n
        FROM fx_points GROUP BY 1, 2)"""


@query("histogram_quantile", f"""
    WITH b AS ({_BUCKETS}),
    r AS (SELECT *, 0.5 * max(cumulative) OVER (PARTITION BY node) AS rank,
                 coalesce(lag(cumulative) OVER (PARTITION BY node ORDER BY le), 0) AS below,
                 coalesce(lag(le) OVER (PARTITION BY node ORDER BY le), 0) AS low FROM b),
    h AS (SELECT *, row_number() OVER (PARTITION BY node ORDER BY le) AS i FROM r WHERE cumulative >= rank)
    SELECT node, CAST(round(CASE WHEN le = 1000000 THEN low ELSE low + (le - low) * (rank - below) / (cumulative - below) END)
                      AS BIGINT) AS median FROM h WHERE i = 1""")
def _(t: Tables):
    buckets = t.sql(_BUCKETS).withColumn("le", F.expr("CASE WHEN le = 1000000 THEN double('infinity') ELSE double(le) END"))
    return metrics.histogram_quantile(buckets, 0.5, ["node"]).select("node", F.round("quantile").cast("long").alias("median"))


@query("hit_ratio", """
    SELECT cache, sum(value) FILTER (result = 'hit') AS hits, sum(value) AS requests,
           CAST(round(CAST(sum(value) FILTER (result = 'hit') AS DOUBLE) / sum(value) * 1000000) AS BIGINT) AS ratio_micros FROM fx_points GROUP BY 1""")
def _(t: Tables):
    return metrics.hit_ratio(t.fx("fx_points"), ["cache"]).select(
        "cache", "hits", "requests", F.round(F.col("ratio") * 1_000_000).cast("long").alias("ratio_micros"))


@query("metrics_export", """
    SELECT 'points' AS scope, 'region=eu' AS resource, node AS name, max(value) AS value, NULL AS n FROM fx_points GROUP BY node
    UNION ALL SELECT 'events', 'region=eu', origin, NULL, count(*) FROM fx_events GROUP BY origin""")
def _(t: Tables):
    def broken():
        raise RuntimeError("no such device")

    def fails_when_run():
        return t.fx("fx_points").select("node", F.raise_error(F.lit("device lost")).cast("long").alias("value"))

    table = metrics.metrics_export({
        "points": lambda: t.fx("fx_points").groupBy(F.col("node").alias("name")).agg(F.max("value").alias("value")),
        "gpu": broken,
        "late": fails_when_run,
        "events": lambda: t.fx("fx_events").groupBy(F.col("origin").alias("name")).agg(F.count(F.lit(1)).alias("n")),
    }, {"region": "eu"})
    return table.withColumn("resource", labels_string(F.col("resource")))


@query("heartbeat_series", """
    SELECT 'agent_info' AS name, epoch_us(ts) // 1000 AS ts_ms, 1 AS value, 'arch=' || arch || ',is_container='
           || CASE WHEN is_container THEN 'true' ELSE 'false' END || ',kernel_osrelease=' || kernel_osrelease
           || ',kernel_version=' || kernel_version || ',machine_id=' || machine_id || ',os_name=linux,os_release=' || os_release
           || ',os_vendor=vendor,os_version=22.04,version=' || version AS labels FROM fx_beats
    UNION ALL SELECT 'agent_cpu_cores', epoch_us(ts) // 1000, cpu_cores, 'machine_id=' || machine_id FROM fx_beats""")
def _(t: Tables):
    beats = t.fx("fx_beats").withColumn("ts", F.col("ts").cast("timestamp"))
    return fleet.heartbeat_series(beats).withColumn("labels", labels_string(F.col("labels")))


@query("fleet_summary", """
    WITH l AS (SELECT machine_id, any_value(arch) AS arch, any_value(version) AS version, any_value(kernel_version) AS kernel_version,
                      any_value(cpu_cores) AS cpu_cores, count(*) AS n FROM fx_beats GROUP BY 1)
    SELECT arch, version, kernel_version, count(*) AS machines, sum(cpu_cores) AS cpu_cores, sum(n) AS heartbeats
    FROM l GROUP BY 1, 2, 3""")
def _(t: Tables):
    return fleet.fleet_summary(t.fx("fx_beats"), ["arch", "version", "kernel_version"])


@query("capacity_estimate", """
    SELECT c_custkey, cpu_cores, 95 * cpu_cores AS max_rows_per_batch,
           CAST(pow(2, ceil(log2(greatest(95 * cpu_cores * 6, 65536)))) AS BIGINT) AS trace_cache_size
    FROM (SELECT c_custkey, 1 + c_custkey % 600 AS cpu_cores FROM customer)""")
def _(t: Tables):
    return fleet.capacity_estimate(t.sql("SELECT c_custkey, 1 + c_custkey % 600 AS cpu_cores FROM customer"))


@query("oom_profile_series", """
    SELECT '__name__=memory,comm=' || comm || ',job=oomprof,node=' || node || ',pid=' || CAST(pid AS VARCHAR) || ',region=eu'
           AS labels, length(cmdline) AS size FROM fx_processes""")
def _(t: Tables):
    profiles_ = inputs.processes(t).withColumn("raw_profile", F.encode("cmdline", "UTF-8"))
    return fleet.oom_profile_series(profiles_, {"region": "eu", "job": "x"}).select(
        labels_string(F.col("labels")).alias("labels"), F.octet_length("raw_profile").cast("long").alias("size"))


_FIELDS = """map('pid', named_struct('int_value', user_id, 'bool_value', CAST(NULL AS BOOLEAN), 'string_value', CAST(NULL AS STRING)),
                 'props', named_struct('int_value', CAST(NULL AS BIGINT), 'bool_value', CAST(NULL AS BOOLEAN), 'string_value', props),
                 'flag', named_struct('int_value', CAST(NULL AS BIGINT), 'bool_value', user_id % 2 = 0, 'string_value',
                                      CAST(NULL AS STRING)),
                 CASE WHEN event_type = 'signup' THEN 'otlp_skip' ELSE 'other' END,
                 named_struct('int_value', CAST(NULL AS BIGINT), 'bool_value', value > 50, 'string_value',
                              CAST(NULL AS STRING)))"""
_LEVEL = """CASE event_type WHEN 'view' THEN 'info' WHEN 'click' THEN 'warning' WHEN 'error' THEN 'error'
                            WHEN 'signup' THEN 'panic' ELSE 'odd' END"""


@query("log_records", f"""
    SELECT event_id, event_type AS body, CASE event_type WHEN 'view' THEN 'info' WHEN 'click' THEN 'warn' WHEN 'error' THEN 'error'
           WHEN 'signup' THEN 'fatal' ELSE 'undefined' END AS severity, upper({_LEVEL}) AS severity_text,
           'flag=' || CASE WHEN user_id % 2 = 0 THEN 'true' ELSE 'false' END || ';level=' || upper({_LEVEL})
           || CASE WHEN event_type <> 'signup' THEN ';other=' || CASE WHEN value > 50 THEN 'true' ELSE 'false' END ELSE '' END
           || ';pid=int ' || CAST(user_id AS VARCHAR) || ';props=' || props AS attributes
    FROM events WHERE NOT (event_type = 'signup' AND value > 50)""")
def _(t: Tables):
    logs = t.sql(f"SELECT event_id, {_LEVEL} AS level, event_type AS message, {_FIELDS} AS fields FROM events")
    out = fleet.log_records(logs)
    text = F.array_join(F.transform(F.array_sort(F.map_keys("attributes")), lambda k: F.concat(
        k, F.lit("="), F.coalesce(F.concat(F.lit("int "), F.col("attributes")[k]["int_value"].cast("string")),
                                  F.col("attributes")[k]["string_value"], F.lit("")))), ";")
    return out.withColumn("attributes", text)


@query("log_severity", f"""
    SELECT event_id, CASE event_type WHEN 'view' THEN 'info' WHEN 'click' THEN 'warn' WHEN 'error' THEN 'error'
           WHEN 'signup' THEN 'fatal' ELSE 'undefined' END AS severity FROM events""")
def _(t: Tables):
    return t.sql(f"SELECT event_id, {_LEVEL} AS level FROM events").select(
        "event_id", fleet.log_severity(F.col("level")).alias("severity"))


@query("debuginfo_worklist", """
    WITH st AS (SELECT md5(CAST(s_suppkey AS VARCHAR)) AS file_id,
                       CASE WHEN s_acctbal < 0 THEN 'final' WHEN s_acctbal < 3000 THEN 'uploaded' ELSE 'in_progress' END AS state,
                       s_suppkey * 10000000000 AS tried FROM supplier WHERE s_acctbal < 8000)
    SELECT file_id, file_name, CASE WHEN build_id = '' THEN file_id ELSE build_id END AS build_id,
           CASE WHEN build_id = '' THEN 'hash' ELSE 'gnu' END AS build_id_type
    FROM fx_executables WHERE file_id NOT IN (SELECT file_id FROM st WHERE state <> 'in_progress' OR tried + 300000000000 > 700000000000)""")
def _(t: Tables):
    status = t.sql("""
        SELECT md5(CAST(s_suppkey AS STRING)) AS file_id, CASE WHEN s_acctbal < 0 THEN 'final' WHEN s_acctbal < 3000 THEN 'uploaded'
               ELSE 'in_progress' END AS state, s_suppkey * 10000000000 AS attempted_ns FROM supplier WHERE s_acctbal < 8000""")
    seen = inputs.executables(t).unionByName(inputs.executables(t))
    return fleet.debuginfo_worklist(seen, status, 700_000_000_000)


@query("cpu_time_by_label", """
    SELECT p.comm, s.node, sum(s.value * s.period) AS cpu_ns FROM ox_samples s JOIN fx_processes p ON s.pid = p.pid
    WHERE s.sample_type = 'samples' GROUP BY 1, 2""")
def _(t: Tables):
    labels = F.create_map(F.lit("node"), F.col("node"), F.lit("comm"), F.col("comm"))
    rows = inputs.samples(t).drop("comm").join(inputs.processes(t).select("pid", "comm"), "pid").withColumn("labels", labels)
    return profiles.cpu_time_by_label(rows, ["comm", "node"]).withColumn("cpu_ns", F.col("cpu_ns").cast("long"))
