"""Probe scopes, spans, targets; GPU joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from stackloom.operators import gpu, probes
from stackloom.operators.sequence import HOUR_NS
from stackloom.plans import inputs
from stackloom.plans.fixtures import Tables
from stackloom.plans.registry import query

_DAY = 24 * HOUR_NS
_THREAD = ["node", "tid"]

# Depth of each thread that never goes below zero, then the outermost entry and exit of each span.
_SPANS = """
    WITH w AS (SELECT * FROM fx_edges WHERE NOT main_only OR tid = pid),
    s AS (SELECT *, sum(delta) OVER (PARTITION BY node, tid ORDER BY ts_ns) AS total FROM w),
    d AS (SELECT *, total - least(0, min(total) OVER (PARTITION BY node, tid ORDER BY ts_ns)) AS depth FROM s),
    p AS (SELECT *, coalesce(lag(depth) OVER (PARTITION BY node, tid ORDER BY ts_ns), 0) AS was FROM d),
    o AS (SELECT *, max(CASE WHEN delta = 1 AND depth = 1 AND was = 0 THEN ts_ns END)
                        OVER (PARTITION BY node, tid ORDER BY ts_ns) AS start_ns FROM p),
    spans AS (SELECT node, pid, tid, comm, spec_id, ts_ns AS end_ns, ts_ns - start_ns AS duration_ns FROM o
              WHERE delta = -1 AND depth = 0 AND was = 1 AND (min_ms = 0 OR ts_ns - start_ns >= CAST(min_ms AS BIGINT) * 1000000)),
    specs AS (SELECT * FROM (VALUES (1, 'gc'), (2, 'loop'), (3, 'io')) AS v(spec_id, probe_id)),
    named AS (SELECT node, pid, tid, comm, spec_id, probe_id, end_ns - duration_ns AS start_ns, end_ns, duration_ns
              FROM spans JOIN specs USING (spec_id))"""


def scopes(t: Tables):
    return probes.pair_probe_scopes(inputs.edges(t), _THREAD, _DAY)


def spans(t: Tables):
    return probes.probe_spans(scopes(t), probes.probe_specs_table(t.spark, inputs.probe_specs()))


@query("load_probe_specs", """
    SELECT e.spec_id, count(*) AS edges, CASE e.spec_id WHEN 1 THEN 'gc' WHEN 2 THEN 'loop' WHEN 3 THEN 'io' END AS probe_id
    FROM fx_edges e WHERE e.spec_id <= 3 GROUP BY 1""")
def _(t: Tables):
    specs = probes.probe_specs_table(t.spark, inputs.probe_specs())
    counts = t.fx("fx_edges").groupBy("spec_id").agg(F.count(F.lit(1)).alias("edges"))
    return probes.probe_event_spec(counts, specs)


@query("match_probe_targets", """
    WITH x AS (SELECT file_id, CASE WHEN path = '' THEN file_name ELSE path END AS path FROM fx_executables),
    s AS (SELECT * FROM (VALUES (1, 'gc', '(^|/)supplier#0+[0-9]*1/'), (2, 'loop', 'Supplier#0+[0-9]*[02468]$'),
                                (3, 'io', '5/bin$')) AS v(spec_id, probe_id, re))
    SELECT file_id, path, spec_id, probe_id FROM x JOIN s ON regexp_matches(path, re)""")
def _(t: Tables):
    return probes.match_probe_targets(inputs.executables(t), inputs.probe_specs())


@query("pair_probe_scopes", _SPANS + " SELECT * FROM spans")
def _(t: Tables):
    return scopes(t)


@query("probe_event_spec", _SPANS + """
    SELECT node, tid, end_ns, spec_id, probe_id FROM named""")
def _(t: Tables):
    specs = probes.probe_specs_table(t.spark, inputs.probe_specs())
    return probes.probe_event_spec(scopes(t), specs).select("node", "tid", "end_ns", "spec_id", "probe_id")


@query("unknown_probe_events", """
    SELECT spec_id, count(*) AS dropped FROM fx_edges WHERE spec_id NOT IN (1, 2, 3) GROUP BY 1""")
def _(t: Tables):
    specs = probes.probe_specs_table(t.spark, inputs.probe_specs())
    return probes.unknown_probe_events(t.fx("fx_edges"), specs)


@query("probe_spans", _SPANS + " SELECT * FROM named")
def _(t: Tables):
    return spans(t)


@query("samples_in_span", _SPANS + """
    SELECT e.event_id, e.node, n.tid, e.ts_ns, n.start_ns AS span_start_ns, n.end_ns AS span_end_ns, n.spec_id, n.probe_id
    FROM fx_events e JOIN named n ON e.node = n.node AND n.tid = e.pid AND e.ts_ns BETWEEN n.start_ns AND n.end_ns""")
def _(t: Tables):
    samples = inputs.events(t).select("event_id", "node", F.col("pid").alias("tid"), "ts_ns")
    return probes.samples_in_span(samples, spans(t), _THREAD, _DAY)


# ---- GPU --------------------------------------------------------------------------------------

_CONFIGS = """SELECT 'NODE_' || CAST(user_id % 25 AS STRING) AS node, user_id AS pid, @us(ts) * 1000 AS ts_ns, 10 + event_id % 8 AS sampling_factor,
                     CASE WHEN event_id % 50 = 3 THEN 0 ELSE 1000000000 + event_id * 1000 END AS clock_hz
              FROM events WHERE event_type = 'error'"""


@query("gpu_ns_per_sample", """
    WITH c AS (SELECT node, pid, ts_ns, 10 + event_id % 8 AS f,
                      CASE WHEN event_id % 50 = 3 THEN 0 ELSE 1000000000 + event_id * 1000 END AS hz
               FROM fx_events WHERE origin = 'gpu_pc')
    SELECT e.event_id, e.pid, e.ts_ns, CASE WHEN hz > 0 THEN ((1::BIGINT << f) * 1000000000) // hz ELSE 0 END AS ns_per_sample
    FROM fx_events e ASOF LEFT JOIN c ON e.node = c.node AND e.pid = c.pid AND e.ts_ns >= c.ts_ns""")
def _(t: Tables):
    events = inputs.events(t).select("event_id", "node", "pid", "ts_ns")
    return gpu.gpu_ns_per_sample(events, t.sql(_CONFIGS), ["node", "pid"], _DAY).drop("node")


# An order is a launch by its customer; each of its line items is one kernel it started. Process and correlation ids are
# small numbers that repeat over machines. A timing has a time of its own, seconds after the launch.
_LAUNCHES = """SELECT 'NODE_' || CAST(o_orderkey % 25 AS STRING) AS node, o_custkey % 40 AS pid, CAST(floor(o_orderkey / 25) AS BIGINT) AS correlation_id,
                      @us(o_orderdate) * 1000 AS ts_ns FROM orders"""
_TIMINGS = """SELECT 'NODE_' || CAST(o.o_orderkey % 25 AS STRING) AS node, o.o_custkey % 40 + CASE WHEN l.l_linenumber = 7 THEN 1 ELSE 0 END AS pid,
                     CAST(floor(o.o_orderkey / 25) AS BIGINT) AS correlation_id, p.p_name AS kernel_name,
                     CAST(l.l_quantity AS BIGINT) * 1000 AS duration_ns, @us(o.o_orderdate) * 1000 + CAST(l.l_linenumber AS BIGINT) * 1000000000 AS at_ns
              FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN part p ON l.l_partkey = p.p_partkey"""
_MATCHED = f"""
    WITH la AS ({_LAUNCHES}), ti AS ({_TIMINGS})
    SELECT la.node, la.pid, la.correlation_id, la.ts_ns, ti.kernel_name, ti.duration_ns AS raw_value, 'cuda' AS origin
    FROM la JOIN ti ON la.node = ti.node AND la.pid = ti.pid AND la.correlation_id = ti.correlation_id"""


@query("gpu_kernel_times", _MATCHED)
def _(t: Tables):
    return gpu.gpu_kernel_times(t.sql(_LAUNCHES), t.sql(_TIMINGS))


_UNMATCHED = f"""
    WITH la AS ({_LAUNCHES}), ti AS ({_TIMINGS})
    SELECT 'launch' AS side, count(*) AS cleared FROM la WHERE NOT EXISTS (
        SELECT 1 FROM ti WHERE ti.node = la.node AND ti.pid = la.pid AND ti.correlation_id = la.correlation_id)
    UNION ALL SELECT 'timing', count(*) FROM ti WHERE NOT EXISTS (
        SELECT 1 FROM la WHERE ti.node = la.node AND ti.pid = la.pid AND ti.correlation_id = la.correlation_id)"""


@query("gpu_unmatched", _UNMATCHED)
def _(t: Tables):
    return gpu.gpu_unmatched(t.sql(_LAUNCHES), t.sql(_TIMINGS))


@query("gpu_pc_symbols", """
    WITH pc AS (SELECT l_orderkey, l_linenumber, 'NODE_' || CAST(l_suppkey % 3 AS VARCHAR) AS node, l_partkey % 500 AS pid, l_suppkey * 7 AS cubin_crc, l_partkey % 80 AS stall_index,
                       CAST(l_quantity AS BIGINT) AS n FROM lineitem),
    cu AS (SELECT s_suppkey * 7 AS cubin_crc, md5(CAST(s_suppkey AS VARCHAR)) AS file_id, 70 + s_nationkey AS sm FROM supplier
           WHERE s_acctbal > 0),
    m AS (SELECT 'NODE_' || CAST(c_custkey % 3 AS VARCHAR) AS node, c_custkey // 3 AS pid, unnest(range(0, 80)) AS i, c_mktsegment AS seg
          FROM customer WHERE c_acctbal > 0)
    SELECT pc.node, pc.pid, pc.cubin_crc, pc.stall_index, sum(pc.n) AS n, cu.file_id AS cubin_file_id, cu.sm AS sm_version,
           CASE WHEN cu.file_id IS NOT NULL THEN 'cubin-' || lpad(lower(to_hex(pc.cubin_crc)), 16, '0') END AS cubin_name,
           lower(m.seg) || '-' || CAST(m.i AS VARCHAR) AS stall_reason
    FROM pc LEFT JOIN cu ON pc.cubin_crc = cu.cubin_crc LEFT JOIN m ON m.node = pc.node AND m.pid = pc.pid AND m.i = pc.stall_index
    GROUP BY 1, 2, 3, 4, 6, 7, 8, 9""")
def _(t: Tables):
    pc = t.sql("""SELECT concat('NODE_', l_suppkey % 3) AS node, l_partkey % 500 AS pid, l_suppkey * 7 AS cubin_crc, CAST(l_partkey % 80 AS INT) AS stall_index,
                         sum(CAST(l_quantity AS BIGINT)) AS n FROM lineitem GROUP BY 1, 2, 3, 4""")
    cubins = t.sql("""SELECT s_suppkey * 7 AS cubin_crc, md5(CAST(s_suppkey AS STRING)) AS file_id, 70 + s_nationkey AS sm_version,
                             stack(1, 0L) AS ts_ns FROM supplier WHERE s_acctbal > 0""")
    maps = t.sql("""SELECT concat('NODE_', c_custkey % 3) AS node, c_custkey div 3 AS pid, 0L AS ts_ns,
                           transform(sequence(0, 79), i -> concat(lower(c_mktsegment), '-', CAST(i AS STRING), '\\0junk')) AS names
                    FROM customer WHERE c_acctbal > 0""")
    return gpu.gpu_pc_symbols(pc, cubins, maps)
