"""Frames, stacks, dictionaries and profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from stackloom.functions.values import ns_to_ts
from stackloom.operators import frames as frame_ops, profiles, stacks as stack_ops
from stackloom.plans import inputs
from stackloom.plans.fixtures import Tables
from stackloom.plans.registry import query

_LOCATION = """stack_key AS stacktrace_id, frame_idx, address, frame_type, mapping_file, mapping_build_id, has_line, line,
    "column", function_system_name, CAST(NULL AS VARCHAR) AS function_name, function_filename, frame_complete"""

# The canonical text of a frame: each value with its length in front, '-' for NULL.
_FIELDS = ["frame_type", "address", "file_id", "gnu_build_id", "mapping_file_name", "function_name", "source_file",
           "source_line", "source_column"]


def _canonical(fields: list[str]) -> str:
    parts = [f"coalesce(length(CAST({f} AS VARCHAR)) || ':' || CAST({f} AS VARCHAR), '-')" for f in fields]
    return " || ',' || ".join(parts)


@query("join_frame_executable", """
    SELECT f.stack_key AS stacktrace_id, f.frame_idx, f.file_id, e.file_name AS exec_file_name,
           e.build_id AS exec_build_id, e.file_id IS NOT NULL AS exec_known
    FROM fx_frames f LEFT JOIN fx_executables e ON f.file_id = e.file_id""")
def _(t: Tables):
    return frame_ops.join_frame_executable(
        inputs.frames(t).select("stacktrace_id", "frame_idx", "file_id"), inputs.executables(t))


@query("resolve_frames", f"SELECT {_LOCATION} FROM ox_locations")
def _(t: Tables):
    return inputs.locations(t)


@query("resolve_frames_v1", """
    SELECT l.stack_key AS stacktrace_id, l.frame_idx, l.mapping_file, l.mapping_build_id, l.line,
           CASE WHEN l.frame_type = 'kernel' THEN f.source_column ELSE l."column" END AS "column",
           CASE WHEN l.frame_type = 'cuda-pc' THEN f.function_name WHEN l.has_line THEN '' END AS function_system_name,
           CASE WHEN l.frame_type <> 'cuda-pc' THEN l.function_system_name END AS function_name, l.function_filename
    FROM ox_locations l JOIN fx_frames f ON l.stack_key = f.stack_key AND l.frame_idx = f.frame_idx""")
def _(t: Tables):
    return inputs.locations(t, "v1").select(
        "stacktrace_id", "frame_idx", "mapping_file", "mapping_build_id", "line", "column", "function_system_name",
        "function_name", "function_filename")


@query("classify_unwind_completeness", """
    SELECT s.stack_key AS stacktrace_id, coalesce(bool_and(l.frame_complete), true) AS is_complete
    FROM (SELECT stack_key FROM fx_stacks UNION SELECT stack_key FROM fx_frames) s LEFT JOIN ox_locations l ON l.stack_key = s.stack_key
    GROUP BY 1""")
def _(t: Tables):
    every = inputs.stack_table(t).unionByName(inputs.frames(t).select("stacktrace_id"))
    return frame_ops.classify_unwind_completeness(inputs.locations(t), "stacktrace_id", stacks=every)


# The JSON text of a frame, NULL fields left out.
_JSON = "'{' || concat_ws(',', " + ", ".join(
    f"""'"{f}":' || CAST({f} AS VARCHAR)""" if f in ("address", "source_line", "source_column")
    else f"""'"{f}":"' || {f} || '"'""" for f in _FIELDS) + ") || '}'"


@query("distinct_stacks", f"""
    WITH ids AS (SELECT stack_key, md5('[' || string_agg({_JSON}, ',' ORDER BY frame_idx) || ']') AS stacktrace_id, count(*) AS n_frames FROM fx_frames GROUP BY stack_key)
    SELECT stacktrace_id, any_value(n_frames) AS n_frames, count(*) AS n_events
    FROM fx_events e JOIN ids ON e.stack_key = ids.stack_key GROUP BY stacktrace_id""")
def _(t: Tables):
    inline = inputs.events(t).join(inputs.stacks(t), "stacktrace_id").select("event_id", "frames")
    return stack_ops.distinct_stacks(inline).select(
        "stacktrace_id", F.size("frames").cast("long").alias("n_frames"), "n_events")


@query("distinct_locations", f"""
    SELECT DISTINCT md5({_canonical(_FIELDS)}) AS location_id, {', '.join(_FIELDS)} FROM fx_frames""")
def _(t: Tables):
    return stack_ops.distinct_locations(inputs.stacks(t))


@query("distinct_functions", f"""
    WITH f AS (SELECT DISTINCT nullif(function_system_name, '') AS system_name, nullif(function_filename, '') AS filename,
                      line % 7 AS start_line FROM ox_locations WHERE has_line)
    SELECT system_name, filename, start_line,
           row_number() OVER (ORDER BY md5({_canonical(['system_name', 'filename', 'start_line'])})) - 1 AS function_id FROM f""")
def _(t: Tables):
    return stack_ops.distinct_functions(inputs.locations(t).withColumn("function_start_line", F.col("line") % 7))


@query("requested_stacktraces", """
    WITH ids AS (SELECT DISTINCT stack_key FROM fx_events WHERE origin = 'sampling'),
    st AS (SELECT stack_key, string_agg(function, ';' ORDER BY frame_idx) AS names FROM ox_names GROUP BY 1)
    SELECT ids.stack_key AS stacktrace_id, k.stack_key IS NULL AS is_missing,
           coalesce(st.names, CASE WHEN k.stack_key IS NULL THEN 'missing stacktrace' ELSE '' END) AS names
    FROM ids LEFT JOIN st ON ids.stack_key = st.stack_key LEFT JOIN fx_stacks k ON ids.stack_key = k.stack_key""")
def _(t: Tables):
    asked = inputs.cpu_samples(t).select("stacktrace_id")
    found = stack_ops.requested_stacktraces(asked, inputs.known_stacks(t))
    with_frames = found.withColumn("frames", F.when(
        F.col("is_missing"), stack_ops.missing_stack_frames()).otherwise(F.col("frames")))
    located = frame_ops.resolve_frames(frame_ops.join_frame_executable(
        frame_ops.explode_frames(with_frames, "stacktrace_id", "is_missing"), inputs.executables(t)))
    names = F.array_sort(F.collect_list(F.struct("frame_idx", profiles.location_name().alias("name"))))
    named = located.groupBy("stacktrace_id").agg(names.alias("n"))
    return found.select("stacktrace_id", "is_missing").join(named, "stacktrace_id", "left").select(
        "stacktrace_id", "is_missing", F.coalesce(F.array_join(F.transform("n", lambda x: x["name"]), ";"), F.lit("")).alias("names"))


@query("unknown_stacks", """
    SELECT DISTINCT stack_key AS stacktrace_id FROM fx_events
    WHERE stack_key NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')""")
def _(t: Tables):
    stored = t.table("orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("stacktrace_id"))
    return stack_ops.unknown_stacks(inputs.events(t), stored)


@query("new_stacktraces", """
    WITH s AS (SELECT ts_ns // 86400000000000 AS rotation, ts_ns // 5000000000 AS batch, stack_key FROM ox_samples)
    SELECT rotation, stack_key AS stacktrace_id, min(batch) AS first_batch FROM s
    WHERE (rotation, stack_key) NOT IN (SELECT ts_ns // 86400000000000, stack_key FROM fx_events WHERE origin = 'memory')
    GROUP BY 1, 2""")
def _(t: Tables):
    from stackloom.functions.values import floor_div
    day = floor_div(F.col("ts_ns"), 86_400_000_000_000)
    samples = inputs.samples(t).withColumn("rotation", day).withColumn("batch", floor_div(F.col("ts_ns"), 5_000_000_000))
    written = inputs.events(t).where("origin = 'memory'").withColumn("rotation", day)
    return stack_ops.new_stacktraces(samples, ["rotation"], "batch", written)


_BY_FUNCTION = """
    WITH v AS (SELECT stack_key, sum(value) AS value FROM ox_samples WHERE sample_type = 'samples' GROUP BY 1),
    j AS (SELECT v.stack_key, coalesce(n.function, 'missing stacktrace') AS function, coalesce(n.frame_idx, 1) AS frame_idx,
                 v.value FROM v LEFT JOIN ox_names n ON v.stack_key = n.stack_key
          WHERE n.function IS NOT NULL OR v.stack_key NOT IN (SELECT stack_key FROM fx_stacks)),
    c AS (SELECT function, sum(value) AS value FROM (SELECT DISTINCT stack_key, function, value FROM j) GROUP BY 1),
    s AS (SELECT function, sum(value) AS value FROM j WHERE frame_idx = 1 GROUP BY 1)
    SELECT c.function, coalesce(s.value, 0) AS self_value, c.value AS cumulative_value
    FROM c LEFT JOIN s ON c.function = s.function"""


@query("profile_by_function", _BY_FUNCTION)
def _(t: Tables):
    return profiles.profile_by_function(inputs.cpu_samples(t), inputs.locations(t), stacks=inputs.stack_table(t))


@query("topk_functions", _BY_FUNCTION + " ORDER BY 2 DESC, 3 DESC, 1 LIMIT 20")
def _(t: Tables):
    return profiles.profile_by_function(inputs.cpu_samples(t), inputs.locations(t), top=20, stacks=inputs.stack_table(t))


@query("profile_window", """
    SELECT time_bucket(INTERVAL 1 hour, make_timestamp(ts_ns // 1000)) AS window_start, stack_key AS stacktrace_id,
           sample_type, sum(value) AS value, count(*) AS n_samples FROM ox_samples GROUP BY 1, 2, 3""")
def _(t: Tables):
    return profiles.profile_window(inputs.samples(t).withColumn("ts", ns_to_ts(F.col("ts_ns"))))


@query("stack_fanout", """
    WITH f AS (SELECT stack_key, string_agg(function, ';' ORDER BY frame_idx DESC) AS folded FROM ox_names GROUP BY 1)
    SELECT coalesce(f.folded, CASE WHEN k.stack_key IS NULL THEN 'missing stacktrace' ELSE '' END) AS folded, sum(value) AS value
    FROM ox_samples s LEFT JOIN f ON s.stack_key = f.stack_key LEFT JOIN fx_stacks k ON s.stack_key = k.stack_key WHERE s.sample_type = 'wallclock' GROUP BY 1""")
def _(t: Tables):
    return profiles.stack_fanout(inputs.samples(t).where("sample_type = 'wallclock'"), inputs.locations(t), inputs.stack_table(t))


@query("profile_diff", """
    WITH v AS (SELECT stack_key, ts_ns >= 1705363200000000000 AS late, sum(value) AS value FROM ox_samples
               WHERE sample_type = 'samples' GROUP BY 1, 2),
    j AS (SELECT v.stack_key, late, coalesce(n.function, 'missing stacktrace') AS function, coalesce(n.frame_idx, 1) AS i, value
          FROM v LEFT JOIN ox_names n ON v.stack_key = n.stack_key
          WHERE n.function IS NOT NULL OR v.stack_key NOT IN (SELECT stack_key FROM fx_stacks)),
    d AS (SELECT function, stack_key, late, any_value(value) AS value, bool_or(i = 1) AS leaf FROM j GROUP BY 1, 2, 3),
    p AS (SELECT function, coalesce(sum(value) FILTER (NOT late AND leaf), 0) AS self_before,
                 coalesce(sum(value) FILTER (late AND leaf), 0) AS self_after,
                 coalesce(sum(value) FILTER (NOT late), 0) AS cumulative_before,
                 coalesce(sum(value) FILTER (late), 0) AS cumulative_after FROM d GROUP BY 1)
    SELECT *, self_after - self_before AS self_change, cumulative_after - cumulative_before AS cumulative_change FROM p""")
def _(t: Tables):
    cpu = inputs.cpu_samples(t)
    late = F.col("ts_ns") >= 1_705_363_200_000_000_000
    return profiles.profile_diff(cpu.where(~late), cpu.where(late), inputs.locations(t), inputs.stack_table(t))
