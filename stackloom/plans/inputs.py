"""Operator inputs built from the fixtures."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stackloom.operators.frames import join_frame_executable, resolve_frames, stack_locations
from stackloom.operators.probes import ProbeSpec, load_probe_specs
from stackloom.operators.samples import normalize_samples
from stackloom.operators.stacks import FRAME_FIELDS
from stackloom.plans.fixtures import Tables
from stackloom.schema import SAMPLING

PROBES_YAML = """
probes:
  - {id: gc, file_match: '(^|/)supplier#0+[0-9]*1/', entry_symbol: gc_start, exit_symbol: gc_end}
  - {id: loop, file_match: 'Supplier#0+[0-9]*[02468]$', entry_symbol: tick, exit_symbol: tock, main_thread_only: false}
  - id: io
    file_match: '5/bin$'
    entry_symbol: read_start
    exit_symbol: read_end
    main_thread_only: false
    min_duration_ms: 3600000
"""

RELABEL_YAML = """
relabel_configs:
- source_labels: [__meta_process_executable_name]
  target_label: exec
  action: replace
- source_labels: [__meta_process_executable_compiler]
  target_label: compiler
- source_labels: [comm]
  regex: furniture
  action: drop
- action: labelmap
  regex: __meta_process_(ppid|pid)
  replacement: proc_${1}
- source_labels: [node]
  regex: NODE_(\\d+)
  target_label: shard
  replacement: s${1}
- source_labels: [__meta_process_cmdline]
  target_label: part
  modulus: 8
  action: hashmod
- action: labeldrop
  regex: comm
"""

PROCESS_FIELDS = ["ppid", "comm", "cmdline", "exe_file_id"]


def probe_specs() -> list[ProbeSpec]:
    return load_probe_specs(PROBES_YAML)


def events(t: Tables) -> DataFrame:
    """Trace events with their stack by id."""
    mem = F.when(F.col("origin") == "memory", F.struct(
        F.col("allocs").cast("long").alias("allocs"), F.col("frees").cast("long").alias("frees"),
        F.col("alloc_bytes").cast("long").alias("alloc_bytes"), F.col("free_bytes").cast("long").alias("free_bytes")))
    return (t.fx("fx_events").withColumn("mem", mem).drop("allocs", "frees", "alloc_bytes", "free_bytes")
            .withColumnRenamed("stack_key", "stacktrace_id"))


def samples(t: Tables) -> DataFrame:
    return normalize_samples(events(t))


def frames(t: Tables) -> DataFrame:
    return t.fx("fx_frames").withColumnRenamed("stack_key", "stacktrace_id")


def executables(t: Tables) -> DataFrame:
    return t.fx("fx_executables")


def locations(t: Tables, schema_version: str = "v2") -> DataFrame:
    """Resolved frames of all stacks, keyed by stack and position."""
    return resolve_frames(join_frame_executable(frames(t), executables(t)), schema_version)


def stack_table(t: Tables) -> DataFrame:
    """The ids of all known stacks."""
    return t.fx("fx_stacks").withColumnRenamed("stack_key", "stacktrace_id")


def known_stacks(t: Tables) -> DataFrame:
    """All known stacks with their frames; some have none."""
    return stack_table(t).join(stacks(t), "stacktrace_id", "left")


def stacks(t: Tables) -> DataFrame:
    """Stacks with their frames inline, leaf first. A stack has at most as many frames as an order has lines."""
    rows = frames(t).groupBy("stacktrace_id").agg(F.array_sort(F.collect_list(F.struct("frame_idx", *FRAME_FIELDS))).alias("f"))
    return rows.select("stacktrace_id", F.transform("f", lambda x: F.struct(
        *[x[name].alias(name) for name in FRAME_FIELDS])).alias("frames"))


def stacks_resolved(t: Tables, schema_version: str = "v2") -> DataFrame:
    return stack_locations(locations(t, schema_version), "stacktrace_id", stacks=stack_table(t))


def cpu_samples(t: Tables) -> DataFrame:
    return normalize_samples(events(t).where(F.col("origin") == SAMPLING))


def processes(t: Tables) -> DataFrame:
    """Process observations, dealt out to the tasks: rules and parsers cost far more per row than reading one, and a table of many
    rows may lie in one row group. Spark joins small parts."""
    return t.fx("fx_processes").repartition("node", "pid", "observed_ns")


def edges(t: Tables) -> DataFrame:
    """Probe edges with the cookie their probe was attached with."""
    from stackloom.functions.values import probe_cookie

    return (t.fx("fx_edges").withColumn("cookie", probe_cookie(F.col("spec_id"), F.col("main_only"), F.col("min_ms")))
            .select("node", "pid", "tid", "comm", "ts_ns", "delta", "cookie"))
