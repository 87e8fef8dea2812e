"""Origins, frames, stacks and records on small inputs."""

import pytest
from pyspark.sql import functions as F

from stackloom.operators import fleet, metadata, metrics, records, samples
from stackloom.operators.frames import explode_frames, join_frame_executable, resolve_frames, stack_locations
from stackloom.operators.stacks import (
    dense_ids, distinct_functions, distinct_locations, distinct_stacks, missing_stack_frames, requested_stacktraces,
)
from stackloom.schema import FRAME, TRACE_EVENT


def event(**values):
    return tuple(values.get(f.name) for f in TRACE_EVENT.fields)


def frame(**values):
    return tuple(values.get(f.name) for f in FRAME.fields)


def events(spark, *rows):
    return spark.createDataFrame(list(rows), TRACE_EVENT)


def test_origins(spark):
    rows = events(spark, event(origin="sampling", raw_value=7, ts_ns=1234567890), event(origin="off_cpu", raw_value=7),
                  event(origin="cuda", raw_value=7), event(origin="gpu_pc", raw_value=7), event(origin="probe", raw_value=7),
                  event(origin="memory", raw_value=7))
    got = {r["sample_type"]: r for r in samples.normalize_samples(rows).collect()}
    assert set(got) == {"samples", "wallclock", "gpu_kernel_time", "gpu_pcsample"}
    cpu = got["samples"]
    assert (cpu.value, cpu.sample_unit, cpu.period_type, cpu.period_unit, cpu.temporality, cpu.period, cpu.duration, cpu.ts_ns) \
        == (1, "count", "cpu", "nanoseconds", "delta", 10**9 // 19, 10**9, 1234567890)
    assert (got["wallclock"].value, got["wallclock"].period) == (7, 0)
    assert (got["gpu_pcsample"].period, got["gpu_kernel_time"].period) == (0, 1)
    v1 = samples.normalize_samples(rows.where("origin = 'off_cpu'"), schema_version="v1").first()
    assert v1.period == 10**9 // 19


def test_memory_wraps_and_skips(spark):
    rows = events(spark, event(origin="memory", mem=(5, 5, 10, 4)), event(origin="memory", mem=(2**63 - 1, -1, 1, 1)))
    got = sorted((r.sample_type, r.value) for r in samples.memory_samples(rows).collect())
    assert got == [("inuse_objects", -(2**63)), ("inuse_space", 6)]
    assert samples.memory_samples(rows, report_allocs=True).count() == 6
    one = samples.memory_samples(rows).first()
    assert (one.period, one.duration, one.producer, one.temporality) == (524288, 0, "memory", None)


def test_gpu_modes(spark):
    rows = events(spark, event(origin="gpu_pc", raw_value=3), event(origin="cuda", raw_value=9)).withColumn(
        "labels", F.create_map(F.lit("a"), F.lit("b"))).withColumn("ns_per_sample", F.lit(10))
    merged = {r["labels"]["gpu_view"]: r for r in samples.gpu_samples(rows, merge=True).collect()}
    assert (merged["pc_sample"].value, merged["kernel_time"].value) == (30, 9)
    unknown = samples.gpu_samples(rows.withColumn("ns_per_sample", F.lit(None).cast("long")), merge=True)
    assert sorted(r.value for r in unknown.collect()) == [3, 9]
    split = {r.sample_type: r.period for r in samples.gpu_samples(rows).collect()}
    assert split == {"gpu_pcsample": 10, "gpu_kernel_time": 1}


EXECS = [("f1", "libc.so", "bid"), ("f2", "app", "")]
FRAMES = [
    frame(frame_type="abort", address=1), frame(frame_type="native", address=2, file_id="f1"),
    frame(frame_type="native", address=3, file_id="f2"), frame(frame_type="native", address=4, file_id="f9"),
    frame(frame_type="kernel", address=5, function_name="do_syscall_64", source_line=100, source_column=3),
    frame(frame_type="kernel", address=6, file_id="f1", source_line=8),
    frame(frame_type="cuda-pc", address=7, file_id="f3", mapping_file_name="cubin", function_name="_Zk"),
    frame(frame_type="oomprof", address=8, function_name="bid2", source_file="/bin/x"),
    frame(frame_type="python", address=9, function_name="f", source_file="", source_line=4, source_column=2, gnu_build_id="g"),
    frame(frame_type="ruby", address=10, source_line=4, source_column=2, source_file="a.rb", gnu_build_id=""),
]


def located(spark, version):
    stacks = spark.createDataFrame([("s", FRAMES)], f"stacktrace_id string, frames array<{FRAME.simpleString()}>")
    execs = spark.createDataFrame(EXECS, "file_id string, file_name string, build_id string")
    return resolve_frames(join_frame_executable(explode_frames(stacks, "stacktrace_id"), execs), version)


def test_frame_table_v2(spark):
    got = {r.address: r for r in located(spark, "v2").collect()}

    def row(n):
        r = got[n]
        return (r.mapping_file, r.mapping_build_id, r.has_line, r.function_system_name, r.function_filename, r.line,
                r.column, r.frame_complete)
    assert row(1) == ("agent-internal-error-frame", None, True, "aborted", None, 0, 0, True)
    assert row(2) == ("libc.so", "bid", False, None, None, None, None, True)
    assert row(3) == ("app", "f2", False, None, None, None, None, True)
    assert row(4) == ("UNKNOWN", None, False, None, None, None, None, False)
    assert row(5) == ("[kernel.kallsyms]", None, True, "do_syscall_64", "vmlinux", 100, 0, True)
    assert row(6) == ("[kernel.kallsyms]", None, True, "UNKNOWN", "libc.so", 0, 0, False)
    assert row(7) == ("cubin", "f3", True, "_Zk", None, 0, 0, True)
    assert row(8) == ("/bin/x", "bid2", False, None, None, None, None, False)
    assert got[8].frame_type == "native"
    assert row(9) == (None, "g", True, "f", "UNKNOWN", 4, 2, True)
    assert row(10) == (None, None, True, "UNREPORTED", "UNREPORTED", 0, 2, False)


def test_frame_table_v1(spark):
    got = {r.address: r for r in located(spark, "v1").collect()}
    assert (got[5].function_name, got[5].function_system_name, got[5].column) == ("do_syscall_64", "", 3)
    assert (got[7].function_name, got[7].function_system_name) == (None, "_Zk")
    assert (got[1].function_name, got[9].function_name) == ("aborted", "f")


def test_stack_keeps_order_and_null_lines(spark):
    stack = stack_locations(located(spark, "v2"), "stacktrace_id").first()
    assert [x.address for x in stack.locations] == list(range(1, 11))
    assert stack.locations[1].lines is None and stack.locations[4].lines[0].line == 100
    assert stack.is_complete is False


def test_missing_stack(spark):
    known = spark.createDataFrame([("a", FRAMES[:1])], f"stacktrace_id string, frames array<{FRAME.simpleString()}>")
    asked = spark.createDataFrame([("a",), ("b",), ("b",)], "stacktrace_id string")
    found = requested_stacktraces(asked, known).withColumn(
        "frames", F.when(F.col("is_missing"), missing_stack_frames()).otherwise(F.col("frames")))
    execs = spark.createDataFrame(EXECS, "file_id string, file_name string, build_id string")
    rows = resolve_frames(join_frame_executable(explode_frames(found, "stacktrace_id"), execs), "v1").collect()
    lost = next(r for r in rows if r.stacktrace_id == "b")
    assert len(rows) == 2
    assert (lost.function_name, lost.frame_type, lost.address, lost.mapping_file, lost.frame_complete) == (
        "missing stacktrace", "unknown", 0, None, False)


def test_stack_and_function_dedup(spark):
    two = [frame(frame_type="native", address=0x1000), frame(frame_type="native", address=0x2000)]
    one = [frame(frame_type="native", address=0x3000)]
    rows = events(spark, *[event(frames=two)] * 3, event(frames=one))
    assert sorted(r.n_events for r in distinct_stacks(rows).collect()) == [1, 3]
    kernel = [frame(frame_type="kernel", address=a, function_name=n, source_line=line)
              for a, n, line in ((0x1000, "do_syscall_64", 100), (0x2000, "do_syscall_64", 200), (0x3000, "sys_read", 50))]
    stacks = distinct_stacks(events(spark, event(frames=kernel), event(frames=kernel[:1])))
    assert distinct_locations(stacks).count() == 3
    execs = spark.createDataFrame(EXECS, "file_id string, file_name string, build_id string")
    locations = resolve_frames(join_frame_executable(explode_frames(stacks, "stacktrace_id"), execs))
    functions = distinct_functions(locations).collect()
    assert sorted(r.function_id for r in functions) == [0, 1]


def test_dense_ids(spark):
    rows = spark.range(5000).select(F.col("id").cast("string").alias("k"))
    ids = [r["n"] for r in dense_ids(rows, ["k"], "n").collect()]
    assert sorted(ids) == list(range(5000))


def test_thread_labels_follow_rows(spark):
    cpus = [0, 1, 0, 3, 2, 1, 3, 0]
    rows = spark.createDataFrame([(4243, "p", c, {"node": "n"}) for c in cpus],
                                 "tid long, comm string, cpu int, labels map<string,string>")
    got = [r["labels"] for r in metadata.patch_thread_labels(rows).collect()]
    assert [g["cpu"] for g in got] == [str(c) for c in cpus]
    assert all(g["thread_id"] == "4243" and g["node"] == "n" for g in got)
    for off, name in (("cpu", "cpu"), ("thread_id", "thread_id"), ("thread_name", "thread_name")):
        less = metadata.patch_thread_labels(rows, **{off: False}).first()["labels"]
        assert name not in less and less["node"] == "n" and len(less) == 3


def test_oom_events(spark):
    profile = spark.createDataFrame(
        [(1, "n", 7, "c", "bid", "/bin/x", (1, 0, 8, 0), [16, 32])],
        "ts_ns long, node string, pid long, comm string, build_id string, executable_path string, "
        "mem struct<allocs:long,frees:long,alloc_bytes:long,free_bytes:long>, addresses array<long>")
    row = samples.oom_events(profile).first()
    assert row.tid == row.pid == 7
    assert [(f.address, f.function_name, f.source_file, f.frame_type) for f in row.frames] == [
        (16, "bid", "/bin/x", "oomprof"), (32, "bid", "/bin/x", "oomprof")]


def test_labels_wide_and_union(spark):
    a = spark.createDataFrame([(1, {"b": "x", "a": ""}), (2, {"c": "y"})], "id long, labels map<string,string>")
    wide = records.labels_wide(a)
    assert wide.columns == ["labels.a", "labels.b", "labels.c", "id"]
    assert [tuple(r) for r in wide.orderBy("id").collect()] == [(None, "x", None, 1), (None, None, "y", 2)]
    both = records.union_batches([records.labels_wide(a, ["a"]), records.labels_wide(a, ["c"])])
    assert both.count() == 4 and set(both.columns) == {"labels.a", "labels.c", "id"}


def test_external_labels_row_wins(spark):
    rows = spark.createDataFrame([({"a": "own"},), ({},)], "labels map<string,string>")
    got = [r["labels"] for r in metadata.external_labels(rows, {"a": "c", "b": "d"}).collect()]
    assert got == [{"a": "own", "b": "d"}, {"a": "c", "b": "d"}]


def test_log_records(spark):
    kind = "map<string,struct<int_value:bigint,bool_value:boolean,string_value:string>>"
    rows = spark.createDataFrame(
        [("warning", "m", {"n": (3, None, None), "s": (None, None, "t"), "f": (None, None, "1.5")}),
         ("info", "gone", {"otlp_skip": (None, True, None)}), ("info", "stays", {"otlp_skip": (None, False, None)})],
        f"level string, message string, fields {kind}")
    first, second = fleet.log_records(rows).collect()
    assert (first.body, first.severity, first.severity_text) == ("m", "warn", "WARNING")
    assert first.attributes["level"].string_value == "WARNING"
    assert first.attributes["n"].int_value == 3 and first.attributes["s"].string_value == "t"
    assert set(second.attributes) == {"level"}


def test_histogram_quantile(spark):
    inf = float("inf")
    rows = spark.createDataFrame(
        [("a", 1.0, 10), ("a", 2.0, 20), ("a", inf, 20), ("b", 1.0, 1), ("b", inf, 10), ("c", 1.0, 0), ("c", inf, 0)],
        "g string, le double, cumulative long")
    got = {r["g"]: r["quantile"] for r in metrics.histogram_quantile(rows, 0.75, ["g"]).collect()}
    assert got == {"a": 1.5, "b": 1.0}


def test_metrics_export_survives_a_broken_producer(spark):
    def broken():
        raise RuntimeError("down")
    good = spark.range(2).withColumnRenamed("id", "value")
    table = metrics.metrics_export({"a": lambda: good, "b": broken}, {"x": "y"})
    assert {(r["scope"], r["value"]) for r in table.collect()} == {("a", 0), ("a", 1)}
    assert metrics.metrics_export({"b": broken}, {"x": "y"}) is None


def test_metric_rollup(spark):
    defs = spark.createDataFrame([(1, "a.b", "gauge", ""), (2, "c.d", "counter", "")],
                                 "metric_id long, field string, metric_type string, unit string")
    points = spark.createDataFrame([(1, 1, 5), (1, 2, 3), (2, 1, 5), (2, 2, 3), (9, 1, 1)],
                                   "metric_id long, ts_ns long, value long")
    got = {r["metric"]: r["value"] for r in metrics.metric_points_rollup(points, defs, []).collect()}
    assert got == {"a_b": 3, "c_d": 8}
