"""Nothing is lost to a limit, an empty value or a key that repeats over machines."""

import pytest
from pyspark.sql import functions as F

from stackloom.operators import frames, gpu, metrics, profiles, records, samples, stacks
from stackloom.operators.probes import open_scopes, pair_probe_scopes
from stackloom.operators.sequence import HOUR_NS
from stackloom.session import qualified, shared_dir
from stackloom.sources import tables
from stackloom.streaming import joins, probes, report
from test_streaming import files, finish


def resolved(spark, version="v2"):
    rows = [("a", 1, "kernel", 16, "read_it", 7), ("a", 2, "native", 32, None, 0)]
    known = spark.createDataFrame([("a",), ("empty",)], "stacktrace_id string")
    raw = spark.createDataFrame(rows, "stacktrace_id string, frame_idx long, frame_type string, address long, function_name string, source_line long")
    none = spark.createDataFrame([], "file_id string, file_name string, build_id string")
    return known, frames.resolve_frames(frames.join_frame_executable(raw.withColumn("file_id", F.lit("f")), none), version)


@pytest.mark.parametrize("version,system,name", [("v1", "", "read_it"), ("v2", "read_it", None)])
def test_lines_keep_both_names_and_empty_stacks_stay(spark, version, system, name):
    known, located = resolved(spark, version)
    found = {r.stacktrace_id: r for r in frames.stack_locations(located, "stacktrace_id", stacks=known).collect()}
    line = found["a"].locations[0].lines[0]
    assert (line.function_system_name, line.function_name) == (system, name)
    assert found["empty"].is_complete and found["empty"].locations is None
    complete = {r.stacktrace_id: r.is_complete for r in frames.classify_unwind_completeness(located, "stacktrace_id", stacks=known).collect()}
    assert complete == {"a": False, "empty": True}


def test_profiles_tell_empty_from_lost(spark):
    known, located = resolved(spark)
    values = spark.createDataFrame([("a", 2), ("empty", 3), ("lost", 5)], "stacktrace_id string, value long")
    by_name = {r.function: r.self_value for r in profiles.profile_by_function(values, located, stacks=known).collect()}
    assert by_name == {"read_it": 2, "UNKNOWN": 0, "missing stacktrace": 5}
    folded = {r.folded: r.value for r in profiles.stack_fanout(values, located, known).collect()}
    assert folded == {"UNKNOWN;read_it": 2, "": 3, "missing stacktrace": 5}


def test_functions_differ_by_start_line(spark):
    rows = spark.createDataFrame([("f", "m.go", 10), ("f", "m.go", 20), ("f", "m.go", 10)],
                                 "function_system_name string, function_filename string, function_start_line long").withColumn("has_line", F.lit(True))
    assert sorted(r.start_line for r in stacks.distinct_functions(rows).collect()) == [10, 20]
    assert [r.start_line for r in stacks.distinct_functions(rows.drop("function_start_line")).collect()] == [0]


def test_gpu_keys_repeat_over_machines(spark):
    launches = spark.createDataFrame([("a", 7, 1), ("b", 7, 1)], "node string, pid long, correlation_id long")
    timings = spark.createDataFrame([("a", 7, 1, "ka", 1), ("b", 7, 1, "kb", 2)],
                                    "node string, pid long, correlation_id long, kernel_name string, duration_ns long")
    assert sorted((r.node, r.kernel_name) for r in gpu.gpu_kernel_times(launches, timings).collect()) == [("a", "ka"), ("b", "kb")]
    maps = spark.createDataFrame([("a", 7, 0, [f"s{i}" for i in range(100)]), ("b", 7, 0, ["other"])], "node string, pid long, ts_ns long, names array<string>")
    names = {(r.node, r.stall_index): r.stall_reason for r in gpu.stall_reason_names(maps).collect()}
    assert len(names) == 101 and names["a", 99] == "s99" and names["b", 0] == "other"


def test_many_label_names(spark):
    rows = spark.range(1).select(F.transform(F.sequence(F.lit(1), F.lit(10_100)), lambda i: F.concat(F.lit("l"), i)).alias("k")).select(
        F.map_from_arrays("k", "k").alias("labels"))
    assert len(records.label_names(rows)) == 10_100


def test_memory_events_do_not_vanish(spark):
    rows = spark.createDataFrame([("memory", 1)], "origin string, raw_value long")
    with pytest.raises(Exception, match="mem column"):
        samples.normalize_samples(rows).collect()
    assert samples.normalize_samples(rows.where("origin = 'sampling'")).count() == 0


def test_long_scopes_in_batch_and_stream(spark):
    edges = spark.createDataFrame([(1, 1, "c", 0, 1, 1 << 32), (1, 1, "c", 50 * HOUR_NS, -1, 1 << 32)],
                                  "pid long, tid long, comm string, ts_ns long, delta int, cookie long").withColumn("node", F.lit("n"))
    path = shared_dir(spark, "long")
    pairing = probes.ScopePairing(["node", "tid"], f"{path}/state", report.parquet_flush(f"{path}/out"))
    stream = files(spark, [edges.where("ts_ns = 0"), edges.where("ts_ns > 0")])
    finish(pairing.start(stream, f"{path}/checkpoint", None))
    got = [r.duration_ns for r in spark.read.parquet(f"{path}/out").collect()]
    assert got == [r.duration_ns for r in pair_probe_scopes(edges, ["node", "tid"]).collect()] == [50 * HOUR_NS]
    assert open_scopes(edges, ["node", "tid"]).count() == 0


def test_late_rows_of_a_stream(spark):
    rows = spark.createDataFrame([(i,) for i in (100, 200, 1000, 120, 990)], "ts_ns long")
    path = shared_dir(spark, "late")
    flush = report.splitting_flush(report.parquet_flush(f"{path}/out"), report.parquet_flush(f"{path}/late"), 500)
    finish(report.stream_report(files(spark, [rows.where("ts_ns IN (100, 200)"), rows.where("ts_ns = 1000"), rows.where("ts_ns IN (120, 990)")]),
                                flush, f"{path}/checkpoint", None))
    assert sorted(r.ts_ns for r in spark.read.parquet(f"{path}/out").collect()) == [100, 200, 990, 1000]
    assert [r.ts_ns for r in spark.read.parquet(f"{path}/late").collect()] == [120]


def test_process_table_is_read_per_batch(spark):
    table, path = shared_dir(spark, "processes"), shared_dir(spark, "labelled")
    seen = []

    def add(at):
        spark.createDataFrame([(at, 1)], "observed_ns long, pid long").write.mode("append").parquet(table)

    def label(batch, processes):
        seen.append(sorted(r.observed_ns for r in processes.collect()))
        add(150)
        return batch
    add(90)
    stream = files(spark, [spark.createDataFrame([(t,)], "ts_ns long") for t in (100, 200)])
    flush = joins.labelled_flush(label, lambda: spark.read.parquet(table), report.parquet_flush(path), ttl_ns=120)
    finish(report.stream_report(stream, flush, path + "-cp", None))
    assert seen == [[90], [90, 150]]


def test_short_watermarks_are_refused(spark):
    stream = files(spark, [spark.createDataFrame([(1, 1)], "ts_ns long, stacktrace_id long")]).withColumn("ts", F.timestamp_micros("ts_ns"))
    with pytest.raises(ValueError, match="shorter"):
        report.new_stacks_stream(stream, 3600 * 10**9, "10 minutes")
    assert report.new_stacks_stream(stream, 3600 * 10**9).isStreaming


def test_failing_producers_leave_the_others(spark):
    good = lambda: spark.createDataFrame([(1,)], "n int")
    bad = lambda: good().select(F.raise_error(F.lit("gone")).alias("n"))
    table = metrics.metrics_export({"bad": bad, "good": good}, {"r": "x"})
    assert [(r.scope, r.n) for r in table.collect()] == [("good", 1)]
    assert metrics.metrics_export({"bad": bad}, {"r": "x"}) is None


def test_hour_folders(spark):
    rows = spark.createDataFrame([(i * HOUR_NS, "a", i) for i in range(4)], "ts_ns long, sample_type string, stacktrace_id long").withColumn(
        "labels", F.create_map(F.lit("node"), F.lit("n")))
    for column in records.SAMPLE_COLUMNS:
        rows = rows if column in rows.columns else rows.withColumn(column, F.lit(1))
    path = shared_dir(spark, "hours")
    tables.write_samples_v1(rows, path, by_hour=True)
    back = spark.read.parquet(path)
    assert back.where("hour = 2").count() == 1 and back.count() == 4
    assert qualified(spark, path).startswith("file://")


def test_stall_maps_join_whole(spark):
    """A process's names travel as one row, are not broadcast, and are taken out by index; odd indexes and keys find none."""
    pc = spark.createDataFrame([("a", 1, 7, 0, 5), ("a", 1, 7, 1, 6), ("a", 1, 8, 2, 7), ("b", 1, 7, -1, 8), (None, 1, 7, 0, 9), ("a", 1, None, None, 1)],
                               "node string, pid long, cubin_crc long, stall_index int, n long")
    cubins = spark.createDataFrame([(7, "f", 70, 0)], "cubin_crc long, file_id string, sm_version int, ts_ns long")
    maps = spark.createDataFrame([("a", 1, 1, ["old"]), ("a", 1, 2, ["x\0junk", "y"]), ("b", 1, 1, ["z"]), (None, 1, 1, ["w"])],
                                 "node string, pid long, ts_ns long, names array<string>")
    symbols = gpu.gpu_pc_symbols(pc, cubins, maps)
    plan = symbols._jdf.queryExecution().sparkPlan().toString()
    assert "posexplode" not in plan and "SortMergeJoin [node" in plan
    assert {r["n"]: (r["cubin_file_id"], r["stall_reason"]) for r in symbols.collect()} == {
        5: ("f", "x"), 6: ("f", "y"), 7: (None, None), 8: ("f", None), 9: ("f", None), 1: (None, None)}
