"""Streams in several batches give what one batch gives."""

import random

from pyspark.sql import functions as F

from stackloom.functions.values import ns_to_ts
from stackloom.operators.gpu import gpu_kernel_times
from stackloom.operators.metadata import join_process_metadata
from stackloom.operators.samples import normalize_samples
from stackloom.operators.stacks import new_stacktraces
from stackloom.session import shared_dir
from stackloom.streaming import joins, probes, report
from test_sequence import SPECS, edge_frame, edge_rows, scope_model


def files(spark, frames):
    """A folder with one file per frame, as a stream that takes one file per batch."""
    path = shared_dir(spark, "in")
    for frame in frames:
        frame.coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(frames[0].schema).option("maxFilesPerTrigger", 1).parquet(path)


def finish(query):
    query.awaitTermination()
    return query


def test_report_skips_nothing_and_repeats_safely(spark):
    rows = spark.createDataFrame([(i, "sampling" if i % 2 else "off_cpu", i) for i in range(100)],
                                 "ts_ns long, origin string, raw_value long")
    stream = files(spark, [rows.where(F.col("ts_ns") % 3 == k) for k in range(3)])
    path = shared_dir(spark, "out")
    flush = report.parquet_flush(path)

    def twice(batch, batch_id):  # a retried batch
        flush(batch, batch_id)
        flush(batch, batch_id)
    finish(report.stream_report(normalize_samples(stream), twice, path + "-cp", None))
    got = spark.read.parquet(path)
    assert got.select("batch_id").distinct().count() == 3
    assert got.drop("batch_id").exceptAll(normalize_samples(rows)).count() == 0 and got.count() == 100


def test_empty_batches_are_skipped(spark):
    rows = spark.createDataFrame([(1, "nothing", 1)], "ts_ns long, origin string, raw_value long")
    seen = []
    finish(report.stream_report(normalize_samples(files(spark, [rows, rows])), lambda b, i: seen.append(i),
                                shared_dir(spark, "cp"), None))
    assert seen == []


def test_scopes_over_batches(spark):
    rows = edge_rows(300, 11)
    cuts = [0, 900 * 10**6, 1_800 * 10**6, 10**12]
    frames = [edge_frame(spark, [r for r in rows if a <= r[2] < b]) for a, b in zip(cuts, cuts[1:], strict=False)]
    path = shared_dir(spark, "scopes")
    pairing = probes.ScopePairing(["tid"], path + "/state", report.parquet_flush(path + "/out"), 10**8, 10**15)
    finish(pairing.start(files(spark, frames), path + "/cp", None))
    got = spark.read.parquet(path + "/out").collect()
    want, _ = scope_model(rows, SPECS)
    assert sorted((r.tid, r.spec_id, r.end_ns, r.duration_ns) for r in got) == want


def test_new_stacks_over_batches(spark):
    rng = random.Random(12)
    minute = 60 * 10**9
    rows = spark.createDataFrame([(i * minute // 4, f"s{rng.randrange(5)}") for i in range(400)], "ts_ns long, stacktrace_id string")
    rows = rows.withColumn("ts", ns_to_ts(F.col("ts_ns")))
    stream = files(spark, [rows.where(F.col("ts_ns") < 30 * minute), rows.where(F.col("ts_ns") >= 30 * minute)])
    path = shared_dir(spark, "stacks")
    (report.new_stacks_stream(stream).writeStream.option("checkpointLocation", path + "/cp").trigger(availableNow=True)
     .start(path + "/out", format="parquet").awaitTermination())
    batch = new_stacktraces(rows.withColumn("rotation", ns_to_ts(F.expr("ts_ns - ts_ns % 600000000000"))), ["rotation"], "ts_ns")
    got = spark.read.parquet(path + "/out").select("rotation", "stacktrace_id")
    assert got.exceptAll(batch.select("rotation", "stacktrace_id")).count() == 0 and got.count() == batch.count()


def test_gpu_over_batches(spark):
    base = 1_700_000_000 * 10**9  # not the epoch itself, which is where a watermark starts
    launches = spark.createDataFrame([(1, i, base + i * 10**9) for i in range(50)], "pid long, correlation_id long, ts_ns long").withColumn("node", F.lit("n"))
    timings = spark.createDataFrame([(1, i % 40, f"k{i}", i, base + (i % 40) * 10**9 + 5) for i in range(90)],
                                    "pid long, correlation_id long, kernel_name string, duration_ns long, at long").withColumn("node", F.lit("n"))
    launches, timings = launches.withColumn("ts", ns_to_ts(F.col("ts_ns"))), timings.withColumn("ts", ns_to_ts(F.col("at"))).drop("at")
    left = files(spark, [launches.where("correlation_id >= 20"), launches.where("correlation_id < 20")])
    right = files(spark, [timings.where("correlation_id < 30"), timings.where("correlation_id >= 30")])
    path = shared_dir(spark, "gpu")
    (joins.gpu_kernel_times_stream(left, right).writeStream.option("checkpointLocation", path + "/cp")
     .trigger(availableNow=True).start(path + "/out", format="parquet").awaitTermination())
    got = spark.read.parquet(path + "/out").select("pid", "correlation_id", "kernel_name", "raw_value")
    want = gpu_kernel_times(launches, timings.drop("ts")).select("pid", "correlation_id", "kernel_name", "raw_value")
    assert got.exceptAll(want).count() == 0 and got.count() == want.count() == 90


def test_labels_over_batches(spark):
    facts = spark.createDataFrame([(10, "n", 1, "old"), (50, "n", 1, "new")], "observed_ns long, node string, pid long, fact string")
    events = spark.createDataFrame([(t, "n", 1) for t in (5, 12, 40, 55, 90)], "ts_ns long, node string, pid long")

    def label(batch, processes):
        return join_process_metadata(batch, processes, ["fact"], 20, 7)
    path = shared_dir(spark, "labelled")
    stream = files(spark, [events.where("ts_ns < 45"), events.where("ts_ns >= 45")])
    finish(report.stream_report(stream, joins.labelled_flush(label, lambda: facts, report.parquet_flush(path)), path + "-cp", None))
    got = {r.ts_ns: r.fact for r in spark.read.parquet(path).collect()}
    assert got == {5: None, 12: "old", 40: None, 55: "new", 90: None}


def test_late_rows_go_aside(spark):
    rows = spark.createDataFrame([(100,), (900,)], "ts_ns long")
    good, late = report.late_rows(rows, 1000, 500)
    assert [r.ts_ns for r in good.collect()] == [900] and [r.ts_ns for r in late.collect()] == [100]


def test_counters_of_a_stream(spark):
    from stackloom.operators.metrics import observe_counters
    rows = spark.createDataFrame([(i, ["sampling", "cuda", "odd"][i % 3], i % 5 > 0) for i in range(30)],
                                 "ts_ns long, origin string, keep boolean")
    stream = observe_counters(files(spark, [rows]))
    query = finish(report.stream_report(stream, report.parquet_flush(shared_dir(spark, "seen")), shared_dir(spark, "cp"), None))
    counted = query.lastProgress["observedMetrics"]["event_counters"]
    assert (counted["cpu"], counted["gpu"], counted["memory"], counted["skipped_by_relabeling"]) == (8, 8, 0, 6)
