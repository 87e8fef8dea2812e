"""Work that has to grow no faster than its input: state of streams, calls to the store, memory of a task, threads."""

from types import SimpleNamespace

from pyspark.sql import functions as F

from stackloom.functions.values import ns_to_ts
from stackloom.operators.stacks import distinct_stacks
from stackloom.plans import batch_files, fixtures, inputs
from stackloom.schema import SECOND_NS as SECOND
from stackloom.session import shared_dir
from stackloom.sources import batch_log
from stackloom.streaming import joins, report, state

MINUTE = 60 * SECOND
BASE = 1_700_000_000 * SECOND


def test_a_launch_with_its_timings_is_one_row_of_state(spark):
    path = shared_dir(spark, "unmatched")
    rows = lambda times: spark.createDataFrame([("n", 1, c, BASE + t * SECOND) for c, t in times], "node string, pid long, correlation_id long, ns long").select(
        "node", "pid", "correlation_id", ns_to_ts(F.col("ns")).alias("ts"))
    # 1: fifty timings; 2: partners exactly a minute apart; 3: a second too far; 4: a launch within reach of one of two timings
    launches = rows([(1, 0), (2, 0), (3, 0), (4, 50), (5, 0)])
    timings = rows([(1, i) for i in range(50)] + [(2, 60), (3, 61), (4, 0), (4, -40), (6, 0), (6, 1)])
    later = rows([(0, 86400)])
    for name, first in (("l", launches), ("t", timings)):
        first.write.parquet(f"{path}/{name}")
    read = lambda name: spark.readStream.schema(launches.schema).parquet(f"{path}/{name}")

    def run():
        query = joins.gpu_unmatched_stream(read("l"), read("t")).writeStream.foreachBatch(report.parquet_flush(f"{path}/out")).option(
            "checkpointLocation", f"{path}/cp").trigger(availableNow=True).start()
        query.awaitTermination()
        return query.recentProgress
    kept = max(s["numRowsTotal"] for p in run() for s in p["stateOperators"])
    assert kept <= 8
    for name in ("l", "t"):
        later.write.mode("append").parquet(f"{path}/{name}")
    run()
    got = sorted((r.side, r.correlation_id) for r in spark.read.parquet(f"{path}/out").collect())
    assert got == [("launch", 3), ("launch", 5), ("timing", 3), ("timing", 4), ("timing", 6), ("timing", 6)]


def test_a_process_is_one_call_to_the_store_per_batch():
    calls = []
    entry = SimpleNamespace(exists=lambda: calls.append("exists"), get=lambda: calls.append("get"), update=calls.append)
    processor = state._ContainerState(10, 1000)
    processor.entry = entry
    rows = [{"node": "n", "pid": 1, "ts_ns": t, "found": True, "container_id": "c", "container_env": 1} for t in range(0, 200, 20)]
    assert [r.answer for r in processor.handleInputRows(("n", 1), iter(rows), None)] == ["looked_up"] * 10
    assert calls == ["get", (180, True, "c", 1)]


def test_a_slow_trigger_is_waited_for(monkeypatch):
    clock, progress = [0.0], []

    def sleep(_):
        clock[0] += 100.0
        if clock[0] >= 500 and len(progress) < 2:  # the first trigger takes long, the next one finds nothing
            progress.append({"numInputRows": 0 if progress else 7})
    monkeypatch.setattr(state, "time", SimpleNamespace(monotonic=lambda: clock[0], sleep=sleep))
    seen = []
    query = SimpleNamespace(isActive=True, recentProgress=progress, exception=lambda: None, stop=lambda: seen.append([p["numInputRows"] for p in progress]))
    state.stop_when_idle(query)
    assert seen == [[7, 0]]


def small_tables(spark, path, orders=40, lines=5):
    spark.range(orders * lines).selectExpr(f"id div {lines} AS l_orderkey", "id % 3 AS l_partkey", "id % 2 AS l_suppkey", f"CAST(id % {lines} AS INT) AS l_linenumber", "2.0D AS l_quantity", "1.0D AS l_extendedprice",
                                           "timestamp'2024-01-01' AS l_shipdate").write.parquet(f"{path}/lineitem.parquet")
    spark.range(3).selectExpr("id AS p_partkey", "concat('name', id) AS p_name", "'brand' AS p_brand", "'type' AS p_type").write.parquet(f"{path}/part.parquet")
    spark.range(orders).selectExpr("id AS o_orderkey").write.parquet(f"{path}/orders.parquet")
    spark.range(2).selectExpr("id AS s_suppkey", "'s' AS s_name", "0 AS s_nationkey").write.parquet(f"{path}/supplier.parquet")
    spark.range(30).selectExpr("id AS event_id", "timestamp'2024-01-01' AS ts", "id % 2 AS user_id", "'view' AS event_type", "1.0D AS value", "'' AS props").write.parquet(
        f"{path}/events.parquet")
    return fixtures.Tables(spark, path)


def test_tasks_grow_with_the_frames(spark, monkeypatch):
    t = small_tables(spark, shared_dir(spark, "tables"))
    parts = lambda: t.fx("fx_frames").select("stack_key", "frame_idx", F.spark_partition_id().alias("p")).agg(F.count_distinct("p")).first()[0]
    found = lambda: sorted(distinct_stacks(inputs.events(t).join(inputs.stacks(t), "stacktrace_id").select("event_id", "frames")).select(
        "stacktrace_id", "n_events").collect())
    few, before = parts(), found()
    monkeypatch.setattr(fixtures, "ROWS_PER_TASK", 10)  # 200 line items
    assert few < parts() <= 20 and found() == before and before


def test_only_stacks_of_the_files_are_resolved(spark):
    t = small_tables(spark, shared_dir(spark, "tables"))
    rows = batch_files.records(t)
    assert {r.record: r["count"] for r in rows.groupBy("record").count().collect()} == {"samples": 30, "stacktraces": rows.where(
        "record = 'samples'").select("file", "stacktrace_id").distinct().count()}
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("LeftSemi") >= 2


def test_records_are_taken_apart_without_threads():
    assert not batch_log._SERIAL.use_threads
