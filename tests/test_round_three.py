"""Early drop, record versions, late rows, cleared entries, counters, keyed state, labels over many observations."""

import random
import re

import pytest
from pyspark.sql import functions as F

from stackloom.functions.values import ns_to_ts
from stackloom.operators.gpu import gpu_unmatched
from stackloom.operators.metadata import label_samples, process_provider
from stackloom.operators.metrics import observe_counters, pipeline_counters
from stackloom.operators.records import record_version, samples_v1
from stackloom.operators.relabel import RelabelRule, drop_early, filter_kept, relabel, stored_predicate
from stackloom.plans.q_sources import _in_parts
from stackloom.schema import SAMPLE_COLUMNS
from stackloom.session import shared_dir
from stackloom.sources.tables import write_samples_v1, write_samples_v2, write_stacktraces_v1
from stackloom.streaming import counters, joins, report, state
from test_streaming import files, finish

SECOND, MINUTE = 10**9, 60 * 10**9

# ---- rules on stored columns ---------------------------------------------------------------------------------------------


def random_rules(rng):
    names = ["node", "job", "copy", "__meta_x"]
    rules = []
    for _ in range(rng.randrange(1, 6)):
        action = rng.choice(["keep", "drop", "drop", "replace", "replace", "lowercase", "labeldrop", "labelkeep", "labelmap", "dropequal"])
        regex = rng.choice(["a|b|n1", "n.*", "n1", "(a|c)", "[a-z]+", "", "b", "(.*)", "n1;b"])
        if action.startswith("label"):
            regex = rng.choice(["job|copy", "copy", "node|job|copy", "__meta_(.+)"])
        rules.append(RelabelRule(action, rng.sample(names, rng.randrange(1, 3)), regex=regex, target_label=rng.choice(["copy", "job", "other"]),
                                 replacement=rng.choice(["$1", "$1", "b"])))
    return rules


def test_early_drop_keeps_what_the_rules_keep(spark):
    rng = random.Random(5)
    values = ["a", "b", "c", "n1", "n2", "N1", "", None]
    rows = spark.createDataFrame([(i, rng.choice(values), rng.choice(values), rng.choice(values)) for i in range(150)], "id int, node string, job string, x string").persist()
    labels = F.map_filter(F.create_map(F.lit("node"), F.col("node"), F.lit("job"), F.col("job"), F.lit("__meta_x"), F.col("x")), lambda _, v: v.isNotNull() & (v != ""))
    reached = 0
    for _ in range(40):
        rules = random_rules(rng)
        kept = lambda df: sorted(r.id for r in filter_kept(relabel(df.withColumn("labels", labels), rules)).select("id").collect())
        early = drop_early(rows, rules, {"node": "node", "job": "job"})
        assert kept(early) == kept(rows), rules
        reached += stored_predicate(rules, {"node": "node", "job": "job"}) is not None
    assert reached > 10


@pytest.mark.parametrize("action,regex,pushed", [
    ("drop", "n1", "Or(Not(EqualTo(node,n1)),IsNull(node))"), ("keep", "n1", "EqualTo(node,n1)"), ("drop", "n1|n2", "Not(In(node"),
    ("keep", "(n1|n2)", "In(node"), ("drop", "n.*", "Not(StringStartsWith(node,n))")])
def test_early_drop_reaches_the_files(spark, action, regex, pushed):
    path = shared_dir(spark, "nodes")
    spark.createDataFrame([(f"n{i % 4}" if i % 5 else None, i) for i in range(40)], "node string, i int").write.parquet(path)
    rules = [RelabelRule(source_labels=["node"], target_label="copy"), RelabelRule(action, ["copy"], regex=regex)]
    plan = drop_early(spark.read.parquet(path), rules, {"node": "node"})._jdf.queryExecution().executedPlan().toString()
    assert pushed in re.search(r"PushedFilters: (\[.*)", plan).group(1)


def test_rules_that_may_change_a_label_end_the_tracking():
    rule = RelabelRule("drop", ["node"], regex="n1")
    for before in (RelabelRule("labelmap", regex="__meta_(.+)"), RelabelRule(source_labels=["x"], target_label="$1"),
                   RelabelRule("lowercase", ["node"], target_label="node"), RelabelRule(source_labels=["x"], target_label="node")):
        assert stored_predicate([before, rule], {"node": "node"}) is None
    assert stored_predicate([RelabelRule("labelkeep", regex="job")], {"node": "node"}) is None


# ---- record versions -----------------------------------------------------------------------------------------------------


def test_version_tag_is_read_back(spark):
    kinds = {"stacktrace_id": "binary", "ts_ns": "long", "value": "long", "period": "long", "duration": "long"}
    schema = "labels map<string,string>, " + ", ".join(f"{c} {kinds.get(c, 'string')}" for c in SAMPLE_COLUMNS)
    samples = spark.createDataFrame([({"a": "b"}, *[b"x" if c == "stacktrace_id" else 1 if c in kinds else "t" for c in SAMPLE_COLUMNS])], schema)
    stacks = spark.createDataFrame([], "stacktrace_id binary, is_complete boolean, locations array<struct<address:long,frame_type:string,mapping_file:string,"
                                   "mapping_build_id:string,lines:array<struct<line:long>>>>")
    paths = [shared_dir(spark, n) for n in ("v1", "stacks", "v2")]
    write_samples_v1(samples, paths[0])
    write_stacktraces_v1(stacks, paths[1])
    write_samples_v2(samples, stacks, paths[2])
    assert [record_version(spark.read.parquet(p)) for p in paths] == ["v1", "v1", "v2"]
    assert record_version(samples) is None and record_version(samples_v1(samples)) == "v1"


# ---- labels over many observations ---------------------------------------------------------------------------------------


@pytest.mark.parametrize("width", [3, 50, 10**6])
def test_labels_follow_the_observations(spark, width):
    rng = random.Random(9)
    seen = [(rng.randrange(60), "n", p, 1, f"c{rng.randrange(4)}", f"line {rng.randrange(3)}", "0::/") for p in (1, 1, 1, 2, 3) for _ in range(7)]
    seen += [seen[0], (seen[0][0], "n", seen[0][2], 1, "c9", "line 0", "0::/")]  # a repeated row, and another at the same time
    events = [(rng.randrange(90), "n", p, 10 * p, 0, "t", "sampling") for p in (1, 2, 3, 4) for _ in range(40)]
    rules = [RelabelRule("drop", ["comm"], regex="c3"), RelabelRule(source_labels=["__meta_process_cmdline"], target_label="line")]
    got = label_samples(
        spark.createDataFrame(events, "ts_ns long, node string, pid long, tid long, cpu int, comm string, origin string"),
        spark.createDataFrame(seen, "observed_ns long, node string, pid long, ppid long, comm string, cmdline string, cgroup_line string"),
        [process_provider], rules, ttl=8, width=width, cpu=False, thread_id=False, thread_name=False)
    want = []
    for t, _, pid, *_ in events:
        # of observations at one time the one whose facts come last as text: ppid, comm, cmdline
        best = max(((s[0], s[3:]) for s in seen if s[2] == pid and s[0] <= t), default=None)
        labels = {"node": "n"}
        if best is not None and t - best[0] <= 8:
            if best[1][1] == "c3":
                continue
            labels |= {"comm": best[1][1], "line": best[1][2]}
        want.append((t, pid, sorted(labels.items())))
    assert sorted((r.ts_ns, r.pid, sorted(r["labels"].items())) for r in got.collect()) == sorted(want)


# ---- streams -------------------------------------------------------------------------------------------------------------


def test_late_rows_after_a_restart_and_a_repeat(spark):
    path = shared_dir(spark, "late")
    flush = lambda: report.splitting_flush(report.parquet_flush(f"{path}/good"), report.parquet_flush(f"{path}/late"), 100, f"{path}/state")
    batches = [[1000, 950], [880, None, 905], [850], [2000, 1899, 1900]]
    for number, times in enumerate(batches):
        rows = spark.createDataFrame([(t,) for t in times], "ts_ns long")
        flush()(rows, number)  # each batch in a run of its own
        flush()(rows, number)  # and repeated
    at = lambda side: sorted((r.batch_id, r.ts_ns) for r in spark.read.schema("ts_ns long, batch_id int").parquet(f"{path}/{side}").collect() if r.ts_ns)
    assert at("good") == [(0, 950), (0, 1000), (1, 905), (3, 1900), (3, 2000)] and at("late") == [(1, 880), (2, 850), (3, 1899)]
    assert spark.read.schema("ts_ns long").parquet(f"{path}/good").where("ts_ns is null").count() == 1


def test_parts_of_a_stream_lose_nothing(spark):
    rows = spark.createDataFrame([(i, i % 7 if i % 5 else None) for i in range(100)], "id int, s int").select("id", F.timestamp_seconds("s").alias("ts"))
    for frame, count in ((rows, 100), (rows.limit(0), 0), (rows.where("ts is null"), 20), (rows.where("s is null or true").withColumn("ts", F.lit("2024-01-01").cast("timestamp")), 100)):
        path, sizes = shared_dir(spark, "parts"), []
        _in_parts(frame, path, lambda _: sizes.append(spark.read.schema("id int").parquet(path).count()))
        assert sizes[-1] == count and spark.read.schema("id int").parquet(path).distinct().count() == count and sizes == sorted(sizes)


def test_cleared_entries_are_counted(spark):
    base = 1_700_000_000 * SECOND
    launches = spark.createDataFrame([("n", 1, i, base + i * MINUTE) for i in range(40)], "node string, pid long, correlation_id long, ts_ns long")
    timings = spark.createDataFrame([("n", 1 + (i % 8 == 0), i % 40, base + (i % 40) * MINUTE + 5, "k", 3) for i in range(5, 60)],
                                    "node string, pid long, correlation_id long, at long, kernel_name string, duration_ns long")
    left, right = launches.withColumn("ts", ns_to_ts(F.col("ts_ns"))), timings.withColumn("ts", ns_to_ts(F.col("at")))
    end = lambda df: df.limit(1).withColumns({"node": F.lit("later"), "ts": ns_to_ts(F.lit(base + 300 * MINUTE))})
    cut = f"ts < timestamp_seconds({base // SECOND + 1200})"
    path = shared_dir(spark, "cleared")
    streams = [files(spark, [s.where(cut), s.where(f"not ({cut})"), end(s)]) for s in (left, right)]
    flush = joins.cleared_counts(report.parquet_flush(f"{path}/out"))
    query = joins.gpu_unmatched_stream(*streams).writeStream.foreachBatch(flush).option("checkpointLocation", f"{path}/cp").trigger(availableNow=True).start()
    finish(query)
    counts = spark.read.parquet(f"{path}/out")
    got = {r.side: r.n for r in counts.groupBy("side").agg(F.sum("cleared").alias("n")).collect()}
    assert got == {r.side: r.cleared for r in gpu_unmatched(launches, timings).collect()} and counts.select("batch_id").distinct().count() > 1


def test_counters_of_a_stream_as_a_table(spark):
    rows = spark.createDataFrame([(i, ["sampling", "cuda", "odd", None][i % 4], i % 5 > 0, i % 3) for i in range(60)],
                                 "ts_ns long, origin string, keep boolean, n_frames int")
    path = shared_dir(spark, "counted")
    listener = counters.CounterListener(spark, f"{path}/counters", "event_counters")
    spark.streams.addListener(listener)
    try:
        stream = observe_counters(files(spark, [rows.where("ts_ns < 25"), rows.where("ts_ns >= 25")]))
        query = finish(report.stream_report(stream, report.parquet_flush(f"{path}/out"), f"{path}/cp", None))
        listener.wait_for(query)
    finally:
        spark.streams.removeListener(listener)
    assert {r.counter: r.n for r in listener.totals().collect()} == {r.counter: r.n for r in pipeline_counters(rows).collect()}


CGROUP = "4:memory:/docker/" + "a" * 63


@pytest.mark.parametrize("cuts", [[0, 10**9], [0, 40, 90, 10**9]])
def test_container_lookups_have_a_lifetime(spark, cuts):
    rng = random.Random(21)
    times = {p: rng.sample(range(200), 40) for p in range(3)}
    rows = [("n", p, t * SECOND, rng.choice([None, CGROUP + "0", CGROUP + "1", "0::/init"])) for p, ts in times.items() for t in ts]
    want, held = [], {}
    for node, p, t, line in sorted(rows, key=lambda r: r[2]):
        if p in held and t - held[p][0] <= MINUTE:
            answer = "deferred" if held[p][1] is None else "cached"
        else:
            held[p] = (t, line)
            answer = "failed" if line is None else "looked_up"
        found = held[p][1]
        want.append((p, t, found[17:] if found and found.startswith("4") else None, answer))
    frame = spark.createDataFrame(rows, "node string, pid long, ts_ns long, cgroup_line string")
    show = lambda df: sorted((r.pid, r.ts_ns, r.container_id or None, r.answer) for r in df.collect())
    assert show(state.container_lookups(frame)) == sorted(want, key=lambda r: r[:2])
    path = shared_dir(spark, "lookups")
    stream = files(spark, [frame.where(f"ts_ns >= {a} * 1000000000L and ts_ns < {b} * 1000000000L") for a, b in zip(cuts, cuts[1:])])
    state.stop_when_idle(state.container_lookups_stream(stream).writeStream.option("checkpointLocation", f"{path}/cp").start(f"{path}/out", format="parquet"))
    assert show(spark.read.schema(state.LOOKUP).parquet(f"{path}/out")) == sorted(want, key=lambda r: r[:2])


@pytest.mark.parametrize("cuts", [[0, 10**6], [0, 4, 11, 26, 10**6]])
def test_refused_uploads_come_back(spark, cuts):
    events = [("f1", 1, "seen"), ("f1", 2, "seen"), ("f1", 3, "in_progress"), ("f1", 20, "uploaded"), ("f1", 30, "seen"),
              ("f2", 3, "seen"), ("f2", 4, "in_progress"), ("f2", 6, "uploaded"),                      # uploaded in time: no retry
              ("f3", 5, "in_progress"), ("f3", 8, "seen"), ("f3", 9, "in_progress"),                   # refused anew: waits anew
              ("f4", 25, "seen"), ("f4", 31, "final"), ("f4", 32, "in_progress"),                      # final stays final
              ("f5", 10, "in_progress"), ("f5", 15, "in_progress"), ("zz", 300, "final")]
    frame = spark.createDataFrame([(f, t * MINUTE, s) for f, t, s in events], "file_id string, ts_ns long, status string").withColumn("ts", ns_to_ts(F.col("ts_ns")))
    path = shared_dir(spark, "uploads")
    stream = files(spark, [frame.where(f"ts_ns >= {a * MINUTE} and ts_ns < {b * MINUTE}") for a, b in zip(cuts, cuts[1:])])
    finish(state.worklist_changes_stream(stream).writeStream.option("checkpointLocation", f"{path}/cp").trigger(availableNow=True).start(f"{path}/out", format="parquet"))
    got = sorted((r.file_id, r.ts_ns // MINUTE, r.action) for r in spark.read.schema(state.CHANGE).parquet(f"{path}/out").collect())
    assert got == [("f1", 1, "upload"), ("f1", 8, "retry"), ("f2", 3, "upload"), ("f3", 14, "retry"), ("f4", 25, "upload"), ("f5", 15, "retry"), ("f5", 20, "retry")]


def test_refused_uploads_by_the_clock(spark):
    frame = spark.createDataFrame([("f", 1, "seen"), ("f", 2, "in_progress")], "file_id string, ts_ns long, status string").withColumn("ts", ns_to_ts(F.col("ts_ns")))
    path = shared_dir(spark, "uploads")
    query = state.worklist_changes_stream(files(spark, [frame]), SECOND, by_clock=True).writeStream.option("checkpointLocation", f"{path}/cp").start(
        f"{path}/out", format="parquet")
    import time
    end = time.monotonic() + 60
    found = []
    while len(found) < 2 and time.monotonic() < end:
        time.sleep(0.3)
        found = spark.read.schema(state.CHANGE).parquet(f"{path}/out").collect() if query.recentProgress else []
    query.stop()
    assert sorted(r.action for r in found) == ["retry", "upload"]
