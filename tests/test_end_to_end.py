"""From raw events with inline frames to self-contained records and a profile."""

from pyspark.sql import functions as F

from stackloom.operators import frames, metadata, profiles, samples, stacks
from stackloom.operators.relabel import load_relabel_rules
from stackloom.schema import FRAME, TRACE_EVENT
from stackloom.session import shared_dir
from stackloom.sources.tables import read_trace_events, write_samples_v1, write_samples_v2, write_stacktraces_v1

RULES = """
relabel_configs:
- {source_labels: [__meta_process_executable_name], target_label: exec}
- {source_labels: [__meta_env_var_APP], target_label: app}
- {source_labels: [exec], regex: secret, action: drop}
- {source_labels: [thread_name], regex: worker, target_label: kind, replacement: pool}
"""


def frame(**values):
    return tuple(values.get(f.name) for f in FRAME.fields)


def event(**values):
    return tuple(values.get(f.name) for f in TRACE_EVENT.fields)


def test_events_to_records(spark):
    leaf = [frame(frame_type="native", address=1, file_id="f1"), frame(frame_type="python", function_name="main", source_file="m.py")]
    deep = [frame(frame_type="python", function_name="f", source_file="m.py"), *leaf[1:]]
    rows = [
        event(ts_ns=20, node="n", pid=1, tid=1, cpu=0, comm="worker", origin="sampling", raw_value=9, frames=leaf,
              custom_labels={b"user": b"u1", b"exec": b"mine"}),
        event(ts_ns=21, node="n", pid=1, tid=2, cpu=1, comm="main", origin="sampling", raw_value=9, frames=deep),
        event(ts_ns=22, node="n", pid=1, tid=2, cpu=1, comm="main", origin="sampling", raw_value=9, frames=deep),
        event(ts_ns=23, node="n", pid=2, tid=3, cpu=1, comm="x", origin="sampling", raw_value=9, frames=leaf),
        event(ts_ns=24, node="n", pid=1, tid=1, cpu=1, comm="worker", origin="probe", raw_value=9, frames=[]),
        event(ts_ns=25, node="n", pid=9, tid=9, cpu=1, comm="", origin="off_cpu", raw_value=5, frames=[]),
    ]
    path = shared_dir(spark, "events")
    spark.createDataFrame(rows, TRACE_EVENT).write.parquet(path)
    events = read_trace_events(spark, path)
    execs = spark.createDataFrame(
        [("f1", "app", "b1", "go", True, False), ("f2", "secret", "", "gcc", False, False)],
        "file_id string, file_name string, build_id string, compiler string, is_static boolean, stripped boolean")
    processes = spark.createDataFrame(
        [("n", 1, 10, 0, "c", "/bin/c", "0::/", "f1", {"APP": "shop", "KEY": "k"}), ("n", 2, 10, 0, "d", "/bin/d", "0::/", "f2", {})],
        "node string, pid long, observed_ns long, ppid long, comm string, cmdline string, cgroup_line string, "
        "exe_file_id string, env map<string,string>")
    rules = load_relabel_rules(RULES)
    labelled = metadata.label_samples(
        stacks.with_stack_id(events), processes, [metadata.process_provider, metadata.executable_provider(execs)], rules,
        env_include=["APP"])
    labels = {r.ts_ns: r["labels"] for r in labelled.collect()}
    base = {"node": "n", "comm": "c", "exec": "app", "app": "shop"}
    assert labels == {
        20: {**base, "cpu": "0", "thread_id": "1", "thread_name": "worker", "user": "u1", "exec": "mine"},
        21: {**base, "cpu": "1", "thread_id": "2", "thread_name": "main"},
        22: {**base, "cpu": "1", "thread_id": "2", "thread_name": "main"},
        # a probe row meets the rules again when temporary labels are gone: rules that read them now clear their target
        24: {"node": "n", "comm": "c", "cpu": "1", "thread_id": "1", "thread_name": "worker", "kind": "pool"},
        25: {"node": "n", "cpu": "1", "thread_id": "9"}}

    rows = samples.normalize_samples(labelled)
    assert sorted((r.ts_ns, r.value) for r in rows.collect()) == [(20, 1), (21, 1), (22, 1), (25, 5)]
    located = frames.resolve_frames(frames.join_frame_executable(
        frames.explode_frames(stacks.distinct_stacks(events), "stacktrace_id"), execs))
    by_stack = frames.stack_locations(located, "stacktrace_id")
    out = shared_dir(spark, "v2")
    write_samples_v2(rows, by_stack, out)
    got = {r.ts_ns: r for r in spark.read.parquet(out).collect()}
    assert [x.mapping_file for x in got[20].stacktrace] == ["app", None]
    assert got[21].stacktrace[0].lines[0].function_system_name == "f" and got[25].stacktrace is None
    write_samples_v1(rows, out + "-s1")
    write_stacktraces_v1(by_stack, out + "-t1")
    v1 = spark.read.parquet(out + "-s1")
    assert "labels.user" in v1.columns and v1.where("`labels.user` IS NOT NULL").count() == 1
    assert spark.read.parquet(out + "-t1").count() == 2

    profile = profiles.profile_by_function(rows.where(F.col("sample_type") == "samples"), located)
    assert {r.function: (r.self_value, r.cumulative_value) for r in profile.collect()} == {
        "app": (1, 1), "main": (0, 3), "f": (2, 2)}
