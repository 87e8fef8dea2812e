"""Ordered operators against plain Python models, with hot keys and slices of many widths."""

import random

import pytest
from pyspark.sql import functions as F

from stackloom.functions.values import probe_cookie
from stackloom.operators import gpu, probes, sequence
from stackloom.operators.metadata import label_samples, process_provider
from stackloom.operators.relabel import RelabelRule

WIDTHS = [1, 7, 100, 10_000]


def skewed_times(n, seed):
    """Keys and unique times; key 0 holds a third of all rows."""
    rng = random.Random(seed)
    times = rng.sample(range(10 * n), n)
    return [(0 if rng.random() < 0.34 else rng.randrange(1, 20), t) for t in times]


@pytest.mark.parametrize("width", WIDTHS)
@pytest.mark.parametrize("ttl", [None, 0, 40])
def test_asof_join(spark, width, ttl):
    facts = skewed_times(300, 1)
    dims = [(k, t, f"v{i}") for i, (k, t) in enumerate(skewed_times(120, 2))] + [(50, 5, "unused")]
    got = sequence.asof_join(
        spark.createDataFrame(facts, "k int, t long"), spark.createDataFrame(dims, "k int, s long, v string"),
        ["k"], "t", "s", ["v", "s"], ttl, width).collect()

    def expected(k, t):
        best = max(((s, v) for key, s, v in dims if key == k and s <= t), default=(None, None))
        return best if best[0] is not None and (ttl is None or t - best[0] <= ttl) else (None, None)
    assert sorted((r.k, r.t, r.s, r.v) for r in got if r.s is not None) == sorted(
        (k, t, *expected(k, t)) for k, t in facts if expected(k, t)[0] is not None)
    assert len(got) == len(facts)


@pytest.mark.parametrize("width", WIDTHS)
def test_previous_values(spark, width):
    rows = [(k, t, t % 5) for k, t in skewed_times(300, 3)]
    frame = spark.createDataFrame(rows, "tid int, ts_ns long, cpu int")
    got = sequence.previous_values(frame, ["tid"], "ts_ns", {"cpu": "before", "ts_ns": "at"}, width).collect()
    want, last = [], {}
    for k, t, c in sorted(rows, key=lambda r: r[1]):
        want.append((k, t, *last.get(k, (None, None))))
        last[k] = (c, t)
    assert sorted(((r.tid, r.ts_ns, r.before, r["at"]) for r in got), key=str) == sorted(want, key=str)
    moved = sequence.thread_migrations(frame, ["tid"], width=width).count()
    assert moved == sum(1 for k, t, c, _ in want if c is not None and c != t % 5)


@pytest.mark.parametrize("width", WIDTHS)
def test_run_length_encode(spark, width):
    rng = random.Random(4)
    rows = [(k, t, rng.choice(["a", "a", "a", "b", None, None])) for k, t in skewed_times(400, 5)]
    got = sequence.run_length_encode(spark.createDataFrame(rows, "k int, t long, v string"), ["k"], "t", "v", width).collect()
    want = []
    for key in {k for k, _, _ in rows}:
        run = None
        for _, t, v in sorted((r for r in rows if r[0] == key), key=lambda r: r[1]):
            if run and run[3] == v:
                run[2], run[4] = t, run[4] + 1
            else:
                run = [key, t, t, v, 1]
                want.append(run)
    assert sorted(map(str, (list(r) for r in got))) == sorted(map(str, want))


@pytest.mark.parametrize("width", [1, 3, 100])
@pytest.mark.parametrize("tie", ["n", None])
def test_runs_and_steps_of_equal_times(spark, width, tie):
    rng = random.Random(40)
    rows = [(0 if rng.random() < 0.5 else 1, rng.randrange(12), rng.choice(["a", "b", None]), n, rng.randrange(3)) for n in range(120)]
    frame = spark.createDataFrame(rows + [(9, 5, "a", 500, 0), (9, 5, "b", 501, 1), (9, 6, "b", 502, 1)], "k int, t long, v string, n int, cpu int").repartition(5)
    runs, moves = [], []
    for key in (0, 1, 9):
        own = [tuple(r) for r in frame.where(f"k = {key}").collect()]
        run = None
        for _, t, v, _, _ in sorted(own, key=lambda r: (r[1], r[3] if tie else (r[2] is not None, r[2] or ""))):
            if run and run[3] == v:
                run[2], run[4] = t, run[4] + 1
            else:
                run = [key, t, t, v, 1]
                runs.append(run)
        steps = sorted(own, key=lambda r: (r[1], r[3] if tie else r[4]))
        moves += [(key, b[1], b[4], a[4]) for a, b in zip(steps, steps[1:]) if a[4] != b[4]]
    got = sequence.run_length_encode(frame, ["k"], "t", "v", width, tie)
    assert sorted(map(str, (list(r) for r in got.select("k", "run_start", "run_end", "v", "run_length").collect()))) == sorted(map(str, runs))
    assert sorted(map(tuple, sequence.thread_migrations(frame, ["k"], "t", width, tie).collect())) == sorted(moves)


@pytest.mark.parametrize("width", [1, 4, 100])
def test_asof_join_of_equal_times(spark, width):
    facts = spark.createDataFrame([("k", t) for t in range(10)], "k string, t long")
    dims = spark.createDataFrame([("k", 2, "b", 1), ("k", 2, "a", 9), ("k", 5, "c", 3), ("k", 5, "d", 2)], "k string, s long, v string, n int").repartition(4)
    by_tie = sequence.asof_join(facts, dims, ["k"], "t", "s", ["v"], None, width, "n").collect()
    by_value = sequence.asof_join(facts, dims, ["k"], "t", "s", ["v"], None, width).collect()
    assert {r.t: r.v for r in by_tie} == {t: None if t < 2 else "a" if t < 5 else "c" for t in range(10)}
    assert {r.t: r.v for r in by_value} == {t: None if t < 2 else "b" if t < 5 else "d" for t in range(10)}


def test_cpu_time_of_a_fleet(spark):
    from stackloom.operators.profiles import cpu_time_by_label
    rows = spark.createDataFrame([(2**62, 52_631_578, "samples", "cpu", {"node": "n"})] * 3, "value long, period long, sample_type string, period_type string, labels map<string,string>")
    assert int(cpu_time_by_label(rows, ["node"]).first().cpu_ns) == 3 * 2**62 * 52_631_578


def scope_model(edges, specs):
    """The sequential rule: depth per thread, outermost spans, probe and length limit of the exit."""
    state, spans = {}, []
    for tid, pid, t, delta, spec in sorted(edges, key=lambda e: e[2]):
        main_only, min_ms = specs[spec]
        if main_only and tid != pid:
            continue
        depth, start = state.get(tid, (0, None))
        if delta > 0:
            state[tid] = (depth + 1, t if depth == 0 else start)
        elif depth > 0:
            state[tid] = (depth - 1, start)
            if depth == 1 and (min_ms == 0 or t - start >= min_ms * 1_000_000):
                spans.append((tid, spec, t, t - start))
    return sorted(spans), {k: v for k, v in state.items() if v[0] > 0}


SPECS = {1: (False, 0), 2: (True, 0), 3: (False, 2)}


def edge_rows(n, seed):
    rng = random.Random(seed)
    return [(k, k - k % 2, t * 1_000_000, 1 if rng.random() < 0.55 else -1, rng.choice([1, 1, 2, 3]))
            for k, t in skewed_times(n, seed)]


def edge_frame(spark, rows):
    main = F.element_at(F.create_map(*[F.lit(x) for k, v in SPECS.items() for x in (k, v[0])]), F.col("spec"))
    ms = F.element_at(F.create_map(*[F.lit(x) for k, v in SPECS.items() for x in (k, v[1])]), F.col("spec"))
    return (spark.createDataFrame(rows, "tid int, pid int, ts_ns long, delta int, spec int").withColumn("comm", F.lit("c"))
            .withColumn("cookie", probe_cookie(F.col("spec"), main, ms)).drop("spec"))


@pytest.mark.parametrize("width", [1_000_000, 50_000_000, 10**12])
@pytest.mark.parametrize("seed", [6, 7])
def test_probe_scopes(spark, width, seed):
    rows = edge_rows(400, seed)
    edges = edge_frame(spark, rows)
    got = probes.pair_probe_scopes(edges, ["tid"], width).collect()
    want, still_open = scope_model(rows, SPECS)
    assert sorted((r.tid, r.spec_id, r.end_ns, r.duration_ns) for r in got) == want and want
    left = {r.tid: (r.depth, r.open_ns) for r in probes.open_scopes(edges, ["tid"], width).collect()}
    assert left == still_open
    # spans of one thread do not overlap
    for tid in {w[0] for w in want}:
        ends = sorted((w[2] - w[3], w[2]) for w in want if w[0] == tid)
        assert all(a[1] <= b[0] for a, b in zip(ends, ends[1:], strict=False))


@pytest.mark.parametrize("cut", [1_000, 2_000, 3_500])
def test_probe_scopes_go_on(spark, cut):
    rows = edge_rows(400, 8)
    early = [r for r in rows if r[2] < cut * 1_000_000]
    late = [r for r in rows if r[2] >= cut * 1_000_000]
    width = 10**9
    first, second = edge_frame(spark, early), edge_frame(spark, late)
    state = probes.open_scopes(first, ["tid"], width)
    both = probes.pair_probe_scopes(first, ["tid"], width).unionByName(
        probes.pair_probe_scopes(second, ["tid"], width, state))
    want, still_open = scope_model(rows, SPECS)
    assert sorted((r.tid, r.spec_id, r.end_ns, r.duration_ns) for r in both.collect()) == want
    left = probes.open_scopes(second, ["tid"], width, state).collect()
    assert {r.tid: (r.depth, r.open_ns) for r in left} == still_open


@pytest.mark.parametrize("width", [3, 1000])
def test_samples_in_span(spark, width):
    spans = [(1, 10, 20, 1, "a"), (1, 20, 30, 2, "b"), (1, 50, 50, 1, "a"), (2, 15, 90, 1, "a"),
             (1, 1, 20, 3, "c"), (1, 20, 20, 4, "d"), (1, 20, 91, 5, "e"), (2, 31, 31, 3, "c")]  # several touch one instant, some overlap
    samples = [(t, s) for t in (1, 2, 3) for s in (9, 10, 15, 20, 25, 30, 31, 50, 51, 90, 91)]
    got = probes.samples_in_span(
        spark.createDataFrame(samples, "tid int, ts_ns long"),
        spark.createDataFrame(spans, "tid int, start_ns long, end_ns long, spec_id int, probe_id string"), ["tid"], width)
    want = sorted((t, s, a, b) for t, s in samples for k, a, b, _, _ in spans if k == t and a <= s <= b)
    assert sorted((r.tid, r.ts_ns, r.span_start_ns, r.span_end_ns) for r in got.collect()) == want


def test_repeatable_sampling(spark):
    rows = spark.range(20_000).select("id", F.lit("off_cpu").alias("origin"), F.lit("n").alias("node"),
                                      (F.col("id") * 10**9).alias("ts_ns"))
    half = sequence.offcpu_sample(rows, 0.5, ["id"])
    assert half.count() == sequence.offcpu_sample(rows.repartition(7), 0.5, ["id"]).count()
    assert 9_500 < half.count() < 10_500
    assert sequence.offcpu_sample(rows, 1.0, ["id"]).count() == 20_000
    assert sequence.offcpu_sample(rows, 0.0, ["id"]).count() == 0
    assert sequence.probabilistic_gate(rows, 100).count() == 20_000
    assert sequence.probabilistic_gate(rows, 0).count() == 0
    for bad in (-1, 101):
        with pytest.raises(ValueError):
            sequence.probabilistic_gate(rows, bad)


def test_label_lifetime(spark):
    events = spark.createDataFrame(
        [(1, "n", 1, 10, 0, "c", "sampling"), (15, "n", 1, 10, 0, "c", "sampling"), (30, "n", 1, 10, 0, "c", "sampling"),
         (5, "n", 2, 20, 0, "c", "sampling")],
        "ts_ns long, node string, pid long, tid long, cpu int, comm string, origin string")
    seen = spark.createDataFrame([(10, "n", 1, 3, "x", "x y", "0::/a"), (2, "n", 2, 4, "drop", "d", "0::/")],
                                 "observed_ns long, node string, pid long, ppid long, comm string, cmdline string, cgroup_line string")
    rules = [RelabelRule("drop", ["comm"], regex="drop"), RelabelRule(source_labels=["__meta_process_ppid"], target_label="parent")]
    got = label_samples(events, seen, [process_provider], rules, ttl=10, width=7, cpu=False, thread_id=False, thread_name=False)
    assert sorted((r.ts_ns, r.pid, sorted(r["labels"].items())) for r in got.collect()) == [
        (1, 1, [("node", "n")]),                                            # not seen yet
        (15, 1, [("comm", "x"), ("node", "n"), ("parent", "3")]),
        (30, 1, [("node", "n")])]                                           # too old; process 2 is dropped


def test_gpu_joins(spark):
    launches = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, 1, "c")], "pid long, correlation_id long, what string").withColumn("node", F.lit("n"))
    timings = spark.createDataFrame([(1, 1, "k1", 10), (1, 1, "k2", 20), (2, 9, "k3", 5)],
                                    "pid long, correlation_id long, kernel_name string, duration_ns long").withColumn("node", F.lit("n"))
    got = gpu.gpu_kernel_times(launches, timings).collect()
    assert sorted((r.what, r.kernel_name, r.raw_value, r.origin) for r in got) == [("a", "k1", 10, "cuda"), ("a", "k2", 20, "cuda")]
    assert {r.side: r.cleared for r in gpu.gpu_unmatched(launches, timings).collect()} == {"launch": 2, "timing": 1}


def test_ties_are_decided_by_a_column(spark):
    rows = spark.createDataFrame([("k", t, n) for n, t in enumerate([1, 5, 5, 5, 12, 12, 30])], "k string, t long, n long")
    for width in (4, 6, 100):
        got = sequence.previous_values(rows.repartition(5), ["k"], "t", {"n": "before"}, width, tie="n").collect()
        assert {r.n: r.before for r in got} == {0: None, 1: 0, 2: 1, 3: 2, 4: 3, 5: 4, 6: 5}


def test_entries_come_before_exits_at_the_same_time(spark):
    rows = [(1, 1, 10, -1), (1, 1, 10, 1), (1, 1, 20, 1), (1, 1, 30, -1), (1, 1, 30, 1), (1, 1, 40, -1)]
    edges = spark.createDataFrame(rows, "pid long, tid long, ts_ns long, delta int").withColumns(
        {"node": F.lit("n"), "comm": F.lit("c"), "cookie": F.lit(1 << 32)})
    got = sorted((r.end_ns, r.duration_ns) for r in probes.pair_probe_scopes(edges.repartition(3), ["node", "tid"], 15).collect())
    assert got == [(10, 0), (40, 20)]
