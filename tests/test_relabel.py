"""Rules: loading, and every action."""

import pytest
from pyspark.sql import functions as F

from stackloom.operators.metadata import relabel_probe_samples
from stackloom.operators.probes import load_probe_specs, match_probe_targets
from stackloom.operators.relabel import RelabelRule, filter_kept, load_relabel_rules, relabel


def run(spark, labels, *rules):
    pairs = [F.lit(x) for pair in labels.items() for x in pair]
    row = relabel(spark.range(1).withColumn("labels", F.create_map(*pairs)), list(rules)).first()
    return row["labels"], row["keep"]


def test_load():
    with pytest.raises(ValueError):
        load_relabel_rules("")
    assert load_relabel_rules("# nothing but a comment\n") == []
    assert load_relabel_rules("relabel_configs: []") == []
    drop, keep = load_relabel_rules("""
relabel_configs:
- source_labels: [systemd_unit]
  regex: ""
  action: drop
- "action": "keep"
  "regex": "agent"
  "source_labels":
  - "app.kubernetes.io/name"
""")
    assert drop == RelabelRule("drop", ["systemd_unit"], ";", "", "", "$1")
    assert (keep.separator, keep.replacement, keep.source_labels) == (";", "$1", ["app.kubernetes.io/name"])
    for bad in ("relabel_configs: [{action: nothing}]", "relabel_configs: [{action: hashmod, target_label: a}]",
                "relabel_configs: [{action: replace}]", "relabel_configs: [{typo: 1, target_label: a}]"):
        with pytest.raises(ValueError):
            load_relabel_rules(bad)


def test_replace(spark):
    base = {"a": "foo", "b": "bar"}
    assert run(spark, base, RelabelRule(source_labels=["a"], target_label="c"))[0] == {**base, "c": "foo"}
    both = RelabelRule(source_labels=["a", "b"], regex="f(.*);(.*)r", target_label="c", replacement="${2}-$1")
    assert run(spark, base, both)[0]["c"] == "ba-oo"
    assert run(spark, base, RelabelRule(source_labels=["a"], regex="fo", target_label="c"))[0] == base  # whole text only
    assert run(spark, base, RelabelRule(source_labels=["a"], target_label="b", replacement=""))[0] == {"a": "foo"}
    named = RelabelRule(source_labels=["a"], regex="(?P<x>f)(.*)", target_label="t_${x}", replacement="$$${x}$9")
    assert run(spark, base, named)[0]["t_f"] == "$f"
    invalid = RelabelRule(source_labels=["a"], target_label="${1}-x", replacement="v")
    assert run(spark, base, invalid)[0] == base
    assert run(spark, base, RelabelRule(source_labels=["nope"], target_label="c", replacement="$1"))[0] == base
    lines = run(spark, {"a": "x\ny"}, RelabelRule(source_labels=["a"], regex="x.y", target_label="c", replacement="1"))
    assert lines[0]["c"] == "1"  # the dot takes line ends too


def test_keep_and_drop(spark):
    base = {"a": "foo", "b": "foo"}
    assert run(spark, base, RelabelRule("keep", ["a"], regex="foo"))[1]
    assert not run(spark, base, RelabelRule("keep", ["a"], regex="bar"))[1]
    assert not run(spark, base, RelabelRule("drop", ["a"], regex="f.*"))[1]
    assert not run(spark, base, RelabelRule("drop", ["missing"], regex=""))[1]
    assert run(spark, base, RelabelRule("keepequal", ["a"], target_label="b"))[1]
    assert not run(spark, base, RelabelRule("dropequal", ["a"], target_label="b"))[1]
    # a verdict stays, whatever later rules say
    assert not run(spark, base, RelabelRule("drop", ["a"], regex="foo"), RelabelRule("keep", ["a"], regex="foo"))[1]


def test_names_and_values(spark):
    base = {"pod_app": "x", "pod_zone": "y", "z": "A"}
    mapped = run(spark, base, RelabelRule("labelmap", regex="pod_(.+)"))[0]
    assert mapped == {**base, "app": "x", "zone": "y"}
    assert run(spark, base, RelabelRule("labeldrop", regex="pod_.*"))[0] == {"z": "A"}
    assert run(spark, base, RelabelRule("labelkeep", regex="pod_.*"))[0] == {"pod_app": "x", "pod_zone": "y"}
    assert run(spark, base, RelabelRule("lowercase", ["z"], target_label="z"))[0]["z"] == "a"
    assert run(spark, base, RelabelRule("uppercase", ["pod_app"], target_label="u"))[0]["u"] == "X"
    import hashlib
    expected = int.from_bytes(hashlib.md5(b"A").digest()[8:], "big") % 1000
    assert run(spark, base, RelabelRule("hashmod", ["z"], target_label="h", modulus=1000))[0]["h"] == str(expected)


def test_order_matters(spark):
    rules = [RelabelRule(source_labels=["a"], target_label="b"), RelabelRule(source_labels=["b"], target_label="c")]
    assert run(spark, {"a": "1"}, *rules)[0] == {"a": "1", "b": "1", "c": "1"}
    assert run(spark, {"a": "1"}, *rules[::-1])[0] == {"a": "1", "b": "1"}


def test_probe_samples_run_twice(spark):
    rows = spark.createDataFrame(
        [("probe", {"cpu": "1"}), ("probe", {"cpu": "2"}), ("sampling", {"cpu": "2"})],
        "origin string, labels map<string,string>")
    rules = [RelabelRule("drop", ["cpu"], regex="2"), RelabelRule(source_labels=["cpu"], target_label="__meta_x")]
    left = relabel_probe_samples(rows, rules).collect()
    assert sorted((r["origin"], r["labels"]["cpu"]) for r in left) == [("probe", "1"), ("sampling", "2")]
    assert all("__meta_x" not in r["labels"] for r in left)


def test_filter_kept(spark):
    rows = spark.createDataFrame([(1, True), (2, False)], "id long, keep boolean")
    assert [r["id"] for r in filter_kept(rows).collect()] == [1]


PROBE = "- {id: %s, file_match: '%s', entry_symbol: a, exit_symbol: b}\n"


def test_probe_specs(spark):
    specs = load_probe_specs("probes:\n" + PROBE % ("x", "(^|/)node$") + PROBE % ("y", "no") +
                             "- {id: z, file_match: q, entry_symbol: a, exit_symbol: b, main_thread_only: false, min_duration_ms: 50}")
    assert [(s.spec_id, s.main_thread_only, s.min_duration_ms) for s in specs] == [(1, True, 0), (2, True, 0), (3, False, 50)]
    assert specs[2].cookie == 3 << 32 | 50 << 1
    for bad in ("probes: []", "", "probes: [{id: x}]", "probes:\n" + PROBE % ("x", "(")):
        with pytest.raises(ValueError):
            load_probe_specs(bad)
    files = spark.createDataFrame(
        [("f1", "/usr/bin/node", "node"), ("f1", "/usr/bin/node", "node"), ("f2", "", "node"), ("f3", "/x/nodejs", "n"),
         ("f4", None, "zzz")], "file_id string, path string, file_name string")
    found = {(r["file_id"], r["probe_id"]) for r in match_probe_targets(files, specs).collect()}
    assert found == {("f1", "x"), ("f1", "y"), ("f2", "x"), ("f2", "y"), ("f3", "y")}


def test_rules_are_worked_out_once(spark):
    """A filter on ``keep`` carries no copy of the rules, and each rule refers to the one before it once."""
    rows = spark.createDataFrame([(1, {"a": "x"}), (2, {"a": "y"}), (3, None)], "id long, labels map<string,string>")
    rules = [RelabelRule(source_labels=["a"], target_label="b_${1}", regex="(.)", replacement="v$1") for _ in range(6)]
    rules += [RelabelRule(source_labels=["a"], regex="y", action="drop"), RelabelRule(regex="b_.*", action="labelkeep")]
    kept = filter_kept(relabel(rows, rules))
    plan = kept._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract") == 2 * 6  # name and value of each rule
    assert {r["id"]: r["labels"] for r in kept.collect()} == {1: {"b_x": "vx"}, 3: None}
