"""Scalar expressions against the inputs and results of the reference's own tests."""

import pytest
from pyspark.sql import functions as F

from stackloom.functions import host, labels, values
from stackloom.operators.fleet import log_severity

ID = "0123456789abcdef" * 4
CHINESE = "您好" + "世界" * 20


@pytest.mark.parametrize("text, expected", [
    ("containerd://" + ID, ID), ("docker://" + ID, ID), ("cri-o://" + ID, ID), (ID, ID), ("", None), (ID[:10], None),
    ("g" * 64, None), (ID + "a", None), ("/kubepods/pod1/" + ID, None), ("containerd://" + ID + "-x", None)])
def test_match_container_id(one, text, expected):
    assert one(host.match_container_id(F.lit(text))) == expected


@pytest.mark.parametrize("line, expected", [
    (f"1:cpu:/kubepods/burstable/pod12/{ID}", (ID, 2)),
    (f"1:cpu:/docker/pod12/{ID}", (ID, 2 | 4)),
    (f"1:cpu:/kubepods-besteffort.slice/kubepods-pod1.slice/docker-{ID}.scope", (ID, 2)),
    (f"1:cpu:/kubepods-besteffort-pod1.slice:cri-containerd:{ID}", (ID, 2)),
    (f"4:memory:/docker/{ID}", (ID, 4)), (f"4:memory:/system.slice/docker-{ID}.scope", (ID, 4)),
    ("3:x:/docker/buildkit/abc123", ("abc123", 32)),
    ("0::/lxc.payload.web/init.scope", ("web", 8)), ("7:pids:/default/ctr-1", ("7:pids:/default/ctr-1", 16)),
    ("0::/", ("", 0)), (f"5:net:/\n0::/\n1:cpu:/kubepods/b/pod1/{ID}\n4:m:/docker/x", (ID, 2))])
def test_container_from_cgroup(one, line, expected):
    assert tuple(one(host.container_from_cgroup(F.lit(line)))) == expected


def test_container_technologies_can_be_off(one):
    line = F.lit(f"4:memory:/docker/{ID}")
    assert one(host.container_from_cgroup(line, docker=False, containerd=False))["container_id"] == ""
    assert one(host.container_from_cgroup(line, docker=False))["env"] == host.ENV_CONTAINERD


def test_cgroup_lines(one):
    parsed = one(host.parse_cgroup_line(F.lit("4:cpu,cpuacct:/a:b")))
    assert (parsed.hierarchy_id, parsed.controllers, parsed.path) == (4, ["cpu", "cpuacct"], "/a:b")
    assert one(host.parse_cgroup_line(F.lit("0::/x"))).controllers == []
    assert one(host.parse_cgroup_line(F.lit("4:cpu"))) is None
    assert one(host.parse_cgroup_line(F.lit("x:cpu:/"))) is None


@pytest.mark.parametrize("text, path", [
    ("0::/only", "/only"), ("9:net:/a\n3:cpu,x:/b\n", "/b"), ("9:net:/a\n2:x:/user.slice/u\n", "/user.slice/u"),
    ("9:net:/a\n1:name=systemd:/c", "/c"), ("9:net:/a\n8:io:/b", ""), ("", "")])
def test_main_cgroup(one, text, path):
    assert one(host.main_cgroup(F.lit(text)))["path"] == path


def test_main_cgroup_unreadable(one):
    assert one(host.main_cgroup(F.lit("9:net:/a\nbroken\n"))) is None


def test_cmdline_and_stat(one):
    assert one(host.parse_cmdline(F.lit("/bin/sh\0-c\0x\0\0"))) == "/bin/sh -c x"
    assert one(host.parse_cmdline(F.lit(""))) == ""
    rest = " ".join(str(n) for n in range(1, 42))
    stat = one(host.parse_proc_stat(F.lit(f"12 (a (b) c) S {rest}\n")))
    assert (stat.comm, stat.state, stat.ppid, stat.processor, stat.cguest_time) == ("a (b) c", "S", 1, 36, 41)
    assert one(host.parse_proc_stat(F.lit("12 a S 1"))) is None
    assert one(host.parse_proc_stat(F.lit("12 (a) S 1 2"))) is None


@pytest.mark.parametrize("raw, expected", [
    (b"ASCII string", "ASCII string"),
    (CHINESE.encode()[:4], None),                       # cut, but not at the limit
    (("a" + CHINESE).encode()[:48], ("a" + CHINESE).encode()[:46].decode()),  # two bytes of a character left
    (("ab" + CHINESE).encode()[:48], ("ab" + CHINESE).encode()[:47].decode()),  # one byte left
    (CHINESE.encode()[:48], CHINESE.encode()[:48].decode()),  # cut between characters
    (CHINESE.encode(), CHINESE),                        # longer than the limit but valid
    (b"\xff" * 48, None), (b"\xff" + b"a" * 47, None),
    ("😀".encode() * 11 + b"a" + "😀".encode()[:3], None)])  # a four-byte character can be cut too far
def test_fix_utf8_truncation(one, raw, expected):
    assert one(values.fix_utf8_truncation(F.lit(bytearray(raw)), 48)) == expected


@pytest.mark.parametrize("spec, main, ms", [(1, True, 0), (2, False, 0), (3, True, 50), (4, False, 100)])
def test_probe_cookie(one, spec, main, ms):
    cookie = one(values.probe_cookie(F.lit(spec), F.lit(main), F.lit(ms)))
    assert cookie == spec << 32 | ms << 1 | int(main)
    assert tuple(one(values.unpack_probe_cookie(F.lit(cookie)))) == (spec, main, ms)


@pytest.mark.parametrize("n, power", [(0, 1), (1, 1), (2, 2), (3, 4), (65536, 65536), (65537, 131072)])
def test_next_power_of_two(one, n, power):
    assert one(values.next_power_of_two(F.lit(n))) == power


@pytest.mark.parametrize("a, b, expected", [
    (5, 3, 2), (3, 5, -2), (-(2**63), 1, 2**63 - 1), (2**63 - 1, -1, -(2**63)), (2**63 - 1, -(2**63), -1)])
def test_wrapping_minus(one, a, b, expected):
    assert one(values.wrapping_minus(F.lit(a), F.lit(b))) == expected


@pytest.mark.parametrize("n, d, expected", [(7, 2, 3), (-7, 2, -4), (-1, 1000, -1), (0, 5, 0)])
def test_floor_div(one, n, d, expected):
    assert one(values.floor_div(F.lit(n), d)) == expected


def test_label_maps(one):
    a = F.create_map(F.lit("x"), F.lit("1"), F.lit("y"), F.lit("2"))
    b = F.create_map(F.lit("y"), F.lit("3"), F.lit("z"), F.lit(""))
    assert one(labels.drop_absent(labels.overlay(a, b))) == {"x": "1", "y": "3"}
    assert one(labels.set_label(a, "x", F.lit(""))) == {"y": "2"}
    assert one(labels.labels_string(a)) == "x=1,y=2"
    clash = F.create_map(F.lit("a.b"), F.lit("1"), F.lit("a-b"), F.lit("2"))
    assert one(labels.object_labels(clash, "p")) == {"p_a_b": "1", "ppresent_a_b": "true"}
    assert one(labels.drop_prefix(F.create_map(F.lit("__meta_a"), F.lit("1"), F.lit("b"), F.lit("2")))) == {"b": "2"}


@pytest.mark.parametrize("level, severity", [
    ("trace", "trace"), ("debug", "debug"), ("info", "info"), ("warning", "warn"), ("error", "error"), ("fatal", "fatal"),
    ("panic", "fatal"), ("other", "undefined")])
def test_log_severity(one, level, severity):
    assert one(log_severity(F.lit(level))) == severity


def test_ids(one):
    assert one(values.trim_nul(F.lit("abc\0def"))) == "abc"
    assert one(values.hex_id(F.lit(bytearray(b"\x01\xff")))) == "01ff"
    same = [values.content_id([F.lit("a"), F.lit("b,c")]), values.content_id([F.lit("a,b"), F.lit("c")])]
    assert one(same[0]) != one(same[1])
    assert one(values.content_id([F.lit(""), F.lit("x")])) != one(values.content_id([F.lit(None), F.lit("x")]))


def test_process_status_is_matched_once(spark):
    """The fields come from one match and one split of the line."""
    rows = spark.createDataFrame([("7 (a) b) S " + " ".join(str(i) for i in range(1, 50)),), (None,), ("7 (a) S 1",)], "raw string")
    parsed = rows.select(host.parse_proc_stat(F.col("raw")).alias("s"))
    assert parsed._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract") == 2
    found = [r["s"] for r in parsed.collect()]
    assert (found[0]["comm"], found[0]["state"], found[0]["ppid"], found[0]["utime"]) == ("a) b", "S", 1, 11) and found[1:] == [None, None]


def test_processes_are_dealt_out(spark, tmp_path):
    """Rows of one row group are spread over tasks before rules and parsers run."""
    from stackloom.plans import inputs
    from stackloom.plans.fixtures import Tables

    spark.range(100).selectExpr("id AS c_custkey", "CAST(id % 25 AS INT) AS c_nationkey", "'MACHINERY' AS c_mktsegment").coalesce(1).write.parquet(
        f"{tmp_path}/customer.parquet")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        dealt = inputs.processes(Tables(spark, str(tmp_path)))
        tasks = {r[0]: r[1] for r in dealt.groupBy(F.spark_partition_id().alias("task")).count().collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sum(tasks.values()) == 100 and len(tasks) > 1
