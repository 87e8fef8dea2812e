"""Facts read from a host: control groups, command lines, process status, container ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from stackloom.functions.labels import let

# How each container technology shows in a control-group line.
CONTAINER_ID = r"^(?:.+://)?([0-9a-f]{64})\z"
KUBE = r"\d+:.*:/.*/*kubepods/[^/]+/pod[^/]+/([0-9a-f]{64})"
DOCKER_KUBE = r"\d+:.*:/.*/*docker/pod[^/]+/([0-9a-f]{64})"
ALT_KUBE = r"\d+:.*:/.*/*kubepods.*?/[^/]+/docker-([0-9a-f]{64})"
SYSTEMD_KUBE = r"\d+:.*:/.*/*kubepods-.*([0-9a-f]{64})"
DOCKER = r"\d+:.*:/.*?/*docker[-|/]([0-9a-f]{64})"
BUILDKIT = r"\d+:.*:/.*/*docker/buildkit/([0-9a-z]+)"
LXC = r"\d+::/lxc\.(monitor|payload)\.([a-zA-Z]+)/"
CONTAINERD = r"\d+:.+:/([a-zA-Z0-9_-]+)/+([a-zA-Z0-9_-]+)"

# The technology bits.
ENV_KUBERNETES, ENV_DOCKER, ENV_LXC, ENV_CONTAINERD, ENV_BUILDKIT = 2, 4, 8, 16, 32


def match_container_id(raw: Column) -> Column:
    """The 64 hex digits, with or without a scheme in front; NULL for anything else."""
    return F.nullif(F.regexp_extract(raw, CONTAINER_ID, 1), F.lit(""))


def _lines(text: Column) -> Column:
    body = F.regexp_replace(text, r"\n\z", "")
    return F.when(body == "", F.array().cast("array<string>")).otherwise(F.split(body, "\r?\n"))


def container_from_cgroup(
    text: Column, kubernetes: bool = True, docker: bool = True, containerd: bool = True
) -> Column:
    """``(container_id, env)`` of the first line that names a container; ``('', 0)`` if none does."""
    rules: list[tuple[str, int, int]] = []
    if kubernetes:
        rules += [
            (DOCKER_KUBE, 1, ENV_KUBERNETES | ENV_DOCKER), (KUBE, 1, ENV_KUBERNETES),
            (ALT_KUBE, 1, ENV_KUBERNETES), (SYSTEMD_KUBE, 1, ENV_KUBERNETES),
        ]
    if docker:
        rules += [(DOCKER, 1, ENV_DOCKER), (BUILDKIT, 1, ENV_BUILDKIT)]
    if containerd:
        rules += [(CONTAINERD, 0, ENV_CONTAINERD)]
    rules += [(LXC, 2, ENV_LXC)]

    def of_line(line: Column) -> Column:
        return F.coalesce(*[
            F.when(F.rlike(line, F.lit(pattern)), F.struct(
                F.regexp_extract(line, pattern, group).alias("container_id"), F.lit(env).alias("env")))
            for pattern, group, env in rules
        ])

    found = F.get(F.filter(F.transform(_lines(text), of_line), lambda x: x.isNotNull()), F.lit(0))
    return F.coalesce(found, F.struct(F.lit("").alias("container_id"), F.lit(0).alias("env")))


def parse_cgroup_line(line: Column) -> Column:
    """``hierarchy:controllers:path``; NULL unless there are three fields and a number in front."""
    parts = F.split(line, ":", 3)
    number = F.get(parts, F.lit(0))
    names = F.get(parts, F.lit(1))
    return F.when(
        (F.size(parts) == 3) & F.rlike(number, F.lit(r"^[+-]?[0-9]+\z")),
        F.struct(
            number.try_cast("int").alias("hierarchy_id"),
            F.when(names == "", F.array().cast("array<string>")).otherwise(F.split(names, ",")).alias("controllers"),
            F.get(parts, F.lit(2)).alias("path"),
        ))


def main_cgroup(text: Column) -> Column:
    """The only line, else the first with a cpu controller, a systemd slice or a systemd controller.

    An unreadable line makes the whole text unreadable (NULL); no candidate gives an empty group.
    """
    nothing = F.struct(
        F.lit(0).alias("hierarchy_id"), F.array().cast("array<string>").alias("controllers"), F.lit("").alias("path"))

    def wanted(g: Column) -> Column:
        return (F.array_contains(g["controllers"], "cpu")
                | F.startswith(g["path"], F.lit("/system.slice/")) | F.startswith(g["path"], F.lit("/user.slice/"))
                | F.exists(g["controllers"], lambda c: F.contains(c, F.lit("systemd"))))

    def choose(s: Column) -> Column:
        groups = s["groups"]
        return (F.when(F.exists(groups, lambda g: g.isNull()), F.lit(None))
                .when(F.size(groups) == 1, F.get(groups, F.lit(0)))
                .otherwise(F.coalesce(F.get(F.filter(groups, wanted), F.lit(0)), nothing)))
    return let(choose, groups=F.transform(_lines(text), parse_cgroup_line))


def parse_cmdline(raw: Column) -> Column:
    """NUL-separated arguments joined by blanks, trailing NULs removed."""
    return F.replace(F.regexp_replace(raw, r"\x00+\z", ""), F.lit("\0"), F.lit(" "))


# Fields after the command name, by position.
STAT_FIELDS = {
    0: "state", 1: "ppid", 2: "pgrp", 3: "session", 4: "tty", 5: "tpgid", 6: "flags", 7: "minflt", 8: "cminflt",
    9: "majflt", 10: "cmajflt", 11: "utime", 12: "stime", 13: "cutime", 14: "cstime", 15: "priority", 16: "nice",
    17: "num_threads", 19: "starttime", 20: "vsize", 21: "rss", 22: "rss_limit", 36: "processor",
    37: "rt_priority", 38: "policy", 39: "delay_blkio_ticks", 40: "guest_time", 41: "cguest_time",
}


def parse_proc_stat(raw: Column) -> Column:
    """Command name between the first ``(`` and the last ``)``, then positional fields; NULL if malformed.

    The line is matched and split once, not once per field.
    """
    pattern = r"(?s)\A[^(]*\((.*)\).(.*)\z"

    def parsed(s: Column) -> Column:
        columns = [s["comm"].alias("comm")]
        for position, name in STAT_FIELDS.items():
            field = F.get(s["fields"], F.lit(position))
            columns.append((field if name == "state" else field.try_cast("decimal(20,0)")).alias(name))
        return F.when(s["matches"] & (F.size(s["fields"]) >= 42), F.struct(*columns))
    return let(parsed, matches=F.rlike(raw, F.lit(pattern)), comm=F.regexp_extract(raw, pattern, 1),
               fields=F.split(F.trim(F.regexp_extract(raw, pattern, 2)), r"\s+"))


def containerd_parts(raw: Column) -> Column:
    """Namespace and id out of ``a/b/c``; NULL with fewer than three parts."""
    parts = F.split(raw, "/", 4)
    return F.when(F.size(parts) >= 3, F.struct(
        F.get(parts, F.lit(1)).alias("namespace"), F.get(parts, F.lit(2)).alias("id")))


def container_name(raw: Column) -> Column:
    return F.regexp_replace(raw, r"\A/", "")


def pod_ready(conditions: Column) -> Column:
    """Status of the Ready condition in lower case, else ``unknown``."""
    ready = F.get(F.filter(conditions, lambda c: c["type"] == "Ready"), F.lit(0))
    return F.coalesce(F.lower(ready["status"]), F.lit("unknown"))


def controller_of(owners: Column) -> Column:
    """The first owner marked as controller."""
    return F.get(F.filter(owners, lambda o: F.coalesce(o["controller"], F.lit(False))), F.lit(0))


def controller_labels(owners: Column) -> Column:
    """Labels of the owning controller; a missing or empty kind or name gives no label."""
    owner = controller_of(owners)
    pairs = F.map_from_entries(F.array(
        F.struct(F.lit("__meta_kubernetes_pod_controller_kind").alias("key"), owner["kind"].alias("value")),
        F.struct(F.lit("__meta_kubernetes_pod_controller_name").alias("key"), owner["name"].alias("value"))))
    return F.map_filter(pairs, lambda _, v: v.isNotNull() & (v != ""))
