"""Process, executable, container and node facts as labels."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stackloom.functions import host
from stackloom.functions.labels import (
    bool_label, drop_absent, drop_prefix, empty_labels, object_labels, or_empty, overlay,
)
from stackloom.functions.values import fix_utf8_truncation
from stackloom.operators.relabel import RelabelRule, drop_early, filter_kept, relabel
from stackloom.operators.sequence import HOUR_NS, asof_join, with_slice
from stackloom.schema import CUSTOM_LABEL_MAX_LEN, LABEL_TTL_NS, PROBE
from stackloom.session import stored

# A provider takes the process table with its ``labels`` so far and returns it with more labels.
Provider = Callable[[DataFrame], DataFrame]


def _pairs(**columns: Column) -> Column:
    return F.create_map(*[x for name, value in columns.items() for x in (F.lit(name), value.cast("string"))])


def merge_label_sets(*maps: Column) -> Column:
    """Label sets laid over each other in order; later ones win, empty values count as absent."""
    merged = or_empty(maps[0])
    for top in maps[1:]:
        merged = overlay(merged, or_empty(top))
    return drop_absent(merged)


def join_process_metadata(
    samples: DataFrame, processes: DataFrame, payload: list[str], ttl: int | None = LABEL_TTL_NS, width: int = HOUR_NS
) -> DataFrame:
    """Samples with the facts of their process as of the sample time.

    Facts hold for the label lifetime or until the next observation; samples without facts stay.
    """
    return asof_join(samples, processes, ["node", "pid"], "ts_ns", "observed_ns", payload, ttl, width)


def process_provider(processes: DataFrame) -> DataFrame:
    """pid, command line, command name, control group path and parent."""
    facts = _pairs(
        __meta_process_pid=F.col("pid"), __meta_process_cmdline=F.col("cmdline"), comm=F.trim("comm"),
        __meta_process_cgroup=host.main_cgroup(F.col("cgroup_line"))["path"], __meta_process_ppid=F.col("ppid"))
    return processes.withColumn("labels", merge_label_sets(F.col("labels"), facts))


def join_main_executable(processes: DataFrame, executables: DataFrame) -> DataFrame:
    """Executable facts of a process; an unknown file gives empty text and false flags."""
    dim = executables.select(
        F.col("file_id").alias("exe_file_id"), F.col("file_name").alias("exe_name"),
        F.col("build_id").alias("exe_build_id"), F.col("compiler").alias("exe_compiler"),
        F.col("is_static").alias("exe_static"), F.col("stripped").alias("exe_stripped"))
    joined = processes.join(dim, "exe_file_id", "left")
    for name in ("exe_name", "exe_build_id", "exe_compiler"):
        joined = joined.withColumn(name, F.coalesce(name, F.lit("")))
    for name in ("exe_static", "exe_stripped"):
        joined = joined.withColumn(name, F.coalesce(name, F.lit(False)))
    return joined


def executable_provider(executables: DataFrame) -> Provider:
    def add(processes: DataFrame) -> DataFrame:
        facts = _pairs(
            __meta_process_executable_file_id=F.col("exe_file_id"),
            __meta_process_executable_name=F.col("exe_name"),
            __meta_process_executable_build_id=F.col("exe_build_id"),
            __meta_process_executable_compiler=F.col("exe_compiler"),
            __meta_process_executable_static=bool_label(F.col("exe_static")),
            __meta_process_executable_stripped=bool_label(F.col("exe_stripped")))
        joined = join_main_executable(processes, executables)
        return (joined.withColumn("labels", merge_label_sets(F.col("labels"), facts))
                .drop("exe_name", "exe_build_id", "exe_compiler", "exe_static", "exe_stripped"))
    return add


def agent_provider(revision: str) -> Provider:
    def add(processes: DataFrame) -> DataFrame:
        facts = _pairs(__meta_agent_revision=F.lit(revision))
        return processes.withColumn("labels", merge_label_sets(F.col("labels"), facts))
    return add


def system_labels(nodes: DataFrame) -> Provider:
    """Kernel machine and release of the node (``node, machine, release``)."""
    def add(processes: DataFrame) -> DataFrame:
        facts = _pairs(__meta_system_kernel_machine=F.col("machine"), __meta_system_kernel_release=F.col("release"))
        joined = processes.join(nodes.select("node", "machine", "release"), "node", "left")
        return joined.withColumn("labels", merge_label_sets(F.col("labels"), facts)).drop("machine", "release")
    return add


def join_container(
    processes: DataFrame, container_labels: DataFrame,
    kubernetes: bool = True, docker: bool = True, containerd: bool = True,
) -> DataFrame:
    """Container id and technology out of the control group, and the labels of that container.

    ``container_labels`` holds ``container_id, container_labels`` (containerd ids by their last part); a container
    that is listed more than once counts once. A technology that is not known is no error; the process keeps its own labels.
    """
    found = host.container_from_cgroup(F.col("cgroup_line"), kubernetes, docker, containerd)
    marked = (processes.withColumn("_found", found)
              .withColumn("container_id", F.col("_found.container_id")).withColumn("container_env", F.col("_found.env"))
              .drop("_found"))
    env = F.col("container_env")
    parts = host.containerd_parts(F.col("container_id"))
    key = F.when(env == host.ENV_CONTAINERD, parts["id"]).otherwise(F.col("container_id"))
    joined = marked.withColumn("container_key", key).join(
        container_labels.dropDuplicates(["container_id"]).withColumnRenamed("container_id", "container_key"), "container_key", "left")
    own = (F.when(env == host.ENV_BUILDKIT, _pairs(__meta_docker_build_kit_container_id=F.col("container_id")))
           .when(env == host.ENV_LXC, _pairs(__meta_lxc_container_id=F.col("container_id")))
           .otherwise(empty_labels()))
    return joined.withColumn(
        "container_labels", F.coalesce("container_labels", own)).drop("container_key")


def container_provider(container_labels: DataFrame, **technologies: bool) -> Provider:
    def add(processes: DataFrame) -> DataFrame:
        joined = join_container(processes, container_labels, **technologies)
        return (joined.withColumn("labels", merge_label_sets(F.col("labels"), F.col("container_labels")))
                .drop("container_labels", "container_id", "container_env"))
    return add


def docker_container_labels(containers: DataFrame) -> DataFrame:
    """``container_id, container_labels`` of a Docker inventory (``id, names, labels``)."""
    own = _pairs(__meta_docker_container_id=F.col("id"),
                 __meta_docker_container_name=host.container_name(F.get("names", F.lit(0))))
    return containers.select(F.col("id").alias("container_id"), merge_label_sets(
        own, object_labels(F.col("labels"), "__meta_docker_container_label")).alias("container_labels"))


def containerd_container_labels(containers: DataFrame) -> DataFrame:
    """``container_id, container_labels`` of a containerd inventory (``id, namespace, labels``)."""
    own = _pairs(__meta_containerd_container_id=F.col("id"), __meta_containerd_container_name=F.col("id"),
                 __meta_containerd_pod_name=F.col("namespace"))
    return containers.select(F.col("id").alias("container_id"), merge_label_sets(
        own, object_labels(F.col("labels"), "__meta_containerd_container_label")).alias("container_labels"))


def pod_container_labels(pods: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """One label set per running container of a pod: pods x statuses x container specs by name.

    ``pods`` holds ``uid, name, namespace, labels, annotations, owners, node_name, pod_ip, host_ip, phase,
    conditions, containers, init_containers, container_statuses, init_container_statuses``. A status with
    a malformed id or without a spec is left out. The init flag tells the truth for init containers.
    """
    def branch(statuses: str, specs: str, is_init: bool) -> DataFrame:
        status = pods.select("*", F.explode(statuses).alias("_status"))
        spec = F.get(F.filter(F.col(specs), lambda s: s["name"] == F.col("_status.name")), F.lit(0))
        return (status.withColumn("_spec", spec)
                .withColumn("container_id", host.match_container_id(F.col("_status.container_id")))
                .where("_spec IS NOT NULL AND container_id IS NOT NULL")
                .withColumn("_init", F.lit(is_init)))

    rows = branch("container_statuses", "containers", False).unionByName(
        branch("init_container_statuses", "init_containers", True))
    prefix = "__meta_kubernetes_"
    own = F.create_map(*[x for name, value in {
        "namespace": F.col("namespace"), "pod_ip": F.col("pod_ip"), "pod_ready": host.pod_ready(F.col("conditions")),
        "pod_phase": F.col("phase"), "pod_node_name": F.col("node_name"), "pod_host_ip": F.col("host_ip"),
        "pod_uid": F.col("uid"), "pod_container_name": F.col("_spec.name"), "pod_container_id": F.col("container_id"),
        "pod_container_image": F.col("_spec.image"), "pod_container_init": bool_label(F.col("_init")),
        "pod_name": F.col("name"),
    }.items() for x in (F.lit(prefix + name), value)])
    labels = merge_label_sets(
        own, host.controller_labels(F.col("owners")), object_labels(F.col("labels"), prefix + "pod_label"),
        object_labels(F.col("annotations"), prefix + "pod_annotation"))
    out = rows.select("container_id", "node_name", labels.alias("container_labels"))
    if nodes is not None:
        facts = nodes.select(F.col("name").alias("node_name"), merge_label_sets(
            F.create_map(F.lit(prefix + "node_name"), F.col("name")),
            object_labels(F.col("labels"), prefix + "node_label"),
            object_labels(F.col("annotations"), prefix + "node_annotation")).alias("_node"))
        out = (out.join(facts, "node_name", "left")
               .withColumn("container_labels", merge_label_sets(F.col("container_labels"), F.col("_node"))).drop("_node"))
    return out.drop("node_name")


def cri_pods(sandboxes: DataFrame, containers: DataFrame, node_name: str) -> DataFrame:
    """Pods out of runtime sandboxes and their containers.

    ``sandboxes``: ``sandbox_id, name, namespace, uid, labels, annotations``; ``containers``: ``sandbox_id,
    container_id, name, image, image_ref``. The spec list is filled from the statuses (name and image),
    so that :func:`pod_container_labels` can match them.
    """
    status = F.struct("container_id", "name", "image", "image_ref")
    grouped = containers.groupBy("sandbox_id").agg(F.array_sort(F.collect_list(status)).alias("container_statuses"))
    empty_owner = "array<struct<kind:string,name:string,controller:boolean>>"
    named = F.nullif(F.col("labels")["io.kubernetes.pod.nodename"], F.lit(""))
    joined = sandboxes.join(grouped, "sandbox_id", "left")
    statuses = F.coalesce("container_statuses", F.array().cast(
        "array<struct<container_id:string,name:string,image:string,image_ref:string>>"))
    none = F.array().cast("array<struct<container_id:string,name:string,image:string,image_ref:string>>")
    return joined.select(
        "sandbox_id", "uid", "name", "namespace", "labels", "annotations", F.array().cast(empty_owner).alias("owners"),
        F.coalesce(named, F.lit(node_name)).alias("node_name"), F.lit("").alias("pod_ip"), F.lit("").alias("host_ip"),
        F.lit("").alias("phase"), F.array().cast("array<struct<type:string,status:string>>").alias("conditions"),
        F.transform(statuses, lambda s: F.struct(s["name"].alias("name"), s["image"].alias("image"))).alias("containers"),
        F.array().cast("array<struct<name:string,image:string>>").alias("init_containers"),
        statuses.alias("container_statuses"), none.alias("init_container_statuses"))


def env_labels(env: Column, include: list[str]) -> Column:
    """``__meta_env_var_<name>`` for the variables on the include list."""
    picked = F.map_filter(or_empty(env), lambda k, _: k.isin(*include) if include else F.lit(False))
    return F.transform_keys(picked, lambda k, _: F.concat(F.lit("__meta_env_var_"), k))


def process_labels(processes: DataFrame, providers: list[Provider], rules: list[RelabelRule],
                   env_include: list[str] | None = None) -> DataFrame:
    """Final labels and verdict per process observation.

    Order: node, environment, out-of-memory mark, providers, rules, removal of temporary labels. This is
    the expensive part of labelling and it runs once per process observation, not once per sample. The rows
    are spread over all cores first: they are few, but each costs far more work than its transfer. The number of partitions is
    the session's, since a plan that is adapted to bytes would put them all into one.
    """
    parts = int(processes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    processes = processes.repartition(parts, "node", "pid")
    start = F.create_map(F.lit("node"), F.col("node"))
    if "env" in processes.columns:
        start = overlay(start, env_labels(F.col("env"), env_include or []))
    if "oom_killed" in processes.columns:
        start = F.when(F.col("oom_killed"), overlay(start, F.create_map(F.lit("job"), F.lit("oomprof")))).otherwise(start)
    labelled = processes.withColumn("labels", drop_absent(start))
    for provider in providers:
        labelled = provider(labelled)
    ruled = relabel(labelled, rules)
    return ruled.withColumn("labels", drop_prefix(drop_absent(F.col("labels"))))


def _once(processes: DataFrame) -> DataFrame:
    """One observation per process and time: of several the one whose facts come last as text."""
    facts = [c for c in processes.columns if c not in ("node", "pid", "observed_ns")]
    row = F.struct(*facts)
    best = processes.groupBy("node", "pid", "observed_ns").agg(F.max_by(row, F.to_json(row)).alias("_facts"))
    return best.select("node", "pid", "observed_ns", "_facts.*")


def _timeline(sampled: DataFrame, processes: DataFrame, ttl: int) -> DataFrame:
    """Observations of the ``sampled`` processes, made gapless: facts for their lifetime, else nothing."""
    processes = _once(processes.join(sampled, ["node", "pid"], "left_semi"))
    next_seen = F.lead("observed_ns").over(Window.partitionBy("node", "pid").orderBy("observed_ns"))
    # an observation is followed by "nothing known" where its lifetime ends before the next one comes
    ends = F.when(F.col("_next").isNull() | (F.col("_next") > F.col("observed_ns") + F.lit(ttl + 1)), F.col("observed_ns") + F.lit(ttl + 1))
    facts = [c for c in processes.columns if c not in ("node", "pid", "observed_ns")]
    row = F.struct(F.col("observed_ns").alias("at"), F.struct(*facts).alias("facts"))
    nothing = F.struct(ends.alias("at"), F.lit(None).cast(processes.select(F.struct(*facts).alias("f")).schema["f"].dataType).alias("facts"))
    both = F.filter(F.array(row, nothing), lambda r: r["at"].isNotNull())
    known = processes.withColumn("_next", next_seen).select("node", "pid", F.explode(both).alias("_r")).select(
        "node", "pid", F.col("_r.at").alias("observed_ns"), "_r.facts.*")
    return known.unionByName(sampled.withColumn("observed_ns", F.lit(-(2**62)).cast("long")), allowMissingColumns=True)


def thread_labels(labels: Column, cpu: bool = True, thread_id: bool = True, thread_name: bool = True) -> Column:
    """Per-row cpu, thread id and thread name laid over the process labels."""
    parts = []
    if cpu:
        parts += [F.lit("cpu"), F.col("cpu").cast("string")]
    if thread_id:
        parts += [F.lit("thread_id"), F.col("tid").cast("string")]
    if thread_name:
        parts += [F.lit("thread_name"), F.col("comm")]
    return drop_absent(overlay(labels, F.create_map(*parts))) if parts else labels


def patch_thread_labels(samples: DataFrame, cpu: bool = True, thread_id: bool = True, thread_name: bool = True) -> DataFrame:
    return samples.withColumn("labels", thread_labels(F.col("labels"), cpu, thread_id, thread_name))


def custom_labels(samples: DataFrame, max_len: int = CUSTOM_LABEL_MAX_LEN - 1) -> DataFrame:
    """Labels set by the program itself, over the others: names must be UTF-8, values repaired or dropped."""
    entries = F.filter(F.map_entries(F.coalesce("custom_labels", F.expr("cast(map() as map<binary,binary>)"))),
                       lambda e: F.is_valid_utf8(e["key"].cast("string")))
    fixed = F.filter(
        F.transform(entries, lambda e: F.struct(
            e["key"].cast("string").alias("key"), fix_utf8_truncation(e["value"], max_len).alias("value"))),
        lambda e: e["value"].isNotNull())
    return samples.withColumn("labels", drop_absent(overlay(F.col("labels"), F.map_from_entries(fixed)))).drop("custom_labels")


def external_labels(samples: DataFrame, constants: dict[str, str]) -> DataFrame:
    """Constant labels on all rows; a row's own value wins."""
    if not constants:
        return samples
    fixed = F.create_map(*[F.lit(x) for pair in constants.items() for x in pair])
    return samples.withColumn("labels", drop_absent(overlay(fixed, F.col("labels"))))


def label_samples(
    events: DataFrame, processes: DataFrame, providers: list[Provider], rules: list[RelabelRule], *,
    env_include: list[str] | None = None, ttl: int = LABEL_TTL_NS, width: int = HOUR_NS,
    cpu: bool = True, thread_id: bool = True, thread_name: bool = True, stored_labels: dict[str, str] | None = None,
) -> DataFrame:
    """Events with their final labels; events that a rule drops are gone.

    The rules run on the gapless process table; events pick up the labels in force at their time, then
    get their thread and custom labels. Probe events, told by their origin, run through the rules once more in between.

    Events are read twice: once for the processes and time slices they need, which is a small table, and once to be labelled.
    ``stored_labels`` names labels that equal an event column and that no provider sets; events that a rule drops for those alone
    are not read at all.
    """
    events = drop_early(events, rules, {"node": "node"} if stored_labels is None else stored_labels)
    waiting = stored(with_slice(events, "ts_ns", width).select("node", "pid", "_slice").distinct(), "sampled")
    sampled = waiting.select("node", "pid").distinct()
    labels = stored(process_labels(_timeline(sampled, processes, ttl), providers, rules, env_include).select(
        "node", "pid", "observed_ns", "labels", "keep"), "labels")
    joined = asof_join(events, labels, ["node", "pid"], "ts_ns", "observed_ns", ["labels", "keep"], None, width, waiting=waiting)
    out = patch_thread_labels(filter_kept(joined), cpu, thread_id, thread_name)
    if "origin" in events.columns:
        out = relabel_probe_samples(out, rules)
    return custom_labels(out) if "custom_labels" in events.columns else out


def relabel_probe_samples(samples: DataFrame, rules: list[RelabelRule]) -> DataFrame:
    """Probe rows run through the rules again, now seeing thread labels; other rows pass untouched.

    Temporary labels are gone by then, so a replace rule that reads one finds nothing and clears its target.
    """
    if not rules:
        return samples
    probe = F.col("origin").eqNullSafe(F.lit(PROBE))
    # one pass over all rows: the rules see an empty map where a row is not a probe's, which costs them next to nothing
    own = samples.withColumns({"_own": F.col("labels"), "labels": F.when(probe, F.col("labels")).otherwise(
        F.create_map().cast("map<string,string>"))})
    again = relabel(own, rules, keep="_probe_keep").where(~probe | F.col("_probe_keep"))
    return again.withColumn("labels", F.when(probe, drop_prefix(drop_absent(F.col("labels")))).otherwise(F.col("_own"))).drop(
        "_own", "_probe_keep")
