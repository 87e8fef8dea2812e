"""Label maps, rules, metadata joins and host facts."""

from __future__ import annotations

from pyspark.sql import functions as F

from stackloom.functions import host, labels as lab, values
from stackloom.operators import metadata as meta, records, relabel as rel
from stackloom.plans import inputs
from stackloom.plans.fixtures import Tables
from stackloom.plans.registry import query

# ---- scalar functions -------------------------------------------------------------------------


@query("match_container_id", r"""
    SELECT ctr_key, nullif(regexp_extract(raw_container_id, '^(?:.+://)?([0-9a-f]{64})$', 1), '') AS container_id
    FROM fx_containers""")
def _(t: Tables):
    return t.fx("fx_containers").select("ctr_key", host.match_container_id(F.col("raw_container_id")).alias("container_id"))


_CGROUP_SQL = r"""
    SELECT pid,
      CASE WHEN cgroup_line LIKE '1:cpu,cpuacct:/kubepods/%' THEN md5(CAST(pid AS VARCHAR)) || md5('c' || CAST(pid AS VARCHAR))
           WHEN cgroup_line LIKE '4:memory:/docker/%' THEN md5(CAST(pid AS VARCHAR)) || md5('c' || CAST(pid AS VARCHAR))
           WHEN cgroup_line LIKE '0::/lxc%' THEN 'web' WHEN cgroup_line LIKE '7:pids:%' THEN cgroup_line
           WHEN cgroup_line LIKE '3:cpuset:%' THEN md5(CAST(pid AS VARCHAR))
           WHEN cgroup_line LIKE '2:cpu:%' THEN md5(CAST(pid AS VARCHAR)) || md5('c' || CAST(pid AS VARCHAR))
           ELSE '' END AS container_id,
      CASE WHEN cgroup_line LIKE '1:cpu,cpuacct:/kubepods/%' THEN 2 WHEN cgroup_line LIKE '4:memory:/docker/%' THEN 4
           WHEN cgroup_line LIKE '0::/lxc%' THEN 8 WHEN cgroup_line LIKE '7:pids:%' THEN 16
           WHEN cgroup_line LIKE '3:cpuset:%' THEN 32 WHEN cgroup_line LIKE '2:cpu:%' THEN 2 ELSE 0 END AS env
    FROM fx_processes"""


@query("container_from_cgroup", _CGROUP_SQL)
def _(t: Tables):
    return inputs.processes(t).select(
        "pid", host.container_from_cgroup(F.col("cgroup_line")).alias("c")).select("pid", "c.container_id", "c.env")


@query("parse_cgroup_line", r"""
    SELECT pid, CAST(split_part(cgroup_line, ':', 1) AS INTEGER) AS hierarchy_id,
           replace(split_part(cgroup_line, ':', 2), ',', '+') AS controllers,
           regexp_extract(cgroup_line, '^[^:]*:[^:]*:(.*)$', 1) AS path FROM fx_processes""")
def _(t: Tables):
    return inputs.processes(t).select("pid", host.parse_cgroup_line(F.col("cgroup_line")).alias("g")).select(
        "pid", "g.hierarchy_id", F.array_join("g.controllers", "+").alias("controllers"), "g.path")


@query("main_cgroup", r"""
    SELECT pid, CASE WHEN pid % 3 = 0 THEN '/init' WHEN cgroup_line LIKE '1:cpu,%' OR cgroup_line LIKE '2:cpu:%'
                          OR cgroup_line LIKE '0::/system.slice/%'
                     THEN regexp_extract(cgroup_line, '^[^:]*:[^:]*:(.*)$', 1)
                     WHEN pid % 3 = 1 THEN '/user.slice/u' ELSE '' END AS path
    FROM fx_processes""")
def _(t: Tables):
    text = F.expr(r"""CASE pid % 3 WHEN 0 THEN '9:name=systemd:/init\n8:x:/y\n'
                      WHEN 1 THEN concat(cgroup_line, '\n5:net:/user.slice/u\n')
                      ELSE concat(cgroup_line, '\n5:net:/other\n') END""")
    return inputs.processes(t).select("pid", host.main_cgroup(text)["path"].alias("path"))


@query("parse_cmdline", "SELECT pid, cmdline FROM fx_processes")
def _(t: Tables):
    raw = F.concat(F.replace("cmdline", F.lit(" "), F.lit("\0")), F.lit("\0\0"))
    return inputs.processes(t).select("pid", host.parse_cmdline(raw).alias("cmdline"))


@query("parse_proc_stat", """
    SELECT pid, comm || ') (x' AS comm, 'S' AS state, ppid, CAST(pid * 100 AS DECIMAL(20, 0)) AS utime, pid % 8 AS processor
    FROM fx_processes""")
def _(t: Tables):
    raw = F.concat(
        F.col("pid"), F.lit(" ("), F.col("comm"), F.lit(") (x) S "), F.col("ppid"), F.lit(" 1 1 0 -1 4194560 5 0 0 0 "),
        F.col("pid") * 100, F.lit(" 3 0 0 20 0 7 0 99 1024 200 18446744073709551615 1 1 1 1 1 1 1 1 1 1 1 1 17 "),
        F.col("pid") % 8, F.lit(" 0 0 0 0 0\n"))
    return inputs.processes(t).select("pid", host.parse_proc_stat(raw).alias("s")).select(
        "pid", "s.comm", "s.state", "s.ppid", "s.utime", "s.processor")


@query("sanitize_label_name", """
    SELECT doc_id, regexp_replace(text, '[^a-zA-Z0-9_]', '_', 'g') AS name FROM documents""")
def _(t: Tables):
    return t.table("documents").select("doc_id", lab.sanitize_label_name(F.col("text")).alias("name"))


def pieces(t: Tables, size: int):
    """Whole texts cut into pieces of ``size`` bytes, wherever characters end."""
    raw = t.table("documents").select("doc_id", "lang", F.encode("text", "UTF-8").alias("b"))
    last = F.expr(f"(octet_length(b) - 1) div {size}")
    return raw.where(F.octet_length("b") > 0).select(
        "doc_id", "lang", "b", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("piece")).select(
        "doc_id", "lang", "piece", F.expr(f"substring(b, CAST(piece * {size} + 1 AS INT), {size})").alias("raw"))


# The same from the characters and their byte offsets: a piece has to start with a whole character and may
# lack the end of its last one, of which it then holds at most two bytes.
_PIECES = """
    WITH ch AS (SELECT doc_id, lang, unnest(string_split(text, '')) AS c, generate_subscripts(string_split(text, ''), 1) AS i
                FROM documents),
    e AS (SELECT *, sum(octet_length(encode(c))) OVER (PARTITION BY doc_id ORDER BY i) AS till FROM ch),
    p AS (SELECT *, till - octet_length(encode(c)) AS since FROM e),
    w AS (SELECT doc_id, lang, since // {size} AS piece, bool_or(since % {size} = 0) AS starts,
                 string_agg(c, '' ORDER BY i) FILTER (since // {size} = (till - 1) // {size}) AS whole,
                 coalesce(max({size} - since % {size}) FILTER (since // {size} < (till - 1) // {size}), 0) AS loose
          FROM p GROUP BY 1, 2, 3),
    fixed AS (SELECT doc_id, lang, piece, CASE WHEN starts AND loose <= 2 THEN whole END AS fixed FROM w)"""


@query("fix_utf8_truncation", _PIECES.replace("{size}", "48") + " SELECT doc_id, piece, fixed FROM fixed")
def _(t: Tables):
    return pieces(t, 48).select("doc_id", "piece", values.fix_utf8_truncation(F.col("raw"), 48).alias("fixed"))


@query("hex_id", "SELECT file_id, file_id AS again FROM fx_executables")
def _(t: Tables):
    return inputs.executables(t).select("file_id", values.hex_id(values.id_bytes(F.col("file_id"))).alias("again"))


@query("trim_nul", "SELECT pid, comm FROM fx_processes")
def _(t: Tables):
    return inputs.processes(t).select("pid", values.trim_nul(F.concat("comm", F.lit("\0rest\0"))).alias("comm"))


@query("build_id_or_hash", """
    SELECT file_id, CASE WHEN build_id = '' THEN file_id ELSE build_id END AS build_id,
           CASE WHEN build_id = '' THEN 'hash' ELSE 'gnu' END AS build_id_type FROM fx_executables""")
def _(t: Tables):
    return inputs.executables(t).select("file_id", values.build_id_or_hash(
        F.col("build_id"), F.col("file_id")).alias("b")).select("file_id", "b.*")


@query("probe_cookie", """
    SELECT event_id, (spec_id << 32) | (min_ms << 1) | CAST(main_only AS BIGINT) AS cookie, spec_id, min_ms, main_only
    FROM fx_edges""")
def _(t: Tables):
    cookie = values.probe_cookie(F.col("spec_id"), F.col("main_only"), F.col("min_ms"))
    return (t.fx("fx_edges").select("event_id", cookie.alias("cookie"))
            .withColumn("u", values.unpack_probe_cookie(F.col("cookie")))
            .select("event_id", "cookie", "u.spec_id", F.col("u.min_duration_ms").alias("min_ms"),
                    F.col("u.main_thread_only").alias("main_only")))


@query("metric_name", "SELECT metric_id, replace(field, '.', '_') AS metric FROM fx_metric_defs")
def _(t: Tables):
    return t.fx("fx_metric_defs").select("metric_id", values.metric_name(F.col("field")).alias("metric"))


@query("next_power_of_two", """
    SELECT o_orderkey, CASE WHEN o_orderkey <= 1 THEN 1 ELSE CAST(pow(2, ceil(log2(o_orderkey))) AS BIGINT) END AS p
    FROM orders""")
def _(t: Tables):
    return t.table("orders").select("o_orderkey", values.next_power_of_two(F.col("o_orderkey")).alias("p"))


@query("epoch_ms", """
    SELECT event_id, epoch_us(ts) // 1000 AS ts_ms, make_timestamp(epoch_us(ts)) AS ts FROM events""")
def _(t: Tables):
    ns = F.unix_micros(F.col("ts").cast("timestamp")) * 1000
    return t.table("events").select(
        "event_id", values.epoch_ms(F.col("ts").cast("timestamp")).alias("ts_ms"), values.ns_to_ts(ns).alias("ts"))


_PODS = r"""
    SELECT pod_name AS uid, pod_name AS name, namespace,
           map('app.kubernetes.io/name', app, 'tier', phase) AS labels, map('note/a', namespace) AS annotations,
           array(named_struct('kind', 'Node', 'name', 'n', 'controller', false),
                 named_struct('kind', 'ReplicaSet', 'name', app, 'controller', phase = 'Running')) AS owners,
           node_name, '10.0.0.1' AS pod_ip, '10.1.0.1' AS host_ip, phase,
           array(named_struct('type', 'Init', 'status', 'False'),
                 named_struct('type', CASE WHEN phase = 'Running' THEN 'Ready' ELSE 'Other' END, 'status', 'True')) AS conditions,
           array(named_struct('name', container_name, 'image', concat('img-', app))) AS containers,
           array(named_struct('name', 'setup', 'image', 'busybox')) AS init_containers,
           array(named_struct('container_id', raw_container_id, 'name', container_name),
                 named_struct('container_id', raw_container_id, 'name', 'no-spec')) AS container_statuses,
           array(named_struct('container_id', concat('cri-o://', md5(raw_container_id), md5(pod_name)), 'name', 'setup'))
             AS init_container_statuses
    FROM fx_containers"""


def pods(t: Tables):
    """Pods with one container, one init container, and one status that has no spec."""
    return t.sql(_PODS)


@query("pod_ready", """
    SELECT pod_name, CASE WHEN phase = 'Running' THEN 'true' ELSE 'unknown' END AS ready FROM fx_containers""")
def _(t: Tables):
    return pods(t).select(F.col("name").alias("pod_name"), host.pod_ready(F.col("conditions")).alias("ready"))


@query("controller_of", """
    SELECT pod_name, CASE WHEN phase = 'Running' THEN '__meta_kubernetes_pod_controller_kind=ReplicaSet,'
                          || '__meta_kubernetes_pod_controller_name=' || app ELSE '' END AS controller FROM fx_containers""")
def _(t: Tables):
    return pods(t).select(F.col("name").alias("pod_name"), lab.labels_string(
        host.controller_labels(F.col("owners"))).alias("controller"))


@query("containerd_parts", """
    SELECT pid, CASE WHEN cgroup_line LIKE '7:pids:%' THEN 'default' END AS namespace,
           CASE WHEN cgroup_line LIKE '7:pids:%' THEN 'ctr-' || CAST(pid AS VARCHAR) END AS id FROM fx_processes""")
def _(t: Tables):
    found = host.container_from_cgroup(F.col("cgroup_line"))
    part = F.when(found["env"] == host.ENV_CONTAINERD, host.containerd_parts(found["container_id"]))
    return inputs.processes(t).select("pid", part.alias("p")).select("pid", "p.*")


@query("container_name", "SELECT ctr_key, container_name FROM fx_containers")
def _(t: Tables):
    return t.fx("fx_containers").select("ctr_key", host.container_name(
        F.concat(F.lit("/"), "container_name")).alias("container_name"))


@query("labels_string", """
    SELECT pid, 'comm=' || comm || ',node=' || node || ',pid=' || CAST(pid AS VARCHAR) AS labels FROM fx_processes""")
def _(t: Tables):
    m = F.create_map(F.lit("pid"), F.col("pid").cast("string"), F.lit("node"), F.col("node"), F.lit("comm"), F.col("comm"))
    return inputs.processes(t).select("pid", lab.labels_string(m).alias("labels"))


@query("bool_label", """
    SELECT file_id, CASE WHEN is_static THEN 'true' ELSE 'false' END AS is_static,
           CASE WHEN stripped THEN 'true' ELSE 'false' END AS stripped FROM fx_executables""")
def _(t: Tables):
    return inputs.executables(t).select(
        "file_id", lab.bool_label(F.col("is_static")).alias("is_static"), lab.bool_label(F.col("stripped")).alias("stripped"))


# ---- metadata joins ---------------------------------------------------------------------------

# A process is seen again at each of its memory events; facts hold for ten minutes after that.
_SEEN = """
    WITH seen AS (SELECT node, pid, ts_ns AS observed_ns, comm || '-' || CAST(event_id AS VARCHAR) AS fact FROM fx_events
                  WHERE origin IN ('memory', 'off_cpu'))"""


@query("join_process_metadata", _SEEN + """
    SELECT e.event_id, e.node, e.pid, e.ts_ns, CASE WHEN e.ts_ns - s.observed_ns <= 21600000000000 THEN s.fact END AS fact
    FROM fx_events e ASOF LEFT JOIN seen s ON e.node = s.node AND e.pid = s.pid AND e.ts_ns >= s.observed_ns""")
def _(t: Tables):
    events = inputs.events(t)
    seen = events.where("origin IN ('memory', 'off_cpu')").select(
        "node", "pid", F.col("ts_ns").alias("observed_ns"),
        F.concat_ws("-", "comm", F.col("event_id").cast("string")).alias("fact"))
    return meta.join_process_metadata(
        events.select("event_id", "node", "pid", "ts_ns"), seen, ["fact"], 6 * 3600 * 10**9)


@query("join_main_executable", """
    SELECT p.pid, p.exe_file_id, coalesce(e.file_name, '') AS exe_name, coalesce(e.build_id, '') AS exe_build_id,
           coalesce(e.compiler, '') AS exe_compiler, coalesce(e.is_static, false) AS exe_static,
           coalesce(e.stripped, false) AS exe_stripped
    FROM fx_processes p LEFT JOIN fx_executables e ON p.exe_file_id = e.file_id""")
def _(t: Tables):
    return meta.join_main_executable(inputs.processes(t).select("pid", "exe_file_id"), inputs.executables(t))


def container_table(t: Tables):
    """Labels of Kubernetes and Docker containers and of containerd ones."""
    boxes = t.fx("fx_containers")
    kube = meta.pod_container_labels(pods(t))
    docker = meta.docker_container_labels(boxes.select(
        F.col("container_id").alias("id"), F.array(F.concat(F.lit("/"), "container_name")).alias("names"),
        F.create_map(F.lit("com.app"), F.col("app")).alias("labels")))
    ctrd = meta.containerd_container_labels(boxes.select(
        F.col("container_name").alias("id"), F.lit("default").alias("namespace"),
        F.create_map(F.lit("app"), F.col("app")).alias("labels")))
    # One row per container id: a Kubernetes pod explains a container better than Docker does.
    ranked = kube.withColumn("r", F.lit(0)).unionByName(docker.withColumn("r", F.lit(1))).unionByName(
        ctrd.withColumn("r", F.lit(2)))
    return ranked.groupBy("container_id").agg(F.min_by("container_labels", "r").alias("container_labels"))


def host_containers(t: Tables):
    """Labels of Docker and containerd containers, some of them listed twice."""
    boxes = t.fx("fx_containers")
    docker = meta.docker_container_labels(boxes.select(
        F.col("container_id").alias("id"), F.array(F.concat(F.lit("/"), "container_name")).alias("names"),
        F.create_map(F.lit("com.app"), F.col("app")).alias("labels")))
    ctrd = meta.containerd_container_labels(boxes.select(
        F.col("container_name").alias("id"), F.lit("default").alias("namespace"),
        F.create_map(F.lit("app"), F.col("app")).alias("labels")))
    return docker.unionByName(ctrd).unionByName(ctrd)


@query("join_container", rf"""
    WITH env AS ({_CGROUP_SQL}), p AS (SELECT pid, cgroup_line FROM fx_processes)
    SELECT p.pid, env.container_id, env.env AS container_env,
           CASE WHEN env.env = 32 THEN '__meta_docker_build_kit_container_id=' || env.container_id
                WHEN env.env = 8 THEN '__meta_lxc_container_id=' || env.container_id
                WHEN env.env = 16 THEN '__meta_containerd_container_id=ctr-' || CAST(p.pid AS VARCHAR)
                     || ',__meta_containerd_container_label_app=' || c.app || ',__meta_containerd_container_labelpresent_app=true'
                     || ',__meta_containerd_container_name=ctr-' || CAST(p.pid AS VARCHAR) || ',__meta_containerd_pod_name=default'
                WHEN env.env IN (2, 4) THEN '__meta_docker_container_id=' || c.container_id
                     || ',__meta_docker_container_label_com_app=' || c.app || ',__meta_docker_container_labelpresent_com_app=true'
                     || ',__meta_docker_container_name=' || c.container_name
                ELSE '' END AS container_labels
    FROM p JOIN env ON p.pid = env.pid LEFT JOIN fx_containers c ON c.ctr_key = p.pid""")
def _(t: Tables):
    joined = meta.join_container(inputs.processes(t).select("pid", "cgroup_line"), host_containers(t))
    return joined.select("pid", "container_id", "container_env", lab.labels_string(
        F.col("container_labels")).alias("container_labels"))


_POD_LABELS = r"""
    WITH c AS (SELECT *, regexp_extract(raw_container_id, '^(?:.+://)?([0-9a-f]{64})$', 1) AS good FROM fx_containers),
    r AS (SELECT good AS container_id, 'false' AS init, container_name AS cname, 'img-' || app AS image, c.* EXCLUDE (container_id)
          FROM c WHERE good <> ''
          UNION ALL
          SELECT md5(raw_container_id) || md5(pod_name), 'true', 'setup', 'busybox', c.* EXCLUDE (container_id) FROM c)
    SELECT container_id,
           '__meta_kubernetes_namespace=' || namespace
           || CASE WHEN {nodes} THEN ',__meta_kubernetes_node_annotation_zone=z' || substr(node_name, 6) || ','
                || '__meta_kubernetes_node_annotationpresent_zone=true,__meta_kubernetes_node_label_arch=amd64,'
                || '__meta_kubernetes_node_labelpresent_arch=true,__meta_kubernetes_node_name=' || node_name ELSE '' END AS head,
           '__meta_kubernetes_pod_annotation_note_a=' || namespace || ',__meta_kubernetes_pod_annotationpresent_note_a=true,'
           || '__meta_kubernetes_pod_container_id=' || container_id || ',__meta_kubernetes_pod_container_image=' || image
           || ',__meta_kubernetes_pod_container_init=' || init || ',__meta_kubernetes_pod_container_name=' || cname
           || CASE WHEN phase = 'Running' THEN ',__meta_kubernetes_pod_controller_kind=ReplicaSet,'
              || '__meta_kubernetes_pod_controller_name=' || app ELSE '' END
           || ',__meta_kubernetes_pod_host_ip=10.1.0.1,__meta_kubernetes_pod_ip=10.0.0.1,'
           || '__meta_kubernetes_pod_label_app_kubernetes_io_name=' || app || ',__meta_kubernetes_pod_label_tier=' || phase
           || ',__meta_kubernetes_pod_labelpresent_app_kubernetes_io_name=true,__meta_kubernetes_pod_labelpresent_tier=true'
           || ',__meta_kubernetes_pod_name=' || pod_name || ',__meta_kubernetes_pod_node_name=' || node_name
           || ',__meta_kubernetes_pod_phase=' || phase || ',__meta_kubernetes_pod_ready='
           || CASE WHEN phase = 'Running' THEN 'true' ELSE 'unknown' END || ',__meta_kubernetes_pod_uid=' || pod_name AS tail
    FROM r"""


@query("pod_container_labels", f"SELECT container_id, head || ',' || tail AS labels FROM ("
                               f"{_POD_LABELS.replace('{nodes}', 'true')})")
def _(t: Tables):
    nodes = t.sql("""SELECT concat('NODE_', CAST(n_nationkey AS STRING)) AS name, map('arch', 'amd64') AS labels,
                            map('zone', concat('z', CAST(n_nationkey AS STRING))) AS annotations FROM nation""")
    return meta.pod_container_labels(pods(t), nodes).select(
        "container_id", lab.labels_string(F.col("container_labels")).alias("labels"))


@query("read_dimensions", f"SELECT container_id, head || ',' || tail AS labels FROM ("
                          f"{_POD_LABELS.replace('{nodes}', 'false')})")
def _(t: Tables):
    from stackloom.session import shared_dir
    from stackloom.sources.tables import read_dimensions

    path = shared_dir(t.spark, "pods")
    pods(t).select(F.to_json(F.struct("*")).alias("object")).write.parquet(path)
    dims = read_dimensions(t.spark, {"pods": path})
    return meta.pod_container_labels(dims["pods"]).select(
        "container_id", lab.labels_string(F.col("container_labels")).alias("labels"))


@query("cri_pods", """
    SELECT 'sb-' || CAST(o.o_custkey AS VARCHAR) AS sandbox_id,
           CASE WHEN o.o_custkey % 4 = 0 THEN 'host-' || CAST(o.o_custkey AS VARCHAR) ELSE 'me' END AS node_name,
           count(*) AS n_containers, string_agg('c' || CAST(o_orderkey AS VARCHAR) || ':img' || CAST(o_orderkey % 9 AS VARCHAR), ','
                                                ORDER BY 'id-' || CAST(o_orderkey AS VARCHAR)) AS specs
    FROM orders o GROUP BY o.o_custkey
    UNION ALL
    SELECT 'sb-' || CAST(c_custkey AS VARCHAR), CASE WHEN c_custkey % 4 = 0 THEN 'host-' || CAST(c_custkey AS VARCHAR) ELSE 'me' END,
           0, '' FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)""")
def _(t: Tables):
    sandboxes = t.sql("""
        SELECT concat('sb-', CAST(c_custkey AS STRING)) AS sandbox_id, c_name AS name, 'ns' AS namespace, c_name AS uid,
               CASE WHEN c_custkey % 4 = 0 THEN map('io.kubernetes.pod.nodename', concat('host-', CAST(c_custkey AS STRING)))
                    ELSE map('a', 'b') END AS labels, CAST(map() AS map<string,string>) AS annotations FROM customer""")
    containers = t.sql("""
        SELECT concat('sb-', CAST(o_custkey AS STRING)) AS sandbox_id, concat('id-', CAST(o_orderkey AS STRING)) AS container_id,
               concat('c', CAST(o_orderkey AS STRING)) AS name, concat('img', CAST(o_orderkey % 9 AS STRING)) AS image,
               'ref' AS image_ref FROM orders""")
    return meta.cri_pods(sandboxes, containers, "me").select(
        "sandbox_id", "node_name", F.size("container_statuses").cast("long").alias("n_containers"),
        F.array_join(F.transform("containers", lambda c: F.concat(c["name"], F.lit(":"), c["image"])), ",").alias("specs"))


# ---- label sets and rules ---------------------------------------------------------------------


@query("merge_label_sets", """
    SELECT pid, 'a=' || comm || CASE WHEN pid % 3 = 0 THEN '' ELSE ',b=' || CAST(pid AS VARCHAR) END || ',c=' || node AS labels
    FROM fx_processes""")
def _(t: Tables):
    first = F.create_map(F.lit("a"), F.lit("old"), F.lit("c"), F.col("node"), F.lit("b"), F.lit("x"))
    second = F.create_map(F.lit("a"), F.col("comm"), F.lit("b"), F.expr("CASE WHEN pid % 3 = 0 THEN '' ELSE CAST(pid AS STRING) END"))
    return inputs.processes(t).select("pid", lab.labels_string(meta.merge_label_sets(first, second)).alias("labels"))


_RULED = """
    SELECT p.pid, 'compiler=' || e.compiler || ',exec=' || e.file_name AS exe,
           'node=' || p.node || ',part='
           || CAST(CAST('0x' || substr(md5(p.cmdline), 17, 16) AS UBIGINT) % 8 AS VARCHAR)
           || ',proc_pid=' || CAST(p.pid AS VARCHAR) || ',proc_ppid=' || CAST(p.ppid AS VARCHAR)
           || ',shard=s' || substr(p.node, 6) AS own
    FROM fx_processes p LEFT JOIN fx_executables e ON p.exe_file_id = e.file_id WHERE p.comm <> 'furniture'"""


def _providers(t: Tables):
    return [meta.process_provider, meta.executable_provider(inputs.executables(t)), meta.agent_provider("rev1")]


@query("relabel", f"SELECT pid, CASE WHEN exe IS NULL THEN '' ELSE exe || ',' END || own AS labels FROM ({_RULED})")
def _(t: Tables):
    rules = rel.load_relabel_rules(inputs.RELABEL_YAML)
    ruled = rel.filter_kept(meta.process_labels(inputs.processes(t), _providers(t), rules))
    return ruled.select("pid", lab.labels_string(F.col("labels")).alias("labels"))


@query("load_relabel_rules", f"""
    SELECT CASE WHEN exe IS NULL THEN '' ELSE split_part(exe, ',', 1) END AS compiler, count(*) AS processes
    FROM ({_RULED}) GROUP BY 1""")
def _(t: Tables):
    rules = rel.load_relabel_rules(inputs.RELABEL_YAML)
    ruled = rel.filter_kept(meta.process_labels(inputs.processes(t), _providers(t), rules))
    compiler = F.coalesce(F.concat(F.lit("compiler="), F.col("labels")["compiler"]), F.lit(""))
    return ruled.groupBy(compiler.alias("compiler")).agg(F.count(F.lit(1)).alias("processes"))


_ACTIONS_YAML = """
relabel_configs:
- {source_labels: [comm], target_label: loud, action: uppercase}
- {source_labels: [NODE], target_label: quiet, action: lowercase}
- {source_labels: [comm, NODE], separator: '@', regex: '(.+)@NODE_(?P<n>\\d+)', target_label: 'x_${n}', replacement: '$1-$$-${n}-$missing'}
- {source_labels: [loud], regex: 'MACH.*', target_label: comm, replacement: ''}
- {source_labels: [pid_text], target_label: ppid_text, action: dropequal}
- {source_labels: [same], target_label: comm_copy, action: keepequal}
- {regex: 'loud|quiet|x_.*|comm', action: labelkeep}
"""


@query("relabel_actions", """
    SELECT pid, CASE WHEN upper(comm) LIKE 'MACH%' THEN '' ELSE 'comm=' || comm || ',' END || 'loud=' || upper(comm)
           || ',quiet=' || lower(node) || ',x_' || substr(node, 6) || '=' || comm || '-$-' || substr(node, 6) || '-' AS labels
    FROM fx_processes WHERE pid <> ppid""")
def _(t: Tables):
    start = F.create_map(
        F.lit("comm"), F.col("comm"), F.lit("NODE"), F.col("node"), F.lit("pid_text"), F.col("pid").cast("string"),
        F.lit("ppid_text"), F.col("ppid").cast("string"), F.lit("same"), F.col("comm"), F.lit("comm_copy"), F.col("comm"))
    ruled = rel.relabel(inputs.processes(t).withColumn("labels", start), rel.load_relabel_rules(_ACTIONS_YAML))
    return rel.filter_kept(ruled).select("pid", lab.labels_string(F.col("labels")).alias("labels"))


@query("filter_kept", "SELECT pid, comm FROM fx_processes WHERE comm NOT LIKE 'm%'")
def _(t: Tables):
    rule = rel.RelabelRule(action="drop", source_labels=["comm"], regex="m.*")
    rows = inputs.processes(t).withColumn("labels", F.create_map(F.lit("comm"), F.col("comm")))
    return rel.filter_kept(rel.relabel(rows, [rule])).select("pid", "comm")


_LABELLED = f"""
    WITH ruled AS ({_RULED})
    SELECT e.event_id, e.ts_ns, e.node, e.pid, e.cpu, e.tid, e.comm, r.pid IS NOT NULL AND fresh AS known, CASE WHEN r.pid IS NOT NULL AND fresh THEN
             CASE WHEN exe IS NULL THEN '' ELSE exe || ',' END || own ELSE 'node=' || e.node || ',part='
             || CAST(CAST('0x' || substr(md5(''), 17, 16) AS UBIGINT) % 8 AS VARCHAR) || ',proc_pid=' || CAST(e.pid AS VARCHAR)
             || ',shard=s' || substr(e.node, 6) END AS process_labels
    FROM (SELECT *, ts_ns - 1704067200000000000 <= 864000000000000 AS fresh FROM fx_events) e
    LEFT JOIN ruled r ON r.pid = e.pid
    WHERE NOT fresh OR e.pid NOT IN (SELECT pid FROM fx_processes WHERE comm = 'furniture')"""


@query("label_samples", f"""
    SELECT event_id, process_labels, 'cpu=' || CAST(cpu AS VARCHAR) || ',thread_id=' || CAST(tid AS VARCHAR) || ',thread_name='
           || comm AS thread_labels, CASE WHEN known AND env IN (2, 4, 16) THEN 'ctr-' || CAST(pid AS VARCHAR) END AS container
    FROM ({_LABELLED}) LEFT JOIN ({_CGROUP_SQL}) c USING (pid)""")
def _(t: Tables):
    named = rel.RelabelRule(source_labels=["__meta_docker_container_name", "__meta_containerd_container_name"], separator="",
                            regex="(.+)", target_label="container")
    rules = [*rel.load_relabel_rules(inputs.RELABEL_YAML), named]
    labelled = meta.label_samples(
        inputs.events(t).select("event_id", "ts_ns", "node", "pid", "tid", "cpu", "comm", "origin"),
        inputs.processes(t), [*_providers(t), meta.container_provider(host_containers(t))], rules, ttl=10 * 86_400 * 10**9,
        width=24 * 3600 * 10**9)
    thread = ["cpu", "thread_id", "thread_name"]
    return labelled.select(
        "event_id", F.col("labels")["container"].alias("container"),
        lab.labels_string(F.map_filter("labels", lambda k, _: ~k.isin(*thread, "container"))).alias("process_labels"),
        lab.labels_string(F.map_filter("labels", lambda k, _: k.isin(thread))).alias("thread_labels"))


@query("patch_thread_labels", """
    SELECT event_id, 'cpu=' || CAST(cpu AS VARCHAR) || ',node=' || node || ',thread_name=' || comm AS labels FROM fx_events""")
def _(t: Tables):
    rows = inputs.events(t).withColumn("labels", F.create_map(F.lit("node"), F.col("node"), F.lit("cpu"), F.lit("old")))
    return meta.patch_thread_labels(rows, thread_id=False).select(
        "event_id", lab.labels_string(F.col("labels")).alias("labels"))


@query("drop_meta_labels", "SELECT pid, 'comm=' || comm AS labels FROM fx_processes")
def _(t: Tables):
    m = F.create_map(F.lit("__meta_pid"), F.col("pid").cast("string"), F.lit("comm"), F.col("comm"))
    return inputs.processes(t).select("pid", lab.labels_string(lab.drop_prefix(m)).alias("labels"))


@query("relabel_probe_samples", """
    SELECT event_id, 'cpu=' || CAST(cpu AS VARCHAR) || CASE WHEN origin = 'unknown' THEN ',main=' || comm ELSE '' END
           || ',thread_name=' || comm AS labels
    FROM fx_events WHERE NOT (origin = 'unknown' AND cpu = 5)""")
def _(t: Tables):
    rules = [rel.RelabelRule(source_labels=["thread_name"], target_label="main"),
             rel.RelabelRule(action="drop", source_labels=["cpu"], regex="5")]
    rows = inputs.events(t).withColumn("origin", F.expr("CASE WHEN origin = 'unknown' THEN 'probe' ELSE origin END"))
    start = rows.withColumn("labels", lab.empty_labels())
    patched = meta.patch_thread_labels(start, thread_id=False)
    return meta.relabel_probe_samples(patched, rules).select(
        "event_id", lab.labels_string(F.col("labels")).alias("labels"))


@query("external_labels", """
    SELECT event_id, 'node=' || node || ',region=' || CASE WHEN cpu = 0 THEN 'own' ELSE 'eu' END || ',team=perf' AS labels
    FROM fx_events""")
def _(t: Tables):
    own = F.expr("CASE WHEN cpu = 0 THEN map('node', node, 'region', 'own') ELSE map('node', node) END")
    rows = inputs.events(t).withColumn("labels", own)
    return meta.external_labels(rows, {"region": "eu", "team": "perf"}).select(
        "event_id", lab.labels_string(F.col("labels")).alias("labels"))


@query("labels_wide", """
    SELECT event_id, CASE WHEN cpu = 0 THEN 'zero' END AS "labels.cpu_zero", node AS "labels.node" FROM fx_events""")
def _(t: Tables):
    own = F.expr("CASE WHEN cpu = 0 THEN map('node', node, 'cpu_zero', 'zero') ELSE map('node', node) END")
    return records.labels_wide(inputs.events(t).select("event_id", own.alias("labels")))


@query("custom_labels", _PIECES.replace("{size}", "47") + " SELECT doc_id, piece, coalesce(fixed, lang) AS value FROM fixed")
def _(t: Tables):
    named = F.create_map(F.encode(F.lit("lang"), "UTF-8"), F.col("raw"),
                         F.lit(bytearray(b"\xff\xfe")), F.encode(F.lit("bad name"), "UTF-8"))
    rows = pieces(t, 47).select("doc_id", "piece", F.create_map(F.lit("lang"), F.col("lang")).alias("labels"),
                                named.alias("custom_labels"))
    return meta.custom_labels(rows).select("doc_id", "piece", F.col("labels")["lang"].alias("value"))


@query("env_labels", """
    SELECT pid, '__meta_env_var_APP=' || comm || ',__meta_env_var_ID=' || CAST(pid AS VARCHAR) AS labels FROM fx_processes""")
def _(t: Tables):
    env = F.create_map(F.lit("ID"), F.col("pid").cast("string"), F.lit("SECRET"), F.lit("x"), F.lit("APP"), F.col("comm"))
    return inputs.processes(t).select("pid", lab.labels_string(meta.env_labels(env, ["APP", "ID"])).alias("labels"))


@query("system_labels", """
    SELECT p.pid, '__meta_agent_revision=rev1,__meta_system_kernel_machine=' || CASE WHEN n.n_nationkey % 2 = 0 THEN 'x86_64'
           ELSE 'aarch64' END || ',__meta_system_kernel_release=5.' || CAST(n.n_nationkey AS VARCHAR) AS labels
    FROM fx_processes p JOIN nation n ON p.node = 'NODE_' || CAST(n.n_nationkey AS VARCHAR)""")
def _(t: Tables):
    nodes = t.sql("""SELECT concat('NODE_', CAST(n_nationkey AS STRING)) AS node,
                            CASE WHEN n_nationkey % 2 = 0 THEN 'x86_64' ELSE 'aarch64' END AS machine,
                            concat('5.', CAST(n_nationkey AS STRING)) AS release FROM nation""")
    rows = inputs.processes(t).withColumn("labels", lab.empty_labels())
    return meta.system_labels(nodes)(meta.agent_provider("rev1")(rows)).select(
        "pid", lab.labels_string(F.col("labels")).alias("labels"))


@query("union_batches", """
    SELECT event_id, CASE WHEN origin IN ('cuda', 'gpu_pc') THEN node END AS "labels.gpu_node",
           CASE WHEN origin IN ('sampling', 'off_cpu') THEN comm END AS "labels.name",
           CASE WHEN origin IN ('memory', 'unknown') THEN CAST(pid AS VARCHAR) END AS "labels.pid" FROM fx_events""")
def _(t: Tables):
    events = inputs.events(t)
    gpu = events.where("origin IN ('cuda', 'gpu_pc')").select("event_id", F.col("node").alias("labels.gpu_node"))
    cpu = events.where("origin IN ('sampling', 'off_cpu')").select("event_id", F.col("comm").alias("labels.name"))
    rest = events.where("origin IN ('memory', 'unknown')").select("event_id", F.col("pid").cast("string").alias("labels.pid"))
    return records.union_batches([gpu, cpu, rest])
