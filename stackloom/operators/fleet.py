"""Hosts of the fleet: heartbeats, summaries, capacity; logs; debug information still to fetch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stackloom.functions.values import build_id_or_hash, epoch_ms, next_power_of_two
from stackloom.schema import SAMPLES_PER_SECOND, SECOND_NS

# Label names of the info series, and the sizing constants.
INFO_LABELS = ["machine_id", "arch", "version", "kernel_version", "kernel_osrelease", "os_name", "os_vendor",
               "os_version", "os_release", "is_container"]
TRACE_CACHE_INTERVALS, TRACE_CACHE_MIN = 6, 65536


def heartbeat_series(beats: DataFrame, prefix: str = "agent") -> DataFrame:
    """``name, labels, ts_ms, value``: an info series of value 1 and the number of cores, per heartbeat."""
    info = F.create_map(*[x for n in INFO_LABELS for x in (F.lit(n), F.col(n).cast("string"))])
    machine = F.create_map(F.lit("machine_id"), F.col("machine_id").cast("string"))
    series = F.array(
        F.struct(F.lit(f"{prefix}_info").alias("name"), info.alias("labels"), F.lit(1).cast("long").alias("value")),
        F.struct(F.lit(f"{prefix}_cpu_cores").alias("name"), machine.alias("labels"),
                 F.col("cpu_cores").cast("long").alias("value")))
    return beats.select(epoch_ms(F.col("ts")).alias("ts_ms"), F.explode(series).alias("s")).select(
        "s.name", "s.labels", "ts_ms", "s.value")


def fleet_summary(beats: DataFrame, by: list[str]) -> DataFrame:
    """Machines and cores by any set of host attributes, each machine with its latest heartbeat."""
    latest = beats.groupBy("machine_id").agg(
        F.max_by(F.struct(*by, "cpu_cores"), "ts").alias("h"), F.count(F.lit(1)).alias("n"))
    return latest.groupBy(*[F.col(f"h.{c}").alias(c) for c in by]).agg(
        F.count(F.lit(1)).alias("machines"), F.sum("h.cpu_cores").alias("cpu_cores"), F.sum("n").alias("heartbeats"))


def capacity_estimate(hosts: DataFrame, seconds: int = 5, samples_per_second: int = SAMPLES_PER_SECOND) -> DataFrame:
    """Rows per report interval and size of the trace cache from the number of cores."""
    rows = F.lit(samples_per_second * seconds).cast("long") * F.col("cpu_cores")
    size = F.greatest(rows * TRACE_CACHE_INTERVALS, F.lit(TRACE_CACHE_MIN).cast("long"))
    return hosts.withColumn("max_rows_per_batch", rows).withColumn("trace_cache_size", next_power_of_two(size))


def oom_profile_series(profiles: DataFrame, external: dict[str, str]) -> DataFrame:
    """Series labels of a crash profile; the profile itself stays as it is. No rules apply."""
    own = F.create_map(
        F.lit("job"), F.lit("oomprof"), F.lit("node"), F.col("node"), F.lit("__name__"), F.lit("memory"),
        F.lit("pid"), F.col("pid").cast("string"), F.lit("comm"), F.col("comm"))
    fixed = {k: v for k, v in external.items() if k not in ("job", "node", "__name__", "pid", "comm")}
    labels = F.map_concat(F.create_map(*[F.lit(x) for pair in fixed.items() for x in pair]), own) if fixed else own
    return profiles.select(labels.alias("labels"), "raw_profile")


# Severity of a log level.
SEVERITY = {"trace": "trace", "debug": "debug", "info": "info", "warning": "warn", "error": "error",
            "fatal": "fatal", "panic": "fatal"}


def log_severity(level: Column) -> Column:
    out = F.lit("undefined")
    for name, severity in SEVERITY.items():
        out = F.when(F.lower(level) == name, F.lit(severity)).otherwise(out)
    return out


def log_records(logs: DataFrame, skip_tag: str = "otlp_skip") -> DataFrame:
    """Log rows as records: rows with the skip tag are dropped, the level is always an attribute.

    ``fields`` maps a name to ``struct<int_value:bigint, bool_value:boolean, string_value:string>``;
    integers stay integers, everything else becomes text.
    """
    skipped = F.coalesce(F.try_element_at("fields", F.lit(skip_tag))["bool_value"], F.lit(False))
    level = F.upper("level")

    def attribute(number: Column, text: Column) -> Column:
        return F.struct(number.cast("long").alias("int_value"), text.cast("string").alias("string_value"))

    fields = F.map_filter("fields", lambda k, _: (k != skip_tag) & (k != "level"))
    attributes = F.map_concat(
        F.create_map(F.lit("level"), attribute(F.lit(None), level)),
        F.transform_values(fields, lambda _, v: attribute(
            v["int_value"], F.when(v["int_value"].isNull(), F.coalesce(v["string_value"], v["bool_value"].cast("string"))))))
    extra = [c for c in logs.columns if c not in ("level", "message", "fields")]
    return logs.where(~skipped).select(
        *extra, F.col("message").alias("body"), log_severity(F.col("level")).alias("severity"),
        level.alias("severity_text"), attributes.alias("attributes"))


# Fixed value: how long a refused upload waits.
UPLOAD_RETRY_NS = 300 * SECOND_NS


def debuginfo_worklist(executables: DataFrame, status: DataFrame, now_ns: int) -> DataFrame:
    """Files whose debug information is still to be uploaded, each once.

    ``status`` holds ``file_id, state, attempted_ns``. Uploaded files and those marked final are left out;
    a file somebody else is uploading comes back after five minutes.
    """
    retry = (F.col("state") == "in_progress") & (F.col("attempted_ns") + F.lit(UPLOAD_RETRY_NS) <= F.lit(now_ns))
    blocked = status.where(~retry).select("file_id").distinct()
    files = executables.groupBy("file_id").agg(F.min("file_name").alias("file_name"), F.max("build_id").alias("build_id"))
    return files.join(blocked, "file_id", "left_anti").select(
        "file_id", "file_name", build_id_or_hash(F.col("build_id"), F.col("file_id")).alias("_id")).select(
        "file_id", "file_name", "_id.*")
