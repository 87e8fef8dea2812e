"""From trace events to samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stackloom.functions.values import wrapping_minus
from stackloom.schema import (
    CUDA, GPU_PC, MEMORY, MEMORY_PERIOD, OFF_CPU, PRODUCER, SAMPLES_PER_SECOND, SAMPLING, SECOND_NS,
)

_LONG_FIELDS = ("value", "duration", "period")


def _sample(value: Column, duration: int, period: Column | int, producer: str, kind: tuple[str, str, str, str],
            temporality: str | None = "delta", gpu_view: str | None = None) -> Column:
    sample_type, sample_unit, period_type, period_unit = kind
    text = {
        "sample_type": sample_type, "sample_unit": sample_unit, "period_type": period_type,
        "period_unit": period_unit, "producer": producer, "temporality": temporality, "gpu_view": gpu_view,
    }
    numbers = {"value": value, "duration": F.lit(duration),
               "period": F.lit(period) if isinstance(period, int) else period}
    return F.struct(
        *[numbers[name].cast("long").alias(name) for name in _LONG_FIELDS],
        *[F.lit(v).cast("string").alias(name) for name, v in text.items()])


def offcpu_period(schema_version: str, samples_per_second: int) -> int:
    """The period of off-CPU samples: the sampling period in v1 records, zero in v2 records."""
    return SECOND_NS // samples_per_second if schema_version == "v1" else 0


def memory_sample_rows(mem: Column, report_allocs: bool) -> Column:
    """Zero to four samples of one memory record; differences wrap in 64 bits."""
    def entry(value: Column, name: str, unit: str) -> Column:
        return _sample(value, 0, MEMORY_PERIOD, "memory", (name, unit, "space", "bytes"), None)

    rows = [
        F.when(mem["allocs"] != mem["frees"],
               entry(wrapping_minus(mem["allocs"], mem["frees"]), "inuse_objects", "count")),
        F.when(mem["alloc_bytes"] != mem["free_bytes"],
               entry(wrapping_minus(mem["alloc_bytes"], mem["free_bytes"]), "inuse_space", "bytes")),
    ]
    if report_allocs:
        rows += [entry(mem["allocs"], "alloc_objects", "count"), entry(mem["alloc_bytes"], "alloc_space", "bytes")]
    return F.filter(F.array(*rows), lambda x: x.isNotNull())


def normalize_samples(
    events: DataFrame, *, schema_version: str = "v2", samples_per_second: int = SAMPLES_PER_SECOND,
    report_allocs: bool = False, merge_gpu: bool = False, producer: str = PRODUCER,
) -> DataFrame:
    """One event becomes zero to four samples, by origin; unknown origins give none.

    Reads ``origin, raw_value``, ``mem`` for memory events and ``ns_per_sample`` for GPU program-counter
    events (absent or NULL counts as not known yet). The origins are filtered first, which reaches the scan.
    """
    events = events.where(F.col("origin").isin(SAMPLING, OFF_CPU, MEMORY, CUDA, GPU_PC))
    raw = F.col("raw_value").cast("long")
    ns = (F.coalesce(F.col("ns_per_sample"), F.lit(0)) if "ns_per_sample" in events.columns else F.lit(0)).cast("long")
    # Names and units of the sample and period types, as stores expect them.
    cpu = _sample(F.lit(1), SECOND_NS, SECOND_NS // samples_per_second, producer,
                  ("samples", "count", "cpu", "nanoseconds"))
    wall = _sample(raw, SECOND_NS, offcpu_period(schema_version, samples_per_second), producer,
                   ("wallclock", "nanoseconds", "samples", "count"))
    if merge_gpu:
        merged = ("gpu_time", "nanoseconds", "gpu_time", "nanoseconds")
        kernel = _sample(raw, SECOND_NS, 1, producer, merged, gpu_view="kernel_time")
        pc = _sample(F.when(ns > 0, raw * ns).otherwise(raw), SECOND_NS, 1, producer, merged, gpu_view="pc_sample")
    else:
        kernel = _sample(raw, SECOND_NS, 1, producer,
                         ("gpu_kernel_time", "nanoseconds", "gpu_kernel_time", "nanoseconds"))
        pc = _sample(raw, SECOND_NS, ns, producer, ("gpu_pcsample", "count", "gpu_pcsample", "nanoseconds"))
    origin = F.col("origin")
    rows = (F.when(origin == SAMPLING, F.array(cpu)).when(origin == OFF_CPU, F.array(wall))
            .when(origin == CUDA, F.array(kernel)).when(origin == GPU_PC, F.array(pc)))
    if "mem" in events.columns:
        rows = rows.when((origin == MEMORY) & F.col("mem").isNotNull(), memory_sample_rows(F.col("mem"), report_allocs))
    else:  # such events must not vanish: the first one stops the job
        rows = rows.when(origin == MEMORY, F.array(F.raise_error(F.lit("memory events need a mem column"))))
    kept = [c for c in events.columns if c not in ("raw_value", "mem", "ns_per_sample", "labels")]
    out = events.withColumn("_sample", F.explode(rows))
    columns = [F.col(c) for c in kept]
    if "labels" in events.columns:
        view = F.col("_sample.gpu_view")
        columns.append((F.when(view.isNotNull(), F.map_concat(
            F.map_filter("labels", lambda k, _: k != "gpu_view"), F.create_map(F.lit("gpu_view"), view)))
            .otherwise(F.col("labels")) if merge_gpu else F.col("labels")).alias("labels"))
    elif merge_gpu:
        columns.append(F.col("_sample.gpu_view").alias("gpu_view"))
    fields = ["value", "sample_type", "sample_unit", "period_type", "period_unit", "producer", "temporality",
              "period", "duration"]
    return out.select(*columns, *[F.col(f"_sample.{f}").alias(f) for f in fields])


def memory_samples(events: DataFrame, report_allocs: bool = False) -> DataFrame:
    return normalize_samples(events.where(F.col("origin") == MEMORY), report_allocs=report_allocs)


def gpu_samples(events: DataFrame, merge: bool = False, producer: str = PRODUCER) -> DataFrame:
    return normalize_samples(events.where(F.col("origin").isin(CUDA, GPU_PC)), merge_gpu=merge, producer=producer)


def empty_stacks(events: DataFrame) -> DataFrame:
    """Events without frames. They stay in the data; this selects them for counting."""
    return events.where(F.coalesce(F.size("frames"), F.lit(0)) <= 0)


def oom_events(profiles: DataFrame) -> DataFrame:
    """Memory events of a crash profile: addresses become frames that carry build id and executable path.

    Reads ``ts_ns, node, pid, comm, build_id, executable_path, mem, addresses``.
    """
    frames = F.transform("addresses", lambda a: F.struct(
        F.lit("oomprof").alias("frame_type"), a.alias("address"),
        F.lit(None).cast("string").alias("file_id"), F.lit(None).cast("string").alias("gnu_build_id"),
        F.lit(None).cast("string").alias("mapping_file_name"),
        F.col("build_id").alias("function_name"), F.col("executable_path").alias("source_file"),
        F.lit(0).cast("long").alias("source_line"), F.lit(0).cast("long").alias("source_column")))
    return profiles.select(
        "ts_ns", "node", "pid", F.col("pid").alias("tid"), "comm", F.lit(MEMORY).alias("origin"), "mem",
        F.lit(0).cast("long").alias("raw_value"), frames.alias("frames"))
