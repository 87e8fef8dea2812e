"""GPU timing, configuration and program-counter samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stackloom.functions.values import int_div, trim_nul
from stackloom.operators.sequence import HOUR_NS, asof_join
from stackloom.schema import CUDA, SECOND_NS

# One launch of one process on one machine: process ids and correlation ids repeat over machines.
LAUNCH = ("node", "pid", "correlation_id")
PROCESS = ("node", "pid")


def ns_per_sample(sampling_factor: Column, clock_hz: Column) -> Column:
    """Nanoseconds one program-counter sample stands for: 2^factor clock cycles."""
    cycles = F.call_function("shiftleft", F.lit(1).cast("long"), sampling_factor.cast("int"))
    return F.coalesce(int_div(cycles * F.lit(SECOND_NS), clock_hz), F.lit(0)).cast("long")


def gpu_ns_per_sample(samples: DataFrame, configs: DataFrame, keys: list[str], width: int = HOUR_NS) -> DataFrame:
    """Samples with ``ns_per_sample`` of the latest GPU configuration of their process; 0 before the first."""
    dim = configs.select(*keys, F.col("ts_ns").alias("config_ns"),
                         ns_per_sample(F.col("sampling_factor"), F.col("clock_hz")).alias("ns_per_sample"))
    joined = asof_join(samples, dim, keys, "ts_ns", "config_ns", ["ns_per_sample"], None, width)
    return joined.withColumn("ns_per_sample", F.coalesce("ns_per_sample", F.lit(0)))


def gpu_kernel_times(launches: DataFrame, timings: DataFrame, keys: list[str] = LAUNCH) -> DataFrame:
    """CUDA launches with the duration of the kernels they started; either side may come first.

    A graph launch has many kernels and gives a row for each. The key is a single launch, so no key is hot.
    """
    kernels = timings.select(*keys, F.col("kernel_name"), F.col("duration_ns").alias("raw_value"))
    return launches.drop("raw_value").join(kernels, list(keys), "inner").withColumn("origin", F.lit(CUDA))


def gpu_unmatched(launches: DataFrame, timings: DataFrame, keys: list[str] = LAUNCH) -> DataFrame:
    """How many launches and timing events found no partner, the ones a running agent clears in the end."""
    on = list(keys)
    lost_launches = launches.join(timings.select(*on), on, "left_anti").select(F.lit("launch").alias("side"))
    lost_timings = timings.join(launches.select(*on), on, "left_anti").select(F.lit("timing").alias("side"))
    return lost_launches.unionByName(lost_timings).groupBy("side").agg(F.count(F.lit(1)).alias("cleared"))


def _latest_maps(maps: DataFrame, keys: list[str]) -> DataFrame:
    return maps.groupBy(*keys).agg(F.max_by("names", "ts_ns").alias("names"))


def stall_reason_names(maps: DataFrame, keys: list[str] = PROCESS) -> DataFrame:
    """Keys, ``stall_index, stall_reason`` of the latest map of each process (``node, pid, ts_ns, names``)."""
    return _latest_maps(maps, keys).select(*keys, F.posexplode("names").alias("stall_index", "name")).select(
        *keys, "stall_index", trim_nul(F.col("name")).alias("stall_reason"))


def gpu_pc_symbols(pc_samples: DataFrame, cubins: DataFrame, stall_maps: DataFrame, keys: list[str] = PROCESS) -> DataFrame:
    """Program-counter samples with the module of their CRC and the name of their stall reason.

    A process's map joins whole and the name is taken out by its index: a row per process travels, not one per name. Maps of
    processes without samples find no row. The maps are never broadcast: the size Spark expects of them is that of their files.
    """
    modules = cubins.groupBy("cubin_crc").agg(F.max_by(F.struct("file_id", "sm_version"), "ts_ns").alias("_cubin")).select(
        "cubin_crc", F.col("_cubin.file_id").alias("cubin_file_id"), F.col("_cubin.sm_version").alias("sm_version"),
        F.concat(F.lit("cubin-"), F.lpad(F.lower(F.hex("cubin_crc")), 16, "0")).alias("cubin_name"))
    names = _latest_maps(stall_maps, keys).withColumnRenamed("names", "_names")
    named = pc_samples.join(names.hint("merge"), list(keys), "left")
    named = named.withColumn("stall_reason", trim_nul(F.get("_names", F.col("stall_index")))).drop("_names")
    symbols = named.join(modules, "cubin_crc", "left")
    rest = [c for c in pc_samples.columns if c not in (*keys, "stall_index", "cubin_crc")]
    return symbols.select(*keys, "stall_index", "cubin_crc", *rest, "cubin_file_id", "sm_version", "cubin_name", "stall_reason")
