"""Profiles: values by function, stack, label and time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stackloom.operators.frames import MISSING_STACK


def location_name(prefix: str = "") -> Column:
    """What a profile calls a location: its function, else the file it lies in."""
    return F.coalesce(F.nullif(f"{prefix}function_system_name", F.lit("")), F.nullif(f"{prefix}function_name", F.lit("")),
                      F.col(f"{prefix}mapping_file"), F.lit("UNKNOWN"))


def _per_stack(samples: DataFrame, by: list[str]) -> DataFrame:
    return samples.groupBy(*by, "stacktrace_id").agg(F.sum("value").alias("_value"))


def _used(locations: DataFrame, sums: DataFrame) -> DataFrame:
    """The frames of summed stacks only: Spark moves the semi-join below the resolution of frames."""
    return locations.join(sums.select("stacktrace_id").distinct(), "stacktrace_id", "left_semi")


def _lost(sums: DataFrame, stacks: DataFrame | None) -> DataFrame:
    """Summed stacks with ``_known``: whether the stack table holds them, be it without frames."""
    if stacks is None:
        return sums.withColumn("_known", F.lit(False))
    known = stacks.select("stacktrace_id", F.lit(True).alias("_known"))
    return sums.join(known, "stacktrace_id", "left").withColumn("_known", F.coalesce("_known", F.lit(False)))


def profile_by_function(
    samples: DataFrame, locations: DataFrame, by: list[str] | None = None, top: int | None = None,
    stacks: DataFrame | None = None
) -> DataFrame:
    """Self and cumulative value per function; recursion counts once, a lost stack under its own name.

    ``stacks`` lists the known stacks once each; one of them without frames is not lost and has no function to count.

    Samples are summed per stack before any frame is touched, so the join sees one row per stack however
    hot the stack is. ``top`` keeps the functions with the largest self value.
    """
    by = by or []
    frames = locations.select("stacktrace_id", "frame_idx", location_name().alias("function"))
    sums = _per_stack(samples, by)
    joined = _lost(sums, stacks).join(_used(frames, sums), "stacktrace_id", "left").where("function IS NOT NULL OR NOT _known")
    per_function = (joined.withColumn("function", F.coalesce("function", F.lit(MISSING_STACK)))
                    .groupBy(*by, "stacktrace_id", "function")
                    .agg(F.max(F.when(F.coalesce("frame_idx", F.lit(1)) == 1, F.col("_value"))).alias("self_value"),
                         F.max("_value").alias("cumulative_value")))
    profile = per_function.groupBy(*by, "function").agg(
        F.coalesce(F.sum("self_value"), F.lit(0)).alias("self_value"), F.sum("cumulative_value").alias("cumulative_value"))
    if top is not None:
        profile = profile.orderBy(F.desc("self_value"), F.desc("cumulative_value"), "function").limit(top)
    return profile


def cpu_time_by_label(samples: DataFrame, names: list[str]) -> DataFrame:
    """``sum(value * period)`` of CPU samples by any set of labels, as a decimal: a fleet passes 64 bits of nanoseconds in days."""
    whole = lambda c: F.col(c).cast("decimal(19,0)")
    cpu = samples.where((F.col("sample_type") == "samples") & (F.col("period_type") == "cpu"))
    return cpu.groupBy(*[F.coalesce(F.col("labels")[n], F.lit("")).alias(n) for n in names]).agg(
        F.sum((whole("value") * whole("period")).cast("decimal(38,0)")).alias("cpu_ns"))


def profile_window(samples: DataFrame, interval: str = "1 hour", ts: str = "ts") -> DataFrame:
    """Merged profile per time window, stack and sample type."""
    return (samples.groupBy(F.window(ts, interval).alias("w"), "stacktrace_id", "sample_type")
            .agg(F.sum("value").alias("value"), F.count(F.lit(1)).alias("n_samples"))
            .select(F.col("w.start").alias("window_start"), "stacktrace_id", "sample_type", "value", "n_samples"))


def folded_stacks(locations: DataFrame) -> DataFrame:
    """Root-first names of each stack joined by ``;``."""
    named = F.struct("frame_idx", location_name().alias("name"))
    return (locations.groupBy("stacktrace_id").agg(F.array_sort(F.collect_list(named)).alias("_names"))
            .select("stacktrace_id", F.array_join(F.transform(F.reverse("_names"), lambda x: x["name"]), ";").alias("folded")))


def stack_fanout(samples: DataFrame, locations: DataFrame, stacks: DataFrame | None = None) -> DataFrame:
    """Value per folded stack: the input of a flame graph. A known stack (``stacks``) without frames folds to ''."""
    sums = _per_stack(samples, [])
    joined = _lost(sums, stacks).join(folded_stacks(_used(locations, sums)), "stacktrace_id", "left")
    lost = F.when(F.col("_known"), F.lit("")).otherwise(F.lit(MISSING_STACK))
    return joined.groupBy(F.coalesce("folded", lost).alias("folded")).agg(F.sum("_value").alias("value"))


def profile_diff(before: DataFrame, after: DataFrame, locations: DataFrame, stacks: DataFrame | None = None) -> DataFrame:
    """Change of self and cumulative value by function between two sets of samples."""
    sides = (before.select("stacktrace_id", "value", F.lit("before").alias("_side"))
             .unionByName(after.select("stacktrace_id", "value", F.lit("after").alias("_side"))))
    profile = profile_by_function(sides, locations, ["_side"], stacks=stacks)

    def total(column: str, side: str) -> Column:
        return F.coalesce(F.sum(F.when(F.col("_side") == side, F.col(column))), F.lit(0))

    return profile.groupBy("function").agg(
        total("self_value", "before").alias("self_before"), total("self_value", "after").alias("self_after"),
        total("cumulative_value", "before").alias("cumulative_before"),
        total("cumulative_value", "after").alias("cumulative_after")).withColumn(
        "self_change", F.col("self_after") - F.col("self_before")).withColumn(
        "cumulative_change", F.col("cumulative_after") - F.col("cumulative_before"))
