"""Stack, location and function tables, and the exchange of stacks by id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from stackloom.functions.values import content_id
from stackloom.operators.frames import MISSING_STACK, explode_frames
from stackloom.schema import FRAME

FRAME_FIELDS = FRAME.fieldNames()


def stack_id(frames: Column) -> Column:
    """128-bit id of a frame list (32 hex digits), equal for equal content.

    The hash runs over the JSON text of the frames, which names every field, so NULL, '' and values in
    other fields never look alike. Ids taken over from captured logs live in another id space; do not mix
    both in one table.
    """
    return F.md5(F.to_json(frames.cast(ArrayType(FRAME))))


def with_stack_id(events: DataFrame) -> DataFrame:
    return events.withColumn("stacktrace_id", stack_id(F.col("frames")))


def distinct_stacks(events: DataFrame) -> DataFrame:
    """``stacktrace_id, frames, n_events``: one row per different stack.

    Grouped by the id, so a stack that a third of all events share arrives as one row per task.
    """
    return (with_stack_id(events).groupBy("stacktrace_id")
            .agg(F.first("frames").alias("frames"), F.count(F.lit(1)).alias("n_events")))


def distinct_locations(stacks: DataFrame) -> DataFrame:
    """One row per different frame value, keyed by its content."""
    frames = explode_frames(stacks).drop("frame_idx")
    return frames.dropDuplicates(FRAME_FIELDS).select(
        content_id([F.col(c) for c in FRAME_FIELDS]).alias("location_id"), *FRAME_FIELDS)


def distinct_functions(locations: DataFrame) -> DataFrame:
    """Dictionary of ``(system_name, filename, start_line)``, '' read as NULL, with ids from 0.

    The start line is ``function_start_line`` where the locations have that column, else 0. The order of first sight means nothing in a distributed job; ids follow the content hash instead.
    """
    keys = ["system_name", "filename", "start_line"]
    start = F.coalesce("function_start_line", F.lit(0)) if "function_start_line" in locations.columns else F.lit(0)
    functions = (locations.where("has_line")
                 .select(F.nullif("function_system_name", F.lit("")).alias("system_name"),
                         F.nullif("function_filename", F.lit("")).alias("filename"),
                         start.cast("long").alias("start_line")).dropDuplicates(keys))
    return dense_ids(functions, keys, "function_id")


def dense_ids(rows: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Number distinct rows 0, 1, 2 ... in the order of their content hash.

    The first four hex digits cut the rows into 65,536 even parts. Rows are numbered inside a part and
    shifted by the sizes of the parts before; only those sizes, at most 65,536, meet in one task.
    """
    marked = rows.withColumn("_hash", content_id([F.col(k) for k in keys])).withColumn("_cut", F.substring("_hash", 1, 4))
    sizes = marked.groupBy("_cut").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_cut").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_cut", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy("_cut").orderBy("_hash")
    return (marked.withColumn("_row", F.row_number().over(inside)).join(offsets, "_cut")
            .withColumn(name, F.col("_offset") + F.col("_row") - 1)
            .drop("_hash", "_cut", "_row", "_offset"))


def requested_stacktraces(requested: DataFrame, stacks: DataFrame) -> DataFrame:
    """The stacks of the ids a store asks for; an unknown id gives a placeholder without frames.

    Both sides hold an id once, so no id is hot.
    """
    known = stacks.withColumn("_found", F.lit(True))
    joined = requested.select("stacktrace_id").distinct().join(known, "stacktrace_id", "left")
    return joined.withColumn("is_missing", F.col("_found").isNull()).drop("_found")


def missing_stack_frames() -> Column:
    """The single frame that stands for a stack nobody knows."""
    values = {"frame_type": F.lit("missing"), "function_name": F.lit(MISSING_STACK), "address": F.lit(0).cast("long")}
    return F.array(F.struct(*[
        values.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in FRAME.fields]))


def unknown_stacks(samples: DataFrame, stored: DataFrame) -> DataFrame:
    """Ids of a sample batch that the store does not hold yet."""
    return samples.select("stacktrace_id").distinct().join(stored.select("stacktrace_id"), "stacktrace_id", "left_anti")


def new_stacktraces(samples: DataFrame, rotation: list[str], batch: str, written: DataFrame | None = None) -> DataFrame:
    """For every output file (``rotation``) each stack id once, with the first batch that holds it.

    ``written`` lists ids already stored per file.
    """
    first = samples.groupBy(*rotation, "stacktrace_id").agg(F.min(batch).alias("first_batch"))
    if written is not None:
        first = first.join(written.select(*rotation, "stacktrace_id").distinct(), [*rotation, "stacktrace_id"], "left_anti")
    return first
