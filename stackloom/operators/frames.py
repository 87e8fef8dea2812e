"""From raw frames to locations with lines and functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stackloom.functions.values import build_id_or_hash
from stackloom.schema import LINE

# What the store expects for frames without a name of their own.
ABORT_MAPPING, ABORT_FUNCTION = "agent-internal-error-frame", "aborted"
KERNEL_MAPPING, KERNEL_MODULE = "[kernel.kallsyms]", "vmlinux"
UNKNOWN, UNREPORTED, MISSING_STACK = "UNKNOWN", "UNREPORTED", "missing stacktrace"

FRAME_DEFAULTS = {
    "frame_type": "string", "address": "long", "file_id": "string", "gnu_build_id": "string",
    "mapping_file_name": "string", "function_name": "string", "source_file": "string", "source_line": "long",
    "source_column": "long",
}
LOCATION_COLUMNS = [
    "address", "frame_type", "mapping_file", "mapping_build_id", "has_line", "line", "column",
    "function_system_name", "function_name", "function_filename", "frame_complete",
]


def join_frame_executable(frames: DataFrame, executables: DataFrame) -> DataFrame:
    """Frames with the executable of their file: ``exec_file_name, exec_build_id, exec_known``.

    A left join by file id. Spark broadcasts the executables while they are below its own size limit.
    """
    dim = executables.select(
        "file_id", F.col("file_name").alias("exec_file_name"), F.col("build_id").alias("exec_build_id"),
        F.lit(True).alias("exec_known"))
    return (frames.join(dim, "file_id", "left")
            .withColumn("exec_known", F.coalesce("exec_known", F.lit(False))))


def _field(df: DataFrame, name: str) -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast(FRAME_DEFAULTS[name])


def resolve_frames(frames: DataFrame, schema_version: str = "v2") -> DataFrame:
    """One row per frame in, one location row with at most one line out, by frame type.

    Expects the columns of :func:`join_frame_executable`. In v1 records the name stands in
    ``function_name`` and kernel lines carry the source column.
    """
    v1 = schema_version == "v1"
    kind, name = _field(frames, "frame_type"), F.coalesce(_field(frames, "function_name"), F.lit(""))
    line, column = F.coalesce(_field(frames, "source_line"), F.lit(0)), F.coalesce(
        _field(frames, "source_column"), F.lit(0))
    source, gnu = F.coalesce(_field(frames, "source_file"), F.lit("")), _field(frames, "gnu_build_id")
    known, none = F.col("exec_known"), F.lit(None).cast("string")
    abort, native, kernel, cuda, oom = (
        kind == "abort", kind == "native", kind == "kernel", kind == "cuda-pc", kind == "oomprof")
    missing = kind == "missing"
    named = name != ""
    exec_id = build_id_or_hash(F.col("exec_build_id"), F.col("file_id"))["build_id"]

    mapping_file = (F.when(abort, F.lit(ABORT_MAPPING)).when(native & known, F.col("exec_file_name"))
                    .when(native, F.lit(UNKNOWN)).when(kernel, F.lit(KERNEL_MAPPING))
                    .when(cuda, _field(frames, "mapping_file_name")).when(oom, source))
    build_id = (F.when(native & known, exec_id).when(cuda, F.col("file_id")).when(oom, name)
                .when(abort | native | kernel | missing, none).otherwise(F.nullif(gnu, F.lit(""))))
    has_line = ~(native | oom)
    function = (F.when(abort, F.lit(ABORT_FUNCTION)).when(missing, F.lit(MISSING_STACK))
                .when(kernel, F.when(named, name).otherwise(F.lit(UNKNOWN))).when(cuda, name)
                .otherwise(F.when(named, name).otherwise(F.lit(UNREPORTED))))
    filename = (F.when(abort | cuda | missing, none)
                .when(kernel, F.when(known, F.col("exec_file_name")).otherwise(F.lit(KERNEL_MODULE)))
                .when(~named, F.lit(UNREPORTED)).when(source == "", F.lit(UNKNOWN)).otherwise(source))
    no_position = abort | cuda | missing
    complete = ~missing & F.when(native, known).when(kernel, named).when(oom, F.lit(False)).when(
        abort | cuda, F.lit(True)).otherwise(named)
    if v1:
        system_name, function_name = F.when(cuda, name).otherwise(F.lit("")), F.when(~cuda, function)
        column_value = F.when(no_position, F.lit(0)).otherwise(column)
    else:
        system_name, function_name = F.nullif(function, F.lit("")), none
        column_value = F.when(no_position | kernel, F.lit(0)).otherwise(column)
    line_value = F.when(no_position | (kernel & ~named) | (~named), F.lit(0)).otherwise(line)
    out = {
        "address": F.when(missing, F.lit(0)).otherwise(_field(frames, "address")).cast("long"),
        "frame_type": F.when(oom, F.lit("native")).when(missing, F.lit("unknown")).otherwise(kind),
        "mapping_file": mapping_file, "mapping_build_id": build_id, "has_line": has_line,
        "line": F.when(has_line, line_value.cast("long")), "column": F.when(has_line, column_value.cast("long")),
        "function_system_name": F.when(has_line, system_name), "function_name": F.when(has_line, function_name),
        "function_filename": F.when(has_line, filename), "frame_complete": complete,
    }
    dropped = set(FRAME_DEFAULTS) | {"exec_file_name", "exec_build_id", "exec_known"}
    keys = [c for c in frames.columns if c not in dropped]
    return frames.select(*keys, *[value.alias(alias) for alias, value in out.items()])


def explode_frames(stacks: DataFrame, *keys: str) -> DataFrame:
    """One row per frame, leaf first, numbered from 1.

    Stacks without frames give no row here; ``classify_unwind_completeness`` and ``stack_locations`` get them back from the
    stack table they are given.
    """
    return (stacks.select(*keys, F.posexplode("frames").alias("pos", "_frame"))
            .select(*keys, (F.col("pos") + 1).alias("frame_idx"), "_frame.*"))


def lines_of(locations: DataFrame) -> Column:
    """The ``lines`` array of a location: one line, or NULL where the store symbolises later."""
    line = F.struct(
        F.col("line"), F.col("column"), F.col("function_system_name"), F.col("function_name"), F.col("function_filename"),
        F.lit(0).cast("long").alias("function_start_line")).cast(LINE)
    return F.when(F.col("has_line"), F.array(line))


def _with_empty(found: DataFrame, stacks: DataFrame | None, keys: tuple[str, ...]) -> DataFrame:
    """The rows of ``found`` and, complete, those of ``stacks`` that no frame stands for."""
    if stacks is None:
        return found
    every = stacks.select(*keys).distinct().join(found, list(keys), "left")
    return every.withColumn("is_complete", F.coalesce("is_complete", F.lit(True)))


def classify_unwind_completeness(locations: DataFrame, *keys: str, stacks: DataFrame | None = None) -> DataFrame:
    """``is_complete`` per stack: every frame resolved as far as its type allows. Without frames there is nothing amiss.

    ``stacks`` lists the known stacks, for those without frames.
    """
    found = locations.groupBy(*keys).agg(F.bool_and("frame_complete").alias("is_complete"))
    return _with_empty(found, stacks, keys)


def stack_locations(locations: DataFrame, *keys: str, stacks: DataFrame | None = None) -> DataFrame:
    """Resolved frames gathered per stack, leaf first. A stack has a bounded number of frames.

    ``stacks`` lists the known stacks: those without frames are complete and have NULL locations.
    """
    location = F.struct(
        "frame_idx", "address", "frame_type", "mapping_file", "mapping_build_id", lines_of(locations).alias("lines"))
    found = (locations.groupBy(*keys)
             .agg(F.bool_and("frame_complete").alias("is_complete"),
                  F.array_sort(F.collect_list(location)).alias("_locations"))
             .select(*keys, "is_complete", F.transform("_locations", lambda x: F.struct(
                 *[x[c].alias(c) for c in ("address", "frame_type", "mapping_file", "mapping_build_id", "lines")]))
                 .alias("locations")))
    return _with_empty(found, stacks, keys)
