"""Batch-log files of the fixture samples, written by the sink, for the queries that read them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stackloom.functions.values import floor_div
from stackloom.operators.frames import join_frame_executable, resolve_frames, stack_locations
from stackloom.operators.stacks import new_stacktraces
from stackloom.plans import inputs
from stackloom.plans.fixtures import Tables
from stackloom.session import shared_dir
from stackloom.sources.batch_log import FIELDS
from stackloom.sources.batch_log_sink import write_batch_log

HOUR_NS = 3_600_000_000_000
DAY_NS = 24 * HOUR_NS
FILE_NS, BATCH_NS = DAY_NS, HOUR_NS
TEXTS = ["sample_type", "sample_unit", "period_type", "period_unit", "producer", "temporality"]
NUMBERS = ["value", "period", "duration"]


def records(t: Tables, file_ns: int = FILE_NS, batch_ns: int = BATCH_NS) -> DataFrame:
    """Sample rows and, with the first batch that needs them, stack rows; a file per node and day, a batch per hour.

    A stack that does not exist has no row, which the replay has to cope with.
    """
    named = inputs.samples(t).withColumn("file", F.concat_ws("-", "node", floor_div(F.col("ts_ns"), file_ns).cast("string"))).withColumn(
        "batch", floor_div(F.col("ts_ns"), batch_ns))
    samples = named.withColumns({
        "record": F.lit("samples"), "schema_version": F.lit("v1"), "labels": F.create_map(F.lit("comm"), F.col("comm"), F.lit("node"), F.col("node"))})
    first = new_stacktraces(named, ["file"], "batch").withColumnRenamed("first_batch", "batch")
    # Only stacks that occur in the files are resolved.
    used = named.select("stacktrace_id").distinct()
    located = stack_locations(resolve_frames(join_frame_executable(
        inputs.frames(t).join(used, "stacktrace_id", "left_semi"), inputs.executables(t)), "v1"), "stacktrace_id",
        stacks=inputs.stack_table(t).join(used, "stacktrace_id", "left_semi"))
    stacks = first.join(located, "stacktrace_id").withColumn("record", F.lit("stacktraces"))
    rows = samples.select("record", "file", "batch", "schema_version", "labels", "stacktrace_id", "ts_ns", *NUMBERS, *TEXTS).unionByName(
        stacks.select("record", "file", "batch", "stacktrace_id", "is_complete", "locations"), allowMissingColumns=True)
    return rows.withColumn("stacktrace_id", F.unhex(F.lpad(F.hex(F.col("stacktrace_id")), 32, "0")))


def plain_records(t: Tables) -> DataFrame:
    """A sample row per event, without frames or labels: what an inventory of files needs."""
    rows = inputs.events(t).select(
        F.lit("samples").alias("record"), F.concat_ws("-", "node", floor_div(F.col("ts_ns"), FILE_NS).cast("string")).alias("file"),
        floor_div(F.col("ts_ns"), BATCH_NS).alias("batch"), F.lit("v1").alias("schema_version"),
        F.create_map().cast("map<string,string>").alias("labels"), F.unhex(F.lpad(F.hex("stacktrace_id"), 32, "0")).alias("stacktrace_id"), "ts_ns",
        F.col("raw_value").alias("value"), *[F.lit(1).cast("long").alias(n) for n in ("period", "duration")], *[F.lit("x").alias(n) for n in TEXTS])
    kinds = FIELDS["all"]
    return rows.withColumns({n: F.lit(None).cast(kinds[n]) for n in ("is_complete", "locations")})


def write_batch_files(t: Tables) -> str:
    """Write the files into the shared folder and return their path."""
    root = shared_dir(t.spark, "batch-log")
    write_batch_log(records(t), root)
    return root
