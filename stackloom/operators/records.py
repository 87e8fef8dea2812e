"""The record forms samples and stacks are stored in."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stackloom.schema import SAMPLE_COLUMNS

# Fixed value: the name of the tag that says in which form a record is written, up to its first part.
VERSION_TAG = "write_schema_version"


def tagged(records: DataFrame, version: str) -> DataFrame:
    """The version of the record form as metadata of the id column; Parquet keeps it in its footer."""
    return records.withMetadata("stacktrace_id", {VERSION_TAG: version})


def record_version(records: DataFrame) -> str | None:
    """The version that ``tagged`` has left, also in a table read back; None without a tag."""
    return records.schema["stacktrace_id"].metadata.get(VERSION_TAG)


def label_names(samples: DataFrame) -> list[str]:
    """The label names in use, sorted. A table has a column for each, so its schema holds all of them anyway."""
    found = samples.select(F.explode(F.map_keys("labels")).alias("name")).distinct().collect()
    return sorted(row["name"] for row in found)


def labels_wide(samples: DataFrame, names: list[str] | None = None) -> DataFrame:
    """Sorted nullable ``labels.<name>`` columns in front, the other columns behind.

    ``names`` says which labels become columns; without it the labels in use are looked up first.
    """
    names = sorted(names) if names is not None else label_names(samples)
    rest = [c for c in samples.columns if c != "labels"]
    return samples.select(
        *[F.nullif(F.col("labels")[n], F.lit("")).alias(f"labels.{n}") for n in names], *[F.col(c) for c in rest])


def union_batches(batches: list[DataFrame]) -> DataFrame:
    """Batches with different label columns in one table; a label that a batch lacks is NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), batches)


def samples_v1(samples: DataFrame, names: list[str] | None = None) -> DataFrame:
    """Label columns and ids only."""
    return tagged(labels_wide(samples.select("labels", *SAMPLE_COLUMNS), names), "v1")


def stacktraces_v1(locations_by_stack: DataFrame) -> DataFrame:
    """``stacktrace_id, is_complete, locations`` with the mapping range columns, which are always 0."""
    zero = F.lit(0).cast("long")
    return tagged(locations_by_stack.select("stacktrace_id", "is_complete", F.transform("locations", lambda x: F.struct(
        x["address"].alias("address"), x["frame_type"].alias("frame_type"), zero.alias("mapping_start"),
        zero.alias("mapping_limit"), zero.alias("mapping_offset"), x["mapping_file"].alias("mapping_file"),
        x["mapping_build_id"].alias("mapping_build_id"), x["lines"].alias("lines"))).alias("locations")), "v1")


def samples_v2(samples: DataFrame, locations_by_stack: DataFrame) -> DataFrame:
    """Self-contained rows: labels and the stack inline. Each side is evaluated once.

    The stacks hold an id once, so Spark can split the samples of a hot stack over tasks (adaptive skew join) and broadcasts
    the stacks while they are below its limit.
    """
    stacks = locations_by_stack.select("stacktrace_id", F.col("locations").alias("stacktrace"))
    joined = samples.select("labels", *SAMPLE_COLUMNS).join(stacks, "stacktrace_id", "left")
    return tagged(joined.select("labels", "stacktrace", *SAMPLE_COLUMNS), "v2")
