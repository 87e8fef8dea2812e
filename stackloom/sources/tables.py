"""Event and inventory tables, and the record tables written from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from stackloom.functions.values import floor_div, ns_to_ts
from stackloom.operators.records import samples_v1, samples_v2, stacktraces_v1
from stackloom.schema import SECOND_NS, TRACE_EVENT

POD_SCHEMA = (
    "uid string, name string, namespace string, labels map<string,string>, annotations map<string,string>, "
    "owners array<struct<kind:string,name:string,controller:boolean>>, node_name string, pod_ip string, "
    "host_ip string, phase string, conditions array<struct<type:string,status:string>>, "
    "containers array<struct<name:string,image:string>>, init_containers array<struct<name:string,image:string>>, "
    "container_statuses array<struct<container_id:string,name:string>>, "
    "init_container_statuses array<struct<container_id:string,name:string>>")


def read_trace_events(
    spark: SparkSession, path: str, columns: dict[str, str] | None = None, *, schema: StructType | None = None,
    streaming: bool = False, **options: str,
) -> DataFrame:
    """Raw trace events of a Parquet folder, as a batch or a stream.

    Folders in the native layout need nothing else. For another layout ``columns`` maps event columns to SQL
    expressions over the stored ones, and ``schema`` names these (a stream needs it).
    """
    reader = spark.readStream if streaming else spark.read
    stored = schema or (TRACE_EVENT if columns is None else None)
    if stored is not None:
        reader = reader.schema(stored)
    events = reader.options(**options).parquet(path)
    return events.selectExpr(*[f"{e} AS {c}" for c, e in columns.items()]) if columns else events


def read_pods(pods: DataFrame, json_column: str = "object") -> DataFrame:
    """Pod objects kept as JSON text, as columns."""
    return pods.select(F.from_json(json_column, POD_SCHEMA).alias("p")).select("p.*")


def read_dimensions(spark: SparkSession, paths: dict[str, str]) -> dict[str, DataFrame]:
    """Inventory tables by name; a table named ``pods`` with an ``object`` column is taken apart."""
    tables = {name: spark.read.parquet(path) for name, path in paths.items()}
    if "pods" in tables and "object" in tables["pods"].columns:
        tables["pods"] = read_pods(tables["pods"])
    return tables


def _runs_sorted(df: DataFrame) -> DataFrame:
    """Rows ordered so that equal neighbours encode as runs, without another shuffle."""
    return df.sortWithinPartitions("sample_type", "ts_ns")


def write_samples_v1(samples: DataFrame, path: str, names: list[str] | None = None, by_hour: bool = False) -> None:
    _append(samples_v1(samples, names), path, by_hour)


def _append(rows: DataFrame, path: str, by_hour: bool) -> None:
    """Append sorted rows; ``by_hour`` lays them out in ``date`` and ``hour`` folders that a scan can skip."""
    if by_hour:
        ts = ns_to_ts(F.col("ts_ns"))
        rows = rows.withColumns({"date": F.to_date(ts), "hour": F.hour(ts)}).hint("rebalance", "date", "hour")
    writer = _runs_sorted(rows).write.mode("append").option("compression", "zstd")
    (writer.partitionBy("date", "hour") if by_hour else writer).parquet(path)


def write_stacktraces_v1(locations_by_stack: DataFrame, path: str) -> None:
    stacktraces_v1(locations_by_stack).write.mode("append").option("compression", "zstd").parquet(path)


def write_samples_v2(samples: DataFrame, locations_by_stack: DataFrame, path: str, by_hour: bool = False) -> None:
    _append(samples_v2(samples, locations_by_stack), path, by_hour)


def with_rotation(samples: DataFrame, interval_ns: int = 600 * SECOND_NS) -> DataFrame:
    """The output file a sample belongs to: the start of its rotation interval."""
    return samples.withColumn("rotation", ns_to_ts(floor_div(F.col("ts_ns"), interval_ns) * F.lit(interval_ns)))


def rotate_output(samples: DataFrame, path: str, interval_ns: int = 600 * SECOND_NS) -> None:
    """One compressed folder per rotation interval.

    Rows of an interval are brought together first, so a folder gets files of a useful size and not one from every task;
    intervals that are too large for one task are split.
    """
    (with_rotation(samples, interval_ns).hint("rebalance", "rotation").write.mode("append").partitionBy("rotation")
     .option("compression", "zstd").parquet(path))


# Suffixes of off-line files. The longer one has to be tested first.
COMPRESSED_SUFFIX, OPEN_SUFFIX = ".padata.zst", ".padata"


def batch_log_inventory(spark: SparkSession, path: str) -> DataFrame:
    """``kind, files, bytes`` of a folder of off-line files. File contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length")
    kind = (F.when(F.endswith("path", F.lit(COMPRESSED_SUFFIX)), F.lit("compressed"))
            .when(F.endswith("path", F.lit(OPEN_SUFFIX)), F.lit("open")).otherwise(F.lit("unknown")))
    return files.groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("files"), F.sum("length").alias("bytes"))
