"""Off-line batch logs (``.padata``, ``.padata.zst``) as a Spark data source, read in batch and as a stream, and their replay.

A file holds a header (magic, version, number of batches, big-endian) and per batch a length-prefixed
Arrow stream of samples; files with v1 records add a second stream with the stacks new to the file.
The header count is written last, so whatever lies behind that many batches is ignored. Names that start with ``_`` or ``.``
(also of folders) are files still being written.

``spark.read.format("batch_log").option("record", "samples").load(path)`` gives the samples,
``record=stacktraces`` the stacks, ``record=all`` both in one pass, told apart by a column ``record``. Paths need a scheme there;
``read_batch_log`` adds that of the cluster's default file system to a path without one. A partition is a group of whole files,
filled up to ``partition_bytes`` with a fixed cost per file; one file spans one rotation interval of one host. Batches are
decoded one at a time, and only the ``columns`` asked for. ``files`` (patterns of names, as a JSON list) selects files before
any is opened. These selections are options and not filters pushed down by Spark: in Spark 4.1 a Python data source keeps
the filters of the last plan that used it, so a DataFrame that is filtered in one query and whole in the next would lose rows.

``spark.readStream`` takes each batch once, as soon as the header counts it. Its offset names every file that is there with the
number of batches read; a file keeps its name when it is compressed. ``batch_log_sink`` writes such files.
"""

from __future__ import annotations

import io
import json
import struct
from collections.abc import Iterator
from dataclasses import dataclass
from fnmatch import fnmatchcase

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from stackloom.session import qualified

# The file format.
MAGIC, FORMAT_VERSION = 0xA6E7CCCA, 0
HEADER, LENGTH = struct.Struct(">IHH"), struct.Struct(">I")
SUFFIXES = (".padata.zst", ".padata")
PARTITION_BYTES, OPEN_COST = 128 << 20, 4 << 20

LOCATIONS = (
    "array<struct<address:bigint,frame_type:string,mapping_file:string,mapping_build_id:string,lines:array<struct<line:bigint,"
    "column:bigint,function_name:string,function_system_name:string,function_filename:string,function_start_line:bigint>>>>")
SAMPLE_FIELDS = {
    "file": "string", "batch": "int", "row": "int", "schema_version": "string", "labels": "map<string,string>", "stacktrace_id": "binary",
    "ts_ns": "bigint", "value": "bigint", "sample_type": "string", "sample_unit": "string", "period_type": "string", "period_unit": "string",
    "producer": "string", "temporality": "string", "period": "bigint", "duration": "bigint", "locations": LOCATIONS}
STACK_FIELDS = {"file": "string", "batch": "int", "stacktrace_id": "binary", "is_complete": "boolean", "locations": LOCATIONS}
FIELDS = {"samples": SAMPLE_FIELDS, "stacktraces": STACK_FIELDS, "all": {"record": "string", **SAMPLE_FIELDS, **STACK_FIELDS}}

_LINE = pa.struct([
    ("line", pa.int64()), ("column", pa.int64()), ("function_name", pa.string()), ("function_system_name", pa.string()),
    ("function_filename", pa.string()), ("function_start_line", pa.int64())])
_LOCATION = pa.struct([
    ("address", pa.int64()), ("frame_type", pa.string()), ("mapping_file", pa.string()),
    ("mapping_build_id", pa.string()), ("lines", pa.list_(_LINE))])
_TEXT = ("sample_type", "sample_unit", "period_type", "period_unit", "producer", "temporality")
_LABELS = pa.map_(pa.string(), pa.string())
# Records are small and tasks fill the cores: a thread for each buffer costs more than decompressing it.
_SERIAL = pa.ipc.IpcReadOptions(use_threads=False)


@dataclass
class FileGroup(InputPartition):
    files: list[str]


@dataclass
class Stretches(InputPartition):
    """``(stem, first, last)``: so many batches (``last`` exclusive) of files, whether these are compressed by now or not."""

    stretches: list[tuple[str, int, int]]


def plain(array: pa.Array) -> pa.Array:
    """An array without run-end, dictionary, view or extension encoding."""
    kind = array.type
    if isinstance(array, pa.ExtensionArray):
        return plain(array.storage)
    if pa.types.is_run_end_encoded(kind):
        return pc.run_end_decode(pa.RunEndEncodedArray.from_arrays(array.run_ends, plain(array.values)))
    if pa.types.is_dictionary(kind):
        return plain(array.dictionary).take(array.indices)
    if pa.types.is_list(kind) or pa.types.is_list_view(kind) or pa.types.is_large_list(kind):
        sizes = pc.fill_null(pc.list_value_length(array), 0).to_numpy(zero_copy_only=False)
        offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
        return pa.ListArray.from_arrays(offsets, plain(array.flatten()), mask=array.is_null())
    if pa.types.is_struct(kind):
        names = [kind.field(i).name for i in range(kind.num_fields)]
        return pa.StructArray.from_arrays([plain(c) for c in array.flatten()], names, mask=array.is_null())
    if pa.types.is_string_view(kind) or pa.types.is_large_string(kind):
        return array.cast(pa.string())
    if pa.types.is_binary_view(kind) or pa.types.is_fixed_size_binary(kind) or pa.types.is_large_binary(kind):
        return array.cast(pa.binary())
    return array


def conform(array: pa.Array, target: pa.DataType) -> pa.Array:
    """A plain array in the type the table has; missing struct fields become NULL."""
    if pa.types.is_struct(target):
        present = {array.type.field(i).name: c for i, c in enumerate(array.flatten())}
        if "function" in present:  # v2 keeps the function of a line in a struct of its own
            inner = present.pop("function")
            present |= {f"function_{inner.type.field(i).name}": c for i, c in enumerate(inner.flatten())}
        fields = [target.field(i) for i in range(target.num_fields)]
        children = [conform(present[f.name], f.type) if f.name in present else pa.nulls(len(array), f.type) for f in fields]
        return pa.StructArray.from_arrays(children, fields=fields, mask=array.is_null())
    if pa.types.is_list(target):
        return pa.ListArray.from_arrays(array.offsets, conform(array.values, target.value_type), mask=array.is_null())
    if pa.types.is_uint64(array.type) and pa.types.is_int64(target):
        return array.view(pa.int64())  # bit for bit
    if pa.types.is_timestamp(array.type):
        return array.cast(pa.timestamp("ns", array.type.tz)).view(pa.int64())
    if pa.types.is_binary(array.type) and pa.types.is_string(target):
        return array.cast(pa.string())
    return array.cast(target)


def label_maps(names: list[str], columns: list[pa.Array], rows: int) -> pa.Array:
    """One map per row out of label columns; NULL and '' count as absent."""
    if not names:
        return pa.array([[]] * rows, _LABELS)
    values = pa.concat_arrays([c.cast(pa.string()) for c in columns])
    row_wise = np.arange(len(names) * rows).reshape(len(names), rows).T.ravel()
    values = values.take(pa.array(row_wise))
    keys = pa.array(names, pa.string()).take(pa.array(np.tile(np.arange(len(names)), rows)))
    present = pc.fill_null(pc.not_equal(values, ""), False)
    counts = present.to_numpy(zero_copy_only=False).reshape(rows, len(names)).sum(axis=1)
    offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32())
    return pa.MapArray.from_arrays(offsets, keys.filter(present), values.filter(present))


def schema_version(schema: pa.Schema) -> str:
    """The version tag in the record's metadata, else what the columns tell."""
    for key, value in (schema.metadata or {}).items():
        if key.endswith(b"write_schema_version"):
            return value.decode()
    return "v2" if "stacktrace" in schema.names else "v1"


def sample_columns(table: pa.Table, version: str, wanted: set[str]) -> dict[str, pa.Array]:
    """The wanted columns of a samples record; nothing else is decoded."""
    rows = table.num_rows
    decoded = lambda n: plain(table.column(n).combine_chunks())
    out = {}
    if "schema_version" in wanted:
        out["schema_version"] = pa.array([version] * rows, pa.string())
    if "labels" in wanted:
        if version == "v2":
            labels = decoded("labels")
            named = dict(zip([labels.type.field(i).name for i in range(labels.type.num_fields)], labels.flatten()))
        else:
            named = {n[len("labels."):]: decoded(n) for n in table.column_names if n.startswith("labels.")}
        order = sorted(named)
        out["labels"] = label_maps(order, [named[n] for n in order], rows)
    if "stacktrace_id" in wanted:
        out["stacktrace_id"] = decoded("stacktrace_id").cast(pa.binary())
    out |= {n: conform(decoded("timestamp" if n == "ts_ns" else n), pa.int64()) for n in ("ts_ns", "value", "period", "duration") if n in wanted}
    out |= {n: decoded(n).cast(pa.string()) if n in table.column_names else pa.nulls(rows, pa.string()) for n in _TEXT if n in wanted}
    if "locations" in wanted:
        places = pa.list_(_LOCATION)
        out["locations"] = conform(decoded("stacktrace"), places) if version == "v2" else pa.nulls(rows, places)
    return out


def stack_columns(table: pa.Table, wanted: set[str]) -> dict[str, pa.Array]:
    kinds = {"stacktrace_id": pa.binary(), "is_complete": pa.bool_(), "locations": pa.list_(_LOCATION)}
    return {n: conform(plain(table.column(n).combine_chunks()), kind) for n, kind in kinds.items() if n in wanted}


def _file_system(path: str) -> tuple[fs.FileSystem, str]:
    if "://" not in path:
        raise ValueError(f"{path} has no scheme: each machine would read its own disk")
    return fs.FileSystem.from_uri(path)


def _exactly(stream, size: int) -> bytes:
    data = stream.read(size)
    if len(data) != size:
        raise ValueError(f"batch log ends after {len(data)} of {size} bytes")
    return data


def _skip(stream, size: int) -> None:
    while size:
        size -= len(_exactly(stream, min(size, 1 << 20)))


def read_count(stream) -> int:
    """The number of batches the header vouches for."""
    magic, version, batches = HEADER.unpack(_exactly(stream, HEADER.size))
    if magic != MAGIC:
        raise ValueError("incorrect magic number")
    if version != FORMAT_VERSION:
        raise ValueError(f"unexpected format version {version}")
    return batches


def read_records(stream, wanted: tuple[str, ...], first: int = 0, last: int | None = None) -> Iterator[tuple[int, str, str, pa.Table]]:
    """``(batch, record, version, table)`` of one open file, ``wanted`` being samples, stacktraces or both."""
    batches = read_count(stream)
    for batch in range(batches if last is None else min(last, batches)):
        record = _exactly(stream, LENGTH.unpack(_exactly(stream, LENGTH.size))[0])
        with pa.ipc.open_stream(record, options=_SERIAL) as reader:
            tag = schema_version(reader.schema)
            if "samples" in wanted and batch >= first:
                yield batch, "samples", tag, reader.read_all()
        if tag == "v2":
            continue
        size = LENGTH.unpack(_exactly(stream, LENGTH.size))[0]
        if "stacktraces" in wanted and batch >= first:
            with pa.ipc.open_stream(_exactly(stream, size), options=_SERIAL) as reader:
                yield batch, "stacktraces", tag, reader.read_all()
        else:
            _skip(stream, size)


class _Decoder:
    """Record batches of the schema out of files: what batch and stream reader share."""

    def __init__(self, schema: StructType, path: str, record: str, patterns: list[str] | None = None, partition_bytes: int = PARTITION_BYTES):
        self.path, self.patterns, self.partition_bytes = path, patterns, partition_bytes
        self.names = schema.names
        self.records = ("samples", "stacktraces") if record == "all" else (record,)

    def open(self, name: str):
        system, _ = _file_system(self.path)
        # The suffix tells the compression.
        return io.BufferedReader(system.open_input_stream(name, compression="zstd" if name.endswith(".zst") else None))

    def files(self) -> list[fs.FileInfo]:
        system, root = _file_system(self.path)
        hidden = lambda f: any(part[:1] in ("_", ".") for part in f.path[len(root):].split("/"))
        found = system.get_file_info(fs.FileSelector(root, recursive=True))
        chosen = lambda f: self.patterns is None or any(fnmatchcase(f.base_name, p) for p in self.patterns)
        return sorted((f for f in found if f.is_file and f.path.endswith(SUFFIXES) and not hidden(f) and chosen(f)), key=lambda f: f.path)

    def decode(self, name: str, shown: str, first: int = 0, last: int | None = None) -> Iterator[pa.RecordBatch]:
        wanted, arrow = set(self.names), _arrow_types()
        with self.open(name) as stream:
            for batch, record, version, table in read_records(stream, self.records, first, last):
                rows = table.num_rows
                columns = {"record": pa.array([record] * rows, pa.string()), "file": pa.array([shown] * rows, pa.string()),
                           "batch": pa.array(np.full(rows, batch), pa.int32())}
                if record == "samples":
                    columns["row"] = pa.array(np.arange(rows), pa.int32())
                    columns |= sample_columns(table, version, wanted)
                else:
                    columns |= stack_columns(table, wanted)
                yield pa.RecordBatch.from_arrays(
                    [columns[n] if n in columns else pa.nulls(rows, arrow[n]) for n in self.names], names=self.names)


def _arrow_types() -> dict[str, pa.DataType]:
    """Types of the columns that a record may lack."""
    return {n: pa.string() for n in ("schema_version", *_TEXT)} | {n: pa.int64() for n in ("ts_ns", "value", "period", "duration")} | {
        "row": pa.int32(), "labels": _LABELS, "is_complete": pa.bool_(), "locations": pa.list_(_LOCATION)}


class BatchLogReader(_Decoder, DataSourceReader):
    def partitions(self) -> list[FileGroup]:
        groups: list[FileGroup] = []
        room = 0
        for file in self.files():
            if file.size + OPEN_COST > room:
                groups.append(FileGroup([]))
                room = self.partition_bytes
            groups[-1].files.append(file.path)
            room -= file.size + OPEN_COST
        return groups

    def read(self, partition: FileGroup) -> Iterator[pa.RecordBatch]:
        for name in partition.files if partition is not None else []:
            yield from self.decode(name, name.rsplit("/", 1)[-1])


class BatchLogStreamReader(_Decoder, DataSourceStreamReader):
    """Every batch once, when the header counts it. ``file`` is the name of the open file, also after compression.

    Offsets hold ``file: batches`` of the files that are there, so they shrink as files are removed; the counts of files that
    can grow no more are read once.
    """

    def __init__(self, *arguments):
        super().__init__(*arguments)
        self.closed: dict[str, int] = {}

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        counts, closed = {}, {}
        for file in self.files():
            name = file.path
            if name in self.closed:
                count = self.closed[name]
            else:
                try:
                    with self.open(name) as stream:
                        count = read_count(stream)
                except FileNotFoundError:  # compressed a moment ago
                    continue
            if name.endswith(".zst"):
                closed[name] = count
            stem = name.removesuffix(".zst")
            counts[stem] = max(counts.get(stem, 0), count)
        self.closed = closed
        return counts

    def partitions(self, start: dict, end: dict) -> list[Stretches]:
        new = [(stem, start.get(stem, 0), count) for stem, count in sorted(end.items()) if count > start.get(stem, 0)]
        sizes = {f.path.removesuffix(".zst"): f.size for f in self.files()} if new else {}
        groups: list[Stretches] = []
        room = 0
        for stretch in new:
            cost = sizes.get(stretch[0], 0) + OPEN_COST
            if cost > room:
                groups.append(Stretches([]))
                room = self.partition_bytes
            groups[-1].stretches.append(stretch)
            room -= cost
        return groups

    def read(self, partition: Stretches) -> Iterator[pa.RecordBatch]:
        system, _ = _file_system(self.path)
        for stem, first, last in partition.stretches if partition is not None else []:
            name = stem if system.get_file_info(stem).is_file else f"{stem}.zst"
            yield from self.decode(name, stem.rsplit("/", 1)[-1], first, last)


class BatchLogSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "batch_log"

    def _record(self) -> str:
        record = self.options.get("record", "samples")
        if record not in FIELDS:
            raise ValueError(f"record must be samples, stacktraces or all, not {record!r}")
        return record

    def schema(self) -> str:
        fields = FIELDS[self._record()]
        names = [n.strip() for n in self.options["columns"].split(",")] if "columns" in self.options else list(fields)
        unknown = sorted(set(names) - set(fields))
        if unknown:
            raise ValueError(f"no columns {unknown} in {self._record()} records")
        return ", ".join(f"{n} {fields[n]}" for n in names)

    def _arguments(self) -> tuple:
        patterns = json.loads(self.options["files"]) if "files" in self.options else None
        return self.options["path"], self._record(), patterns, int(self.options.get("partition_bytes", PARTITION_BYTES))

    def reader(self, schema: StructType) -> BatchLogReader:
        return BatchLogReader(schema, *self._arguments())

    def streamReader(self, schema: StructType) -> BatchLogStreamReader:
        return BatchLogStreamReader(schema, *self._arguments())

    def writer(self, schema: StructType, overwrite: bool):
        from stackloom.sources.batch_log_sink import BatchLogWriter

        return BatchLogWriter(self.options["path"], schema, overwrite, self.options.get("compress", "true") == "true")


def read_batch_log(spark: SparkSession, path: str, record: str = "samples", columns: list[str] | None = None,
                   files: list[str] | None = None, streaming: bool = False, **options: str) -> DataFrame:
    """The records of a folder, as a batch or a stream; ``columns`` are all that is decoded, ``files`` patterns of the names to read."""
    spark.dataSource.register(BatchLogSource)
    if columns is not None:
        options["columns"] = ",".join(columns)
    if files is not None:
        options["files"] = json.dumps(files)
    reader = spark.readStream if streaming else spark.read
    return reader.format("batch_log").option("record", record).options(**options).load(qualified(spark, path))


#: What a replay needs of the records.
REPLAY_COLUMNS = ["record", "file", "batch", "schema_version", "stacktrace_id", "is_complete", "locations"]


def replay_batch_log(records: DataFrame, stacktraces: DataFrame | None = None) -> DataFrame:
    """The stacks to send with every batch: each id a batch of samples holds, resolved.

    ``records`` holds both kinds of rows (``record=all``), so that a file is read once; with ``stacktraces`` it holds the samples alone.
    A stack may stand in an earlier batch of the file; the newest one up to the batch counts. An id that
    was never stored gives an empty, incomplete row. Batches with v2 records carry their stacks themselves.
    NULL mapping names stay NULL. Rows are folded per file, batch and stack before they are ordered.
    """
    if stacktraces is not None:
        records = records.withColumn("record", F.lit("samples")).unionByName(
            stacktraces.withColumn("record", F.lit("stacktraces")), allowMissingColumns=True)
    is_sample = F.col("record") == "samples"
    own = is_sample & (F.col("schema_version") == "v2")
    value = F.struct("is_complete", "locations")
    folded = records.groupBy("file", "batch", "stacktrace_id").agg(
        F.bool_or(is_sample).alias("_asked"),
        F.first(F.when(own, F.struct(F.lit(True).alias("is_complete"), "locations")), ignorenulls=True).alias("_own"),
        F.first(F.when(~is_sample, value), ignorenulls=True).alias("_stack"))
    upto = Window.partitionBy("file", "stacktrace_id").orderBy("batch").rowsBetween(Window.unboundedPreceding, 0)
    found = folded.withColumn("_found", F.coalesce("_own", F.last("_stack", ignorenulls=True).over(upto))).where("_asked")
    return found.select("file", "batch", "stacktrace_id", F.coalesce("_found.is_complete", F.lit(False)).alias("is_complete"),
                        F.col("_found.locations").alias("locations"))
