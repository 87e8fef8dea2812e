"""Off-line batch logs as a sink, in two phases.

A task writes every file it has rows of, one batch at a time, below a staging folder that readers do not look at: first the
batches, then, when their number is known, a header in front of a copy of them (compressed streams may be concatenated, so
nothing is compressed twice). Only when all tasks have ended well does the driver move the finished files into place. A task that
dies half way leaves whole files of earlier jobs and nothing of its own in the folder, and no file is ever held in memory.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from stackloom.session import qualified, ship_package
from stackloom.sources.batch_log import _TEXT, FORMAT_VERSION, HEADER, LENGTH, MAGIC, SUFFIXES, BatchLogSource, _file_system

NUMBERS = ("value", "period", "duration")
MOST_BATCHES = 2**16 - 1
CHUNK = 1 << 20
TAG = "agent_write_schema_version"


@dataclass
class Written(WriterCommitMessage):
    """Finished files of a task: final name and where it waits."""

    files: dict[str, str] = field(default_factory=dict)


def runs(array: pa.Array) -> pa.Array:
    """Run-end encoded dictionary, the way samples are stored."""
    encoded = pc.run_end_encode(array)
    return pa.RunEndEncodedArray.from_arrays(encoded.run_ends, encoded.values.dictionary_encode())


def stream_of(table: pa.Table, version: str) -> bytes:
    sink = pa.BufferOutputStream()
    table = table.replace_schema_metadata({TAG: version})
    # Records are small and tasks fill the cores: handing each buffer to a thread costs more than compressing it.
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="lz4", use_threads=False)) as writer:
        writer.write_table(table)
    return sink.getvalue().to_pybytes()


def label_columns(labels: pa.Array) -> dict[str, pa.Array]:
    """A column for every label that occurs, in order of name; NULL where a row lacks it."""
    keys, items = labels.keys, labels.items
    offsets = labels.offsets.to_numpy()
    row = np.repeat(np.arange(len(labels)), np.diff(offsets))
    keys, items = keys.slice(offsets[0], len(row)), items.slice(offsets[0], len(row))
    columns = {}
    for name in sorted(pc.unique(keys).to_pylist()):
        at = np.flatnonzero(pc.equal(keys, name).to_numpy(zero_copy_only=False))
        place = np.full(len(labels), -1)
        place[row[at]] = at
        columns[name] = items.take(pa.array(place, mask=place < 0))
    return columns


def sample_record(rows: pa.Table, version: str) -> bytes:
    column = lambda n: rows[n].combine_chunks()
    labels = label_columns(column("labels"))
    if version == "v1":
        out = {f"labels.{n}": runs(v) for n, v in labels.items()}
        out["stacktrace_id"] = runs(column("stacktrace_id"))
    else:
        out = {"labels": pa.StructArray.from_arrays([runs(v) for v in labels.values()], list(labels)) if labels
               else pa.array([{}] * len(rows), pa.struct([])),
               "stacktrace": column("locations"), "stacktrace_id": column("stacktrace_id")}
    out["timestamp"] = column("ts_ns")
    out |= {n: column(n) for n in NUMBERS}
    out |= {n: runs(column(n)) for n in _TEXT}
    return stream_of(pa.table(out), version)


def stack_record(rows: pa.Table) -> bytes:
    return stream_of(rows.select(["stacktrace_id", "is_complete", "locations"]), "v1")


class _File:
    """One file in the making: batches go to a body, the header with their number in front comes last."""

    def __init__(self, system: fs.FileSystem, folder: str, name: str, compress: bool):
        self.system, self.compress, self.batches = system, compress, 0
        self.body, self.whole = f"{folder}/{name}.body", f"{folder}/{name}"
        system.create_dir(folder, recursive=True)
        self.out = system.open_output_stream(self.body, compression="zstd" if compress else None)

    def add(self, rows: pa.Table) -> None:
        if self.batches == MOST_BATCHES:
            raise ValueError(f"{self.whole}: a file holds {MOST_BATCHES} batches at most; use shorter files")
        is_sample = pc.equal(rows["record"], "samples")
        samples, stacks = rows.filter(is_sample), rows.filter(pc.invert(is_sample))
        versions = pc.unique(samples["schema_version"]).to_pylist() if "schema_version" in rows.column_names else []
        version = "v2" if versions == ["v2"] else "v1"
        if len(versions) > 1 or (version == "v2" and len(stacks)):
            raise ValueError(f"{self.whole}: a batch holds records of one version, and v2 batches no stacks of their own")
        for record in [sample_record(samples, version), *([stack_record(stacks)] if version == "v1" else [])]:
            self.out.write(LENGTH.pack(len(record)))
            self.out.write(record)
        self.batches += 1

    def finish(self) -> str:
        self.out.close()
        header = HEADER.pack(MAGIC, FORMAT_VERSION, self.batches)
        with self.system.open_output_stream(self.whole, compression=None) as out, \
                self.system.open_input_stream(self.body, compression=None) as body:
            out.write(pa.compress(header, codec="zstd", asbytes=True) if self.compress else header)
            while chunk := body.read(CHUNK):
                out.write(chunk)
        self.system.delete_file(self.body)
        return self.whole


class BatchLogWriter(DataSourceArrowWriter):
    """Rows in the layout of ``record=all``: of a file together, by batch, samples before stacks."""

    def __init__(self, path: str, schema: StructType, overwrite: bool, compress: bool):
        missing = sorted({"record", "file", "batch", "stacktrace_id", "labels", "ts_ns", "is_complete", "locations", *NUMBERS, *_TEXT} - set(schema.names))
        if missing:
            raise ValueError(f"rows for a batch log lack {missing}")
        self.path, self.overwrite, self.compress = path, overwrite, compress
        self.staging = f"_staging-{uuid.uuid4().hex}"

    def _name(self, file: str) -> str:
        stem = file.removesuffix(".zst").removesuffix(".padata")
        if not stem or "/" in stem or stem[0] in "_.":
            raise ValueError(f"{file!r} is no name for a batch log")
        return f"{stem}{SUFFIXES[0] if self.compress else SUFFIXES[1]}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, root = _file_system(self.path)
        folder = f"{root}/{self.staging}/{uuid.uuid4().hex}"  # an attempt of its own
        done, current, at, parts = Written(), None, None, []

        def end_batch() -> None:
            if parts:
                current.add(pa.concat_tables(parts))
                parts.clear()

        def end_file() -> None:
            if current is not None:
                end_batch()
                done.files[at[0]] = current.finish()

        for chunk in iterator:
            table = pa.Table.from_batches([chunk])
            files, numbers = table["file"].to_numpy(zero_copy_only=False), table["batch"].to_numpy()
            change = np.flatnonzero((files[1:] != files[:-1]) | (numbers[1:] != numbers[:-1])) + 1
            for start, end in zip([0, *change], [*change, table.num_rows], strict=True) if table.num_rows else ():
                place = self._name(files[start]), int(numbers[start])
                if at is None or place[0] != at[0]:
                    end_file()
                    if place[0] in done.files:
                        raise ValueError(f"{place[0]}: rows of a file have to come together")
                    current = _File(system, folder, place[0], self.compress)
                elif place != at:
                    end_batch()
                at = place
                parts.append(table.slice(start, end - start))
        end_file()
        return done

    def commit(self, messages: list[Written | None]) -> None:
        system, root = _file_system(self.path)
        moves = [move for m in messages if m is not None for move in m.files.items()]
        names = [name for name, _ in moves]
        there = {f.base_name for f in system.get_file_info(fs.FileSelector(root, allow_not_found=True))
                 if f.is_file and f.base_name.endswith(SUFFIXES)}
        twice = sorted({n for n in names if names.count(n) > 1} if len(names) != len(set(names)) else () if self.overwrite else there & set(names))
        if twice:
            self.abort(messages)
            raise ValueError(f"files written twice: {twice[:5]}")
        for name, waiting in moves:
            if name in there:
                system.delete_file(f"{root}/{name}")
            system.move(waiting, f"{root}/{name}")
        if self.overwrite:
            for name in there - set(names):
                system.delete_file(f"{root}/{name}")
        self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        system, root = _file_system(self.path)
        if system.get_file_info(f"{root}/{self.staging}").type == fs.FileType.Directory:
            system.delete_dir(f"{root}/{self.staging}")


def write_batch_log(records: DataFrame, path: str, mode: str = "append", compress: bool = True) -> None:
    """Rows in the layout of ``record=all`` into one file per value of ``file``, its batches in order of ``batch``.

    A file is the work of one task, as it is of one host and rotation interval; tasks take files by a hash of their name.
    """
    spark = records.sparkSession
    ship_package(spark)
    spark.dataSource.register(BatchLogSource)
    order = [c for c in ("ts_ns", "row") if c in records.columns]
    (records.repartition("file").sortWithinPartitions("file", "batch", "record", *order)
     .write.format("batch_log").option("compress", str(compress).lower()).mode(mode).save(qualified(spark, path)))
