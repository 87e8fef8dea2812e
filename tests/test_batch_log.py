"""Off-line files written by hand, read back and replayed."""

import struct

import pyarrow as pa
import pyarrow.compute as pc
import pytest

from pyspark.sql import functions as F

from stackloom.session import shared_dir
from stackloom.sources import batch_log_sink
from stackloom.sources.batch_log import REPLAY_COLUMNS, plain, read_batch_log, replay_batch_log
from stackloom.sources.batch_log_sink import write_batch_log
from stackloom.sources.tables import batch_log_inventory

LINE = pa.struct([("line", pa.int64()), ("column", pa.uint64()), ("function_name", pa.string()),
                  ("function_system_name", pa.string()), ("function_filename", pa.string()), ("function_start_line", pa.int64())])
LOCATION = pa.struct([("address", pa.uint64()), ("frame_type", pa.string()), ("mapping_start", pa.uint64()),
                      ("mapping_file", pa.string()), ("mapping_build_id", pa.string()), ("lines", pa.list_(LINE))])
A, B, C = b"a" * 16, b"b" * 16, b"c" * 16
TEXTS = {"sample_type": "samples", "sample_unit": "count", "period_type": "cpu", "period_unit": "nanoseconds", "producer": "p"}


def stream(columns, version):
    table = pa.table(columns).replace_schema_metadata({"x_write_schema_version": version})
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="lz4")) as writer:
        writer.write_table(table)
    return sink.getvalue().to_pybytes()


def ree(values, kind):
    encoded = pc.run_end_encode(pa.array(values, kind))
    return pa.RunEndEncodedArray.from_arrays(encoded.run_ends, encoded.values.dictionary_encode())


def samples_v1(ids, **labels):
    n = len(ids)
    columns = {f"labels.{k}": ree(v, pa.string()) for k, v in labels.items()}
    columns |= {"stacktrace_id": ree(ids, pa.binary()), "timestamp": pa.array(range(n), pa.int64()),
                "value": pa.array([1] * n, pa.int64()), "period": ree([52] * n, pa.int64()).values.dictionary.take([0] * n),
                "duration": pa.array([10**9] * n, pa.int64()), "temporality": ree([None] * n, pa.string())}
    columns |= {k: ree([v] * n, pa.string()) for k, v in TEXTS.items()}
    return stream(columns, "v1")


def stacks_v1(stacks):
    rows = [None if f is None else [{"address": a, "frame_type": "native", "mapping_start": 0, "mapping_file": None,
                                     "mapping_build_id": None, "lines": None} for a in f] for f in stacks.values()]
    return stream({"stacktrace_id": pa.array(list(stacks), pa.binary()), "is_complete": pa.array([True] * len(stacks)),
                   "locations": pa.array(rows, pa.list_(LOCATION))}, "v1")


def samples_v2():
    line = pa.struct([("line", pa.uint64()), ("column", pa.uint64()),
                      ("function", pa.struct([("system_name", pa.string()), ("filename", pa.string()), ("start_line", pa.uint64())]))])
    location = pa.struct([("address", pa.uint64()), ("frame_type", pa.string()), ("mapping_file", pa.string()),
                          ("mapping_build_id", pa.string()), ("lines", pa.list_(line))])
    places = pa.array([
        {"address": 2**64 - 1, "frame_type": "kernel", "mapping_file": "k", "mapping_build_id": None,
         "lines": [{"line": 7, "column": 0, "function": {"system_name": "f", "filename": "m", "start_line": 0}}]},
        {"address": 5, "frame_type": "native", "mapping_file": "x", "mapping_build_id": "b", "lines": None}], location)
    # rows 0 and 2 share one stretch of the values, row 1 overlaps it
    values = pa.DictionaryArray.from_arrays(pa.array([0, 1, 0], pa.uint32()), places)
    stacktrace = pa.ListViewArray.from_arrays(pa.array([0, 1, 0], pa.int32()), pa.array([2, 2, 2], pa.int32()), values)
    ids = pa.ExtensionArray.from_storage(pa.uuid(), pa.array([A, B, A], pa.binary(16)))
    columns = {"labels": pa.StructArray.from_arrays(
        [pa.array(["n1", None, ""]).dictionary_encode(), pa.array(["x", "y", "z"])], ["node", "comm"]),
        "stacktrace": stacktrace, "stacktrace_id": ids, "value": pa.array([1, 2, 3], pa.int64()),
        "timestamp": pa.array([5, 6, 7], pa.timestamp("ns", "UTC")), "period": pa.array([1] * 3, pa.int64()),
        "duration": pa.array([10**9] * 3, pa.uint64()), "temporality": ree(["delta"] * 3, pa.string())}
    columns |= {k: ree([v] * 3, pa.string()) for k, v in TEXTS.items()}
    return stream(columns, "v2")


def write(path, records, count, tail=b"", magic=0xA6E7CCCA, version=0):
    data = struct.pack(">IHH", magic, version, count) + b"".join(struct.pack(">I", len(r)) + r for r in records) + tail
    if path.suffix == ".zst":
        with pa.CompressedOutputStream(str(path), "zstd") as out:
            out.write(data)
    else:
        path.write_bytes(data)


@pytest.fixture
def folder(tmp_path):
    first = [samples_v1([A, B, B], node=["n1", "n1", None]), stacks_v1({A: [1, 2], B: [3]})]
    second = [samples_v1([A, C], node=["n1", ""], app=["x", "y"]), stacks_v1({A: [9]})]
    write(tmp_path / "1-1.padata.zst", first + second, 2)
    # the header counts one batch: what a crash left behind it is ignored
    write(tmp_path / "2-1.padata", [samples_v1([B], node=["n2"]), stacks_v1({B: None})], 1, tail=b"\0\0\1\0torn")
    write(tmp_path / "3-1.padata", [samples_v2()], 1)
    (tmp_path / "notes.txt").write_text("x")
    return tmp_path


def test_samples(spark, folder):
    rows = {(r.file, r.batch, r.row): r for r in read_batch_log(spark, str(folder)).collect()}
    assert len(rows) == 3 + 2 + 1 + 3
    first = rows["1-1.padata.zst", 0, 0]
    assert (bytes(first.stacktrace_id), first["labels"], first.value, first.temporality, first.locations) == (A, {"node": "n1"}, 1, None, None)
    assert rows["1-1.padata.zst", 0, 2]["labels"] == {}
    assert rows["1-1.padata.zst", 1, 1]["labels"] == {"app": "y"}
    v2 = [rows["3-1.padata", 0, i] for i in range(3)]
    assert [(r.schema_version, r.ts_ns, r["labels"]) for r in v2] == [
        ("v2", 5, {"node": "n1", "comm": "x"}), ("v2", 6, {"comm": "y"}), ("v2", 7, {"comm": "z"})]
    assert [[x.address for x in r.locations] for r in v2] == [[-1, 5], [5, -1], [-1, 5]]
    line = v2[0].locations[0].lines[0]
    assert (line.line, line.function_system_name, line.function_filename, line.function_name) == (7, "f", "m", None)
    assert v2[0].locations[1].lines is None


def test_partitions_split_by_size(spark, folder):
    assert read_batch_log(spark, str(folder), partition_bytes="1").rdd.getNumPartitions() == 3
    assert read_batch_log(spark, str(folder), partition_bytes="1").count() == 9


def test_replay(spark, folder):
    path = str(folder)
    rows = replay_batch_log(read_batch_log(spark, path), read_batch_log(spark, path, "stacktraces")).collect()
    got = {(r.file[0], r.batch, bytes(r.stacktrace_id)): (
        r.is_complete, None if r.locations is None else [x.address for x in r.locations]) for r in rows}
    assert got == {
        ("1", 0, A): (True, [1, 2]), ("1", 0, B): (True, [3]),
        ("1", 1, A): (True, [9]),                # stored again: the newest one counts
        ("1", 1, C): (False, None),              # never stored
        ("2", 0, B): (True, None), ("3", 0, A): (True, [-1, 5]), ("3", 0, B): (True, [5, -1])}


def test_inventory(spark, folder):
    got = {r.kind: (r.files, r.bytes > 0) for r in batch_log_inventory(spark, str(folder)).collect()}
    assert got == {"compressed": (1, True), "open": (2, True), "unknown": (1, True)}


@pytest.mark.parametrize("options", [{"magic": 1}, {"version": 3}])
def test_foreign_files_fail(spark, tmp_path, options):
    write(tmp_path / "1-1.padata", [], 0, **options)
    with pytest.raises(Exception, match="magic|version"):
        read_batch_log(spark, str(tmp_path)).collect()


def test_empty_folder(spark, tmp_path):
    assert read_batch_log(spark, str(tmp_path)).count() == 0


def test_plain_keeps_nulls():
    array = pc.run_end_encode(pa.array(["a", "a", None, "b"]))
    assert plain(array).to_pylist() == ["a", "a", None, "b"]
    views = pa.array([[1, 2], None, [], [3]], pa.list_view(pa.int64()))
    assert plain(views).to_pylist() == [[1, 2], None, [], [3]]


# --- both kinds of records, columns and filters ------------------------------------------------------------------------------

def by_place(rows):
    return sorted((r.asDict(recursive=True) for r in rows), key=lambda r: (r["record"], r["file"], r["batch"], r["row"] or 0, bytes(r["stacktrace_id"])))


def test_all_records_in_one_pass(spark, folder):
    path = str(folder)
    rows = read_batch_log(spark, path, "all")
    for kind, count in (("samples", 9), ("stacktraces", 4)):
        one = read_batch_log(spark, path, kind)
        same = rows.where(F.col("record") == kind).select(one.columns)
        key = lambda r: str(r)
        assert sorted(same.collect(), key=key) == sorted(one.collect(), key=key) and one.count() == count
    twice = replay_batch_log(read_batch_log(spark, path), read_batch_log(spark, path, "stacktraces")).collect()
    once = replay_batch_log(read_batch_log(spark, path, "all", REPLAY_COLUMNS))
    assert once._jdf.queryExecution().executedPlan().toString().count("BatchScan") == 1
    assert sorted(map(str, once.collect())) == sorted(map(str, twice))


def test_columns_are_chosen(spark, folder, monkeypatch):
    rows = read_batch_log(spark, str(folder), columns=["value", "file"])
    assert rows.columns == ["value", "file"] and sorted(r.value for r in rows.collect()) == [1] * 7 + [2, 3]
    with pytest.raises(Exception, match="no columns"):
        read_batch_log(spark, str(folder), columns=["nothing"])
    from stackloom.sources import batch_log
    table = pa.table({"timestamp": pa.array([1]), "value": pa.array([2]), "labels.x": pa.array(["y"]), "stacktrace_id": pa.array([A])})
    monkeypatch.setattr(batch_log, "label_maps", None)  # labels that nobody wants are not decoded
    assert batch_log.sample_columns(table, "v1", {"value"})["value"].to_pylist() == [2]


def test_selected_files(spark, folder):
    (folder / "4-1.padata").write_bytes(b"no batch log")  # any task that opens it fails
    for patterns, files in ((["3-1.padata"], {"3-1.padata"}), (["1-*", "2-*"], {"1-1.padata.zst", "2-1.padata"}), (["[12]-*.zst"], {"1-1.padata.zst"})):
        rows = read_batch_log(spark, str(folder), "all", files=patterns, partition_bytes="1")
        assert rows.rdd.getNumPartitions() == len(files) and {r.file for r in rows.collect()} == files
        assert rows.where("record = 'samples'").union(rows.where("record <> 'samples'")).count() == rows.count()  # used twice in a plan
    assert read_batch_log(spark, str(folder), files=[]).count() == 0
    with pytest.raises(Exception, match="magic|ends after"):
        read_batch_log(spark, str(folder), "all").collect()


# --- the stream ------------------------------------------------------------------------------------------------------------

def take(spark, path, out, checkpoint):
    """What a run of the stream over all that is there adds."""
    rows = read_batch_log(spark, path, "all", ["record", "file", "batch", "value"], streaming=True)
    before = spark.read.parquet(out).count() if checkpoint.exists() else 0
    query = rows.writeStream.option("checkpointLocation", str(checkpoint)).trigger(availableNow=True).start(out, format="parquet")
    query.awaitTermination()
    return (spark.read.parquet(out).count() if checkpoint.exists() else 0) - before


def test_stream_takes_every_batch_once(spark, tmp_path):
    folder, out, checkpoint = tmp_path / "in", str(tmp_path / "out"), tmp_path / "checkpoint"
    folder.mkdir()
    records = [samples_v1([A, B], node=["n", "n"]), stacks_v1({A: [1]}), samples_v1([B], node=["n"]), stacks_v1({B: [2]}),
               samples_v1([A], node=["n"]), stacks_v1({})]
    write(folder / "1-1.padata", records[:2], 1, tail=b"\0\0\1\0torn")
    (folder / "_staging").mkdir()
    write(folder / "_staging" / "9-9.padata", records[:2], 1)
    assert take(spark, str(folder), out, checkpoint) == 3
    write(folder / "1-1.padata", records[:4], 2)  # the torn batch is written again, and counted
    write(folder / "2-1.padata.zst", records[:2], 1)
    assert take(spark, str(folder), out, checkpoint) == 2 + 3
    assert take(spark, str(folder), out, checkpoint) == 0  # a restart repeats nothing
    (folder / "1-1.padata").unlink()
    write(folder / "1-1.padata.zst", records, 3)  # goes on under its name when compressed
    assert take(spark, str(folder), out, checkpoint) == 1
    (folder / "2-1.padata.zst").unlink()
    assert take(spark, str(folder), out, checkpoint) == 0
    rows = spark.read.parquet(out)
    assert rows.groupBy("file", "batch", "record").count().where("count > 2").count() == 0
    assert {(r.file, r.batch) for r in rows.collect()} == {("1-1.padata", 0), ("1-1.padata", 1), ("1-1.padata", 2), ("2-1.padata", 0)}


# --- the sink --------------------------------------------------------------------------------------------------------------

@pytest.mark.parametrize("compress", [True, False])
def test_sink_and_back(spark, folder, tmp_path, compress):
    rows = read_batch_log(spark, str(folder), "all")
    path = shared_dir(spark, "sink")
    write_batch_log(rows, path, compress=compress)
    back = read_batch_log(spark, path, "all")
    stem = F.regexp_replace("file", r"\.padata(\.zst)?$", "")
    assert by_place(back.withColumn("file", stem).collect()) == by_place(rows.withColumn("file", stem).collect())
    names = {r.path.rsplit("/", 1)[-1] for r in spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path").collect()}
    assert names == {f"{n}-1.padata{'.zst' if compress else ''}" for n in (1, 2, 3)}
    with pytest.raises(Exception, match="written twice"):
        write_batch_log(rows, path, compress=compress)
    assert back.count() == rows.count()
    write_batch_log(rows.where("file like '1%'"), path, mode="overwrite", compress=compress)
    assert {r.file[0] for r in read_batch_log(spark, path).collect()} == {"1"}


def test_task_that_dies_half_way(spark, folder, tmp_path):
    path = tmp_path / "sink"
    rows = read_batch_log(spark, str(folder), "all")
    write_batch_log(rows.where("file like '1%'"), str(path))
    broken = rows.withColumn("file", F.concat(F.lit("x"), "file")).withColumn("value", F.when(F.col("file").like("x3%"), F.raise_error("killed")).otherwise(F.col("value")))
    with pytest.raises(Exception, match="killed"):
        write_batch_log(broken, str(path))
    assert read_batch_log(spark, str(path)).count() == 5 and sorted(p.name for p in path.iterdir() if not p.name.startswith(".")) == ["1-1.padata.zst"]


def test_writer_holds_one_batch(spark, tmp_path, monkeypatch):
    """Batches are on disk before the next one is looked at; an attempt that ends early leaves no file in place."""
    from pyspark.sql.types import StructType

    from stackloom.sources.batch_log import FIELDS, BatchLogReader
    schema = StructType.fromDDL(", ".join(f"{n} {kind}" for n, kind in FIELDS["all"].items()))
    added = []
    add = batch_log_sink._File.add
    monkeypatch.setattr(batch_log_sink._File, "add", lambda self, rows: (added.append(len(rows)), add(self, rows)))
    writer = batch_log_sink.BatchLogWriter(f"file://{tmp_path}", schema, False, True)
    kinds = pa.schema([("record", pa.string()), ("file", pa.string()), ("batch", pa.int32()), ("schema_version", pa.string()),
                       ("labels", pa.map_(pa.string(), pa.string())), ("stacktrace_id", pa.binary()), ("ts_ns", pa.int64()),
                       ("is_complete", pa.bool_()), ("locations", pa.list_(LOCATION)), *[(n, pa.int64()) for n in ("value", "period", "duration")],
                       *[(n, pa.string()) for n in (*TEXTS, "temporality")]])

    def chunks(stop):
        for i in range(6):
            if i == stop:
                raise RuntimeError("killed")
            assert len(added) == max(0, i - 1)
            yield pa.RecordBatch.from_pylist([{"record": "samples", "file": "f", "batch": i, "schema_version": "v1", "labels": [("k", str(i))],
                                               "stacktrace_id": A, "ts_ns": i, "value": i, "period": 1, "duration": 1}], kinds)

    with pytest.raises(RuntimeError):
        writer.write(chunks(4))
    assert not list(tmp_path.glob("*.zst"))
    added.clear()
    writer.commit([writer.write(chunks(None)), None])
    assert [p.name for p in tmp_path.iterdir()] == ["f.padata.zst"]
    reader = BatchLogReader(StructType.fromDDL("file string, batch int, labels map<string,string>, value bigint"), f"file://{tmp_path}", "samples")
    found = pa.Table.from_batches(b for p in reader.partitions() for b in reader.read(p)).to_pylist()
    assert [(r["batch"], r["value"], r["labels"]) for r in found] == [(i, i, [("k", str(i))]) for i in range(6)]
