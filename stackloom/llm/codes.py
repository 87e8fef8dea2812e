"""Vector codes: parts of vectors as numbers of codebook entries, with distances read from dictionaries of values.

Components are integers, and an embedding has few different ones per dimension. So vectors are stored by blocks: for each
dimension a dictionary of its distinct integers, and for each vector the place of its component there. A round tabulates the
squared differences of every dictionary value to the same component of all entries once; the distance of a part to an entry is
then a sum of gathered table cells. All arithmetic is on integers and exact.

Blocks are bounded, rounds read them from a table in the shared folder, and what a round gathers is one sum for each entry and
component, whatever the input. The codebooks (parts x entries x width integers) are the only state between rounds.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stackloom.session import stored

BLOCK_ROWS = 16_384
#: Up to this size of components no distance of a part of 4,096 components passes 63 bits; beyond it Python's integers do the work.
SMALL = 2**24
#: Sums travel in pieces of 30 digits, so that a sum of pieces stays within 38.
PIECE = 10**30
BLOCK = "ids array<long>, labels array<string>, values array<array<string>>, codes binary"
SUM = "part int, entry int, place int, piece int, n long, total decimal(38,0)"
CODED = "vec_id long, label string, code string, error decimal(38,0)"


def _integers(values: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale x) of finite values: int64 where they are small, else exact Python integers."""
    scaled = np.floor(values * scale) if (np.abs(values) < SMALL / scale).all() else None
    if scaled is not None:
        return scaled.astype(np.int64)
    whole = np.empty(len(values), dtype=object)
    for i, v in enumerate(values.tolist()):
        n, d = v.as_integer_ratio()
        whole[i] = n * scale // d
    return whole


def _blocks(ids: pa.Array, labels: pa.Array, vectors: pa.Array, width: int, scale: int) -> list[dict]:
    flat = _integers(vectors.flatten().to_numpy(zero_copy_only=False).astype(float), scale).reshape(-1, width)
    values, codes = [], []
    for column in flat.T:
        distinct, code = np.unique(column, return_inverse=True)
        values.append([str(v) for v in distinct])
        codes.append(code.astype("<u2"))
    return [{"ids": ids.to_pylist(), "labels": labels.to_pylist(), "values": values, "codes": np.stack(codes).tobytes()}]


class _Block:
    """Codes (dimension x vector) and the dictionary of each dimension."""

    def __init__(self, row: dict):
        self.ids, self.labels = row["ids"], row["labels"]
        integers = [[int(v) for v in column] for column in row["values"]]
        small = all(-SMALL <= column[0] and column[-1] <= SMALL for column in integers)
        self.values = [np.array(column, dtype=np.int64 if small else object) for column in integers]
        self.codes = np.frombuffer(row["codes"], "<u2").reshape(len(integers), -1)

    def assign(self, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of the nearest entry (ties: the lowest) and squared distance, both part x vector."""
        parts, entries, width = books.shape
        nearest, distance = [], []
        small = all(abs(v) <= SMALL for v in books.ravel())
        for p in range(parts):
            total = None
            for d in range(width):
                values = self.values[p * width + d] if small else self.values[p * width + d].astype(object)
                table = (values[:, None] - books[p, :, d].astype(values.dtype)[None, :]) ** 2
                total = table[self.codes[p * width + d]] if total is None else total + table[self.codes[p * width + d]]
            best = np.argmin(total, axis=1) if total.dtype != object else np.array([min(range(entries), key=row.__getitem__) for row in total], dtype=int)
            nearest.append(best)
            distance.append(total[np.arange(len(best)), best])
        return np.array(nearest), np.array(distance)

    def sums(self, nearest: np.ndarray, entries: int) -> list[tuple]:
        """(part, entry, place, piece, number, sum of components) of the entries in use, from counts of dictionary codes."""
        out, width = [], len(self.values) // len(nearest)
        for p, entry in enumerate(nearest):
            number = np.bincount(entry, minlength=entries)
            for d in range(width):
                values = self.values[p * width + d]
                seen = np.bincount(entry * len(values) + self.codes[p * width + d], minlength=entries * len(values)).reshape(entries, -1)
                total = seen.astype(values.dtype) @ values
                out += [(p, e, d, i, int(number[e]), v) for e in np.flatnonzero(number) for i, v in enumerate(_pieces(int(total[e])))]
        return out


def _pieces(value: int) -> list[int]:
    sign, value, out = (-1 if value < 0 else 1), abs(value), []
    while value or not out:
        value, piece = divmod(value, PIECE)
        out.append(sign * piece)
    return out


def _decimals(values: list[int]) -> pa.Array:
    """As decimals of 38 digits; null where a value has more."""
    return pa.array([v if abs(v) < 10**38 else None for v in values], pa.decimal128(38, 0))


def vector_codes(vectors: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096) -> DataFrame:
    """(vec_id, label, code, error, label_error, codebooks_sha256) per row of ``vectors`` (vec_id, embedding, label) that is kept.

    Rows whose vector is null or empty or holds a null or a component that is not finite are dropped, as are those whose length
    is no multiple of ``parts`` or differs from that of the first kept vector (by vec_id). A component x counts as
    floor(scale x). Codebooks start as the parts of the ``entries`` rows with the smallest vec_id (equal ids: in order of the
    vector; null ids last; fewer rows make fewer entries); a round assigns each part to the nearest entry, the first of equals, and
    replaces an entry by floor(sum / count) of its parts. ``code`` has two hex digits per part. ``error`` is the sum of squared
    distances, ``label_error`` its sum over rows of equal label (nulls are one label); null where it passes 63 bits. Repeated rows
    count each time. An empty table gives an empty result; other columns are ignored.
    """
    e = F.col("embedding")
    sound = e.isNotNull() & (F.size(e) > 0) & (F.size(e) % parts == 0) & F.forall(
        e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < math.inf))
    label = F.col("label")
    rows = vectors.where(sound).select(F.col("vec_id").cast("long").alias("vec_id"), e.cast("array<double>").alias("embedding"),
                                       label.cast("string").alias("label"))
    # the first rows twice: by their ids alone, then with their length
    order = [F.col("vec_id").asc_nulls_last(), F.col("embedding")]
    head = rows.orderBy(*order).limit(1).select(F.size("embedding").alias("width")).first()
    width = head["width"] if head else parts
    rows = rows.where(F.size("embedding") == width)
    seeds = rows.orderBy(*order).limit(entries).select("embedding").toArrow()["embedding"].combine_chunks()
    books = _integers(seeds.flatten().to_numpy(zero_copy_only=False), scale) if len(seeds) else np.zeros(0, np.int64)
    books = books.reshape(len(seeds), parts, width // parts).transpose(1, 0, 2).astype(object)

    def pack(batches):
        for b in batches:
            for start in range(0, b.num_rows, BLOCK_ROWS):
                part = b.slice(start, BLOCK_ROWS)
                found = _blocks(part.column("vec_id"), part.column("label"), part.column("embedding"), width, scale)
                yield pa.RecordBatch.from_pylist(found, pa.schema([
                    ("ids", pa.list_(pa.int64())), ("labels", pa.list_(pa.string())), ("values", pa.list_(pa.list_(pa.string()))), ("codes", pa.binary())]))

    blocks = stored(rows.mapInArrow(pack, BLOCK), "blocks")

    def added(books):
        def add(batches):
            for b in batches:
                for row in b.to_pylist():
                    block = _Block(row)
                    found = block.sums(block.assign(books)[0], books.shape[1])
                    kinds = (pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.decimal128(38, 0))
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found), kinds)], ["part", "entry", "place", "piece", "n", "total"])

        sums = blocks.mapInArrow(add, SUM).groupBy("part", "entry", "place", "piece").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
        found: dict[tuple, list[int]] = {}
        for r in sums.collect():  # a row per entry, component and piece
            total = found.setdefault((r["part"], r["entry"], r["place"]), [0, 0])
            total[0] += int(r["total"]) * PIECE ** r["piece"]
            total[1] = max(total[1], r["n"])  # every part of an entry has the first piece
        books = books.copy()
        for at, (total, n) in found.items():
            books[at] = total // n
        return books

    for _ in range(rounds if len(seeds) else 0):
        books = added(books)
    written = hashlib.sha256(",".join(str(int(v)) for v in books.ravel()).encode()).hexdigest()

    def code(batches):
        for b in batches:
            for row in b.to_pylist():
                block = _Block(row)
                nearest, distance = block.assign(books)
                codes = np.ascontiguousarray(nearest.T.astype(np.uint8))
                yield pa.RecordBatch.from_arrays([
                    pa.array(block.ids, pa.int64()), pa.array(block.labels, pa.string()), pa.array([c.tobytes().hex() for c in codes], pa.string()),
                    _decimals([int(v) for v in distance.sum(axis=0)])], ["vec_id", "label", "code", "error"])

    coded = blocks.mapInArrow(code, CODED)
    by_label = coded.groupBy(F.col("label").alias("of")).agg(F.when(F.count("error") == F.count("*"), F.sum("error")).alias("label_error"))
    small = lambda c: F.col(c).try_cast("long").alias(c)
    return (coded.join(by_label, F.col("label").eqNullSafe(F.col("of")))
            .select("vec_id", F.col("label").cast(vectors.schema["label"].dataType).alias("label"), "code", small("error"), small("label_error"),
                    F.lit(written).alias("codebooks_sha256")))
