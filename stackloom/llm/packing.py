"""Best-fit packing of documents into sequences of several permitted lengths.

A document longer than the largest capacity is cut into full sequences and a rest; rests and short documents are packed by
best fit, longest first. A piece goes to the open bin with the least room that still holds it; if none does, a bin is opened
in the size with the least cost for what is still to come (the padding a piece would leave in it, weighed against the chance
to fill it: a size is worth its cost while shorter pieces remain that could use the room). At the end every bin is cut down to
the smallest permitted length that holds its contents.

Packing is done in shards of bounded size. Shards are dealt by a hash of the document, so each holds the same mix of lengths
and the padding that sharding adds stays below one open bin per capacity and shard. Only lengths travel, never texts.
"""

from __future__ import annotations

import math
from bisect import bisect_left, insort

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stackloom.llm.text import split_words

CHARS_PER_TOKEN = 6  # only to size shards
BIN = "bin_id string, capacity long, used long, doc_ids array<long>, begins array<long>, lengths array<long>"


def pack(lengths: list[int], capacities: list[int]) -> list[tuple[int, list[int]]]:
    """Bins as (capacity, indices into ``lengths``); every length must fit the largest capacity. Zero lengths are left out."""
    sizes = sorted(capacities)
    order = sorted((i for i, n in enumerate(lengths) if n > 0), key=lambda i: (-lengths[i], i))
    remaining = sum(lengths[i] for i in order)
    bins: list[tuple[int, list[int]]] = []
    rooms: list[tuple[int, int]] = []  # (room, bin), sorted
    for i in order:
        n = lengths[i]
        at = bisect_left(rooms, (n, -1))
        if at < len(rooms):
            room, b = rooms.pop(at)
        else:
            # later pieces are no longer than this one: cost is the room that even all of them could not fill
            b = len(bins)
            fitting = [c for c in sizes if c >= n]
            room = min(fitting, key=lambda c: (max(0, c - remaining), _overhead(c, n), -c))
            bins.append((room, []))
        bins[b][1].append(i)
        remaining -= n
        if room > n:
            insort(rooms, (room - n, b))
    return [(next(c for c in sizes if c >= sum(lengths[i] for i in members)), members) for _, members in bins]


def _overhead(capacity: int, length: int) -> int:
    """Padding of a bin filled with pieces of this length only."""
    return capacity % length if length else 0


def packed(docs: DataFrame, capacities: tuple[int, ...] = (512, 1024, 2048, 4096), tokens: Column | None = None,
           shard_tokens: int = 2_000_000) -> DataFrame:
    """Bins over all rows of ``docs`` (doc_id, text): capacity, used, and the pieces by doc_id, first token and length.

    ``tokens`` counts the tokens of a row; by default a word and the break after it is one. Null or empty texts have no tokens
    and no piece. Every token of every row is in exactly one bin. Rows that repeat a doc_id are packed one by one; a null
    doc_id is kept as null. Equal lengths are taken in order of doc_id. Bin ids name shard and number, or the document and
    number of a full sequence (these repeat if a doc_id does); an empty table has no bins; other columns are ignored.
    """
    count = F.size(split_words(F.coalesce(F.col("text").cast("string"), F.lit("")))) if tokens is None else tokens
    chars = docs.agg(F.sum(F.length(F.col("text").cast("string")).cast("long"))).first()[0] or 0
    shards = max(1, math.ceil(chars / (CHARS_PER_TOKEN * shard_tokens)))
    sized = docs.select(F.col("doc_id").cast("long"), count.cast("long").alias("n"))
    # rows without tokens go along (a filter would count the words once more) and make no piece
    dealt = sized.withColumn("shard", F.pmod(F.xxhash64("doc_id", "n"), F.lit(shards).cast("long")))
    largest = max(capacities)

    def fill(key, table):
        shard = key[0].as_py()
        table = table.sort_by([("doc_id", "ascending"), ("n", "ascending")])
        ids, sizes = table["doc_id"].to_pylist(), table["n"].to_pylist()
        # full sequences of long documents are bins already, only what is left over is packed
        bins = [(f"full-{'null' if d is None else d}-{k}", largest, [(d, k * largest, largest)])
                for d, n in zip(ids, sizes) for k in range(n // largest)]
        pieces = [(d, n - n % largest, n % largest) for d, n in zip(ids, sizes)]
        bins += [(f"{shard}-{b}", capacity, [pieces[i] for i in members])
                 for b, (capacity, members) in enumerate(pack([n for _, _, n in pieces], list(capacities)))]
        pick = lambda i: pa.array([[p[i] for p in members] for _, _, members in bins], pa.list_(pa.int64()))
        return pa.table({
            "bin_id": pa.array([b for b, _, _ in bins], pa.string()), "capacity": pa.array([c for _, c, _ in bins], pa.int64()),
            "used": pa.array([sum(p[2] for p in members) for _, _, members in bins], pa.int64()),
            "doc_ids": pick(0), "begins": pick(1), "lengths": pick(2)})

    return dealt.groupBy("shard").applyInArrow(fill, BIN)
