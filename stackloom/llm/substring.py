"""Substring deduplication: every window of so many words that an earlier document holds is cut out.

Rabin-Karp hashes of all windows are counted in Spark: batches of documents, in order of doc_id, send their distinct window
hashes to buckets, and a bucket answers which of them an earlier batch holds too. Inside a batch the first document of a hash
is known. Windows to remove are merged into maximal intervals. Windows count as equal if two independent hashes of theirs
agree, 61 bits modulo a prime and 32 bits of another kind, so that chance finds no pair among 10**13 windows.
"""

from __future__ import annotations

import math
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stackloom.llm import exchange
from stackloom.llm.words import rolling, rolling_check, runs_within, words_of

MOST_CUTS = 4096
REMOVED = "doc_id long, n_words long, n_removed long, removed array<struct<begin: long, end: long>>, kept string"


def _ordered(table: pa.Table) -> tuple[pa.Array, np.ndarray, pa.Array]:
    """The batch in order of doc_id (null last), with the rank of each row's doc_id."""
    table = table.combine_chunks().sort_by([("doc_id", "ascending")])
    ids = table["doc_id"].combine_chunks()
    known = ids.drop_null().to_numpy()
    rank = np.r_[np.cumsum(np.r_[0, known[1:] != known[:-1]]) if len(known) else [],
                 np.full(ids.null_count, len(known))].astype(np.int64)
    return ids, rank, table["text"].combine_chunks()


def _windows(texts, rank: np.ndarray, length: int):
    """Distinct hashes (both kinds), and for each window its place (first word), the number of its hash and the rank of its row."""
    words = words_of(texts)
    inside = np.flatnonzero(runs_within(words, length))
    hashes, checks = rolling(words.hash, length)[inside], rolling_check(words.hash, length)[inside]
    distinct, first, number = np.unique(hashes, return_index=True, return_inverse=True)
    if (checks[first][number] != checks).any():  # different windows of one hash
        both = np.empty(len(hashes), dtype=[("hash", "<u8"), ("check", "<u4")])
        both["hash"], both["check"] = hashes, checks
        pairs, first, number = np.unique(both, return_index=True, return_inverse=True)
        distinct = np.ascontiguousarray(pairs["hash"])
    ranks = rank[words.text_of_word()[inside]]
    return words, (distinct, checks[first]), inside, number, ranks, ranks[first]


def _earlier(keys: np.ndarray, checks: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Whether each window stands in an earlier blob too; ``order`` sorts the keys, earlier blobs first."""
    same, agree = keys[order][1:] == keys[order][:-1], checks[order][1:] == checks[order][:-1]
    if (same & ~agree).any():
        order = np.lexsort((checks, keys))
        same, agree = keys[order][1:] == keys[order][:-1], checks[order][1:] == checks[order][:-1]
    seen = np.empty(len(keys), dtype=bool)
    seen[order] = np.r_[False, same & agree] if len(keys) else []
    return seen


def in_order(rows: DataFrame, n: int, most_cuts: int = MOST_CUTS) -> DataFrame:
    """``rows`` with ``batch``: about ``n`` batches of like size that follow the order of doc_id (null: the last one).

    The driver sees ``most_cuts`` quantiles at most. Beyond that every stretch between two of them is cut again by quantiles of
    its own, which are worked out in Spark and reach the rows by a join.
    """
    def quantiles(frame, parts):
        shares = [i / parts for i in range(1, parts)] or [0.5]
        return frame.agg(F.sort_array(F.array_distinct(F.percentile_approx("doc_id", shares, max(10_000, 20 * parts)))).alias("cuts"))

    coarse = min(n, most_cuts)
    bounds = np.array((quantiles(rows, coarse).first()[0] or []) if coarse > 1 else [], dtype=np.int64)

    def deal(batches):
        for b in batches:
            ids = b.column(0)
            batch = np.searchsorted(bounds, ids.fill_null(0).to_numpy(zero_copy_only=False), side="left")
            batch = np.where(ids.is_null().to_numpy(zero_copy_only=False), len(bounds), batch)
            yield pa.RecordBatch.from_arrays([ids, b.column(1), pa.array(batch, pa.int64())], ["doc_id", "text", "batch"])

    dealt = rows.mapInArrow(deal, "doc_id long, text string, batch long")
    fine = math.ceil(n / coarse)
    if fine == 1:
        return dealt
    cuts = quantiles(dealt.groupBy("batch"), fine)
    below = F.size(F.filter("cuts", lambda c: c < F.col("doc_id")))
    return (dealt.join(cuts, "batch", "left").select("doc_id", "text", (F.col("batch") * (fine + 1) + F.when(
        F.col("doc_id").isNull(), fine).otherwise(F.coalesce(below, F.lit(0)))).alias("batch")))


def remove_repeated_windows(docs: DataFrame, window: int = 50, batch_chars: int = 4_000_000) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): its words, the maximal intervals removed from them and the text that is left.

    A word goes if it lies in a window of ``window`` consecutive words that also starts in a row with a smaller doc_id. Null
    text has no words; rows with equal doc_id do not remove from each other; a null doc_id counts as the largest. Texts of
    fewer words than a window stay whole. Kept words are joined by one blank. An empty table gives an empty result; columns
    other than these two are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    chars = exchange.total_chars(rows)
    n = exchange.batches_for(chars, batch_chars)
    bits = exchange.bucket_bits(chars // 5, n)
    dealt = in_order(rows, n).repartition(n, "batch")

    def send(key, table):
        _, rank, texts = _ordered(table)
        keys, checks = _windows(texts, rank, window)[1]
        sent = [(bucket, key[0].as_py(), exchange.encode(keys[a:b]), exchange.planes32(checks[a:b]))
                for bucket, a, b in exchange.slices(keys, bits)]
        return exchange.released(pa.table({"bucket": pa.array([s[0] for s in sent], pa.int64()), "batch": pa.array([s[1] for s in sent], pa.int64()),
                         "keys": pa.array([s[2] for s in sent], pa.binary()), "extra": pa.array([s[3] for s in sent], pa.binary())}))

    def answer(key, table):
        table = table.sort_by([("batch", "ascending")])
        keys, at, order = exchange.gather(table["keys"].to_pylist())
        checks = np.concatenate([exchange.unplanes32(e) for e in table["extra"].to_pylist()])
        seen = _earlier(keys, checks, order)
        back = [(b, np.packbits(seen[x:y]).tobytes()) for b, x, y in zip(table["batch"].to_pylist(), at, at[1:]) if seen[x:y].any()]
        return exchange.released(pa.table({"batch": pa.array([b for b, _ in back], pa.int64()), "bucket": pa.array([key[0].as_py()] * len(back), pa.int64()),
                         "kind": pa.array([0] * len(back), pa.int32()), "payload": pa.array([p for _, p in back], pa.binary())}))

    def cut(key, left, right):
        ids, rank, texts = _ordered(left)
        words, (keys, _), place, number, ranks, first = _windows(texts, rank, window)
        earlier = np.zeros(len(keys), dtype=bool)
        bits_of = dict(zip(right["bucket"].to_pylist(), right["payload"].to_pylist()))
        for bucket, a, b in exchange.slices(keys, bits):
            if bucket in bits_of:
                earlier[a:b] = np.unpackbits(np.frombuffer(bits_of[bucket], np.uint8), count=b - a)
        gone = place[earlier[number] | (ranks > first[number])]
        step = np.zeros(len(words.hash) + 1, dtype=np.int64)
        np.add.at(step, gone, 1)
        np.add.at(step, gone + window, -1)
        removed = np.cumsum(step)[:-1] > 0
        before = np.r_[0, np.cumsum(removed)]
        n_removed = before[words.first[1:]] - before[words.first[:-1]]
        spans, kept = [], []
        for d, text in enumerate(texts.cast(pa.large_binary()).fill_null(b"").to_pylist()):
            if not n_removed[d]:
                spans.append([])
                kept.append(b" ".join(text.split()))
                continue
            out = removed[words.first[d]:words.first[d + 1]]
            edges = np.flatnonzero(np.diff(np.r_[0, out.astype(np.int8), 0]))
            spans.append([{"begin": int(x), "end": int(y)} for x, y in zip(edges[::2], edges[1::2])])
            kept.append(b" ".join(compress(text.split(), ~out)))
        return exchange.released(pa.table({
            "doc_id": ids.cast(pa.int64()), "n_words": pa.array(words.count, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()),
            "removed": pa.array(spans, pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))),
            "kept": pa.array(kept, pa.binary()).cast(pa.string())}))

    answers = dealt.groupBy("batch").applyInArrow(send, exchange.SENT).groupBy("bucket").applyInArrow(answer, exchange.ANSWER)
    return dealt.groupBy("batch").cogroup(answers.groupBy("batch")).applyInArrow(cut, REMOVED)
