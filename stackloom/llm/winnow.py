"""Benchmark decontamination by winnowing.

Of every window of ``window`` words the least hash of its k-grams is the fingerprint, on both sides; a shared window has a
shared fingerprint, whatever stands around it, so no shared span of a window or more is missed. Documents whose fingerprints
meet one of the benchmark go on; their windows under such a fingerprint are then compared word by word, which extends a hit
over its whole span. Benchmark items shorter than a window are one window of their own length and looked up by its hash.

All work is DataFrame expressions. Arrays are exploded with their nulls: the plain form makes the optimizer evaluate the array
once more in a filter of its own. The benchmark side of the first join is broadcast while it has at most
``BROADCAST_BYTES`` bytes (added up first), and shuffled beyond that.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stackloom.llm.text import ascii_lower, places, run_hashes, split_plain_words
from stackloom.session import stored

BROADCAST_BYTES = 64 << 20  # windows with their words and items; beyond that they are joined by a shuffle


def _words(text: Column) -> Column:
    return split_plain_words(ascii_lower(text))


def _hashed(rows: DataFrame) -> DataFrame:
    """Adds ``hashes``, one per word, and ``n``; ``words`` must be there."""
    return rows.withColumns({"n": F.size("words"), "hashes": F.transform("words", lambda w: F.xxhash64(w))})


def _fingerprints(rows: DataFrame, window: int, gram: int) -> DataFrame:
    """Adds ``prints``: the fingerprint of the window that begins at each word."""
    grams = rows.withColumn("grams", run_hashes(F.col("hashes"), F.col("n"), gram))
    return grams.withColumn("prints", F.transform(places(F.col("n"), window), lambda i: F.least(
        *[F.col("grams")[i + j] for j in range(window - gram + 1)])))



def _marked(lengths: list[int], window: int) -> list[Column]:
    """Per kind of key: its window length and the array with the key of the window at each place."""
    return [F.struct(F.lit(window).alias("length"), F.col("prints").alias("keys"))] + [
        F.struct(F.lit(n).alias("length"), run_hashes(F.col("hashes"), F.col("n"), n).alias("keys")) for n in lengths]


def benchmark_windows(benchmark: DataFrame, window: int, gram: int) -> DataFrame:
    """(length, key, span, items): each distinct window text of the benchmark, its fingerprint and the items that hold it."""
    rows = benchmark.where("item_id is not null").select(
        F.col("item_id").cast("long"), _words(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("words")).where(F.size("words") > 0)
    rows = _fingerprints(_hashed(rows), window, gram)
    long = rows.where(F.col("n") >= window).select("item_id", "words", F.posexplode_outer("prints").alias("p", "key")).select(
        "item_id", F.lit(window).alias("length"), "key", F.array_join(F.slice("words", F.col("p") + 1, window), " ").alias("span"))
    short = rows.where(F.col("n") < window).select(
        "item_id", F.col("n").alias("length"), F.lit(None).cast("long").alias("key"), F.array_join("words", " ").alias("span"), "hashes", "n")
    keyed = [long]
    for n in range(1, window):
        keyed.append(short.where(F.col("n") == n).select("item_id", "length", run_hashes(F.col("hashes"), F.col("n"), n)[0].alias("key"), "span"))
    both = keyed[0]
    for k in keyed[1:]:
        both = both.unionByName(k)
    return both.groupBy("length", "key", "span").agg(F.sort_array(F.collect_set("item_id")).alias("items"))


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10, gram: int = 5) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): n_words, the 0-based places of hit words, the items found and contaminated.

    Words are runs of ASCII letters (lower-cased), digits and characters beyond ASCII. A word is hit if it lies in an occurrence
    of a benchmark window. Null texts have no words; items without an id or without words are left out; items of one id count
    once. Rows that repeat a doc_id are answered one by one. Empty tables are allowed on either side; other columns are ignored.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long"), text.alias("text"), F.xxhash64(text).alias("text_key"))
    windows = stored(benchmark_windows(benchmark, window, gram), "windows")
    size = F.sum(F.octet_length("span").cast("long") + 8 * F.size("items") + 64)
    kinds = windows.groupBy("length").agg(size.alias("bytes")).collect()  # at most one row per length
    lengths = sorted(k["length"] for k in kinds if k["length"] < window)
    keys = windows.select("length", "key").distinct()
    if sum(k["bytes"] for k in kinds) <= BROADCAST_BYTES:
        keys, windows = F.broadcast(keys), F.broadcast(windows)

    def keyed(source: DataFrame) -> DataFrame:
        prints = _fingerprints(_hashed(source.withColumn("words", _words(F.col("text")))), window, gram)
        return prints.withColumn("kinds", F.array(*_marked(lengths, window)))

    seen = keyed(rows).select("doc_id", "text_key", F.explode_outer("kinds").alias("kind")).select(
        "doc_id", "text_key", F.col("kind.length").alias("length"), F.explode_outer(F.array_distinct("kind.keys")).alias("key"))
    found = (seen.join(keys, ["length", "key"], "left_semi").groupBy("doc_id", "text_key")
             .agg(F.collect_set("key").alias("found"))).alias("f")
    same = lambda a, b: F.col(f"{a}.doc_id").eqNullSafe(F.col(f"{b}.doc_id")) & (F.col(f"{a}.text_key") == F.col(f"{b}.text_key"))
    suspects = rows.alias("d").join(found, same("d", "f")).select("d.doc_id", "d.text_key", "text", "found")
    at = keyed(suspects).select("doc_id", "text_key", "words", "found", F.explode_outer("kinds").alias("kind")).select(
        "doc_id", "text_key", F.col("kind.length").alias("length"), F.explode_outer(F.filter(
            F.transform("kind.keys", lambda k, i: F.struct(k.alias("key"), F.when(F.array_contains("found", k), F.array_join(
                F.slice("words", i + 1, F.col("kind.length")), " ")).alias("span"), i.alias("p"))),
            lambda s: s["span"].isNotNull())).alias("hit")).select("doc_id", "text_key", "length", "hit.key", "hit.span", "hit.p")
    hits = at.join(windows, ["length", "key", "span"])
    summed = hits.groupBy("doc_id", "text_key").agg(
        F.sort_array(F.array_distinct(F.flatten(F.collect_list(F.sequence(F.col("p"), F.col("p") + F.col("length") - 1))))).alias("hit_words"),
        F.sort_array(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items")).alias("h")
    counts = rows.select("doc_id", "text_key", F.size(split_plain_words(F.col("text"))).cast("long").alias("n_words")).alias("c")
    empty = F.array().cast("array<int>")
    return counts.join(summed, same("c", "h"), "left").select(
        "c.doc_id", "n_words", F.coalesce("hit_words", empty).alias("hit_words"),
        F.coalesce("items", F.array().cast("array<bigint>")).alias("items"), F.col("hit_words").isNotNull().alias("contaminated"))
