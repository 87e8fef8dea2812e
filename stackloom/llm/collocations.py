"""Phrase collocations: the best-scoring word runs of every language by best-first branch and bound over their prefixes.

A phrase with count a that is cut into parts with counts l and r scores floor(2000000 a / (l + r)) at its worst cut. A longer
phrase never occurs more often than its prefix, so with prefix count f and first-word count g nothing that grows from a prefix
scores above floor(2000000 f / (g + f)): an admissible bound. Growth is best first, in rounds: a round sets a score to reach for
each language, counts the words that follow those prefixes whose bound reaches it, and ends a language once as many survivors as
are asked for reach that score. A language that is not settled gets a lower score; at zero everything has grown.

A phrase falls to a longer one that is nearly as frequent. Whatever lies in a four-word phrase lies in a three-word phrase at
least as frequent, so one more word on either side decides; the phrases that could be results grow to the left for that.

Counting is exact: tasks add up the runs of a slice of texts, told apart by two hashes of 93 bits together, and send them as
text; Spark adds up the texts. Which runs a task sends is decided by bit tables of fixed size that hold the hashes of prefixes to
grow. Two prefixes on one bit cost a few rows more and change no result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stackloom.llm.words import flat_bytes, mix, rolling, rolling_check, words_of
from stackloom.session import stored

IS_BREAK = np.zeros(256, dtype=bool)  # ends a piece; phrases do not go beyond it
IS_BREAK[list(b".,;:!?\n\x0b\x0c\r")] = True
IS_GAP = IS_BREAK.copy()
IS_GAP[list(b" \t")] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SLICE_BYTES, PHRASES_AT_ONCE = 1_000_000, 20_000
TABLE_BITS = 24
COUNTED = "lang string, phrase string, n long"
SCALE = 2_000_000


def _salt(lang: str) -> np.uint64:
    return np.uint64(int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=8).digest(), "little"))


def _slot(hashes: np.ndarray, lang: str) -> np.ndarray:
    return mix(hashes ^ _salt(lang)) >> np.uint64(64 - TABLE_BITS)


def _marked(table: np.ndarray, slots: np.ndarray) -> np.ndarray:
    return (table[slots >> np.uint64(6)] >> (slots & np.uint64(63)) & np.uint64(1)).astype(bool)


def _by_language(batch: pa.RecordBatch):
    """(lang, texts) of bounded slices."""
    lang, texts = batch.column("lang").dictionary_encode(), batch.column("text").cast(pa.large_string())
    codes, size = lang.indices.to_numpy(), pc.binary_length(texts).to_numpy()
    for code, name in enumerate(lang.dictionary.to_pylist()):
        own = np.flatnonzero(codes == code)
        cuts = np.flatnonzero(np.diff(np.cumsum(size[own]) // SLICE_BYTES, append=-1)) + 1
        for a, b in zip(np.r_[0, cuts], cuts):
            if b > a:
                yield name, texts.take(pa.array(own[a:b]))


def _phrases(data: np.ndarray, begin: np.ndarray, end: np.ndarray, first: np.ndarray, n: int) -> pa.Array:
    """The runs of ``n`` words that start at the words ``first``, lower-cased and joined by one blank."""
    at = (first[:, None] + np.arange(n)).ravel()
    size = end[at] - begin[at] + 1
    stop = np.cumsum(size)
    place = np.arange(stop[-1] if len(stop) else 0) - np.repeat(stop - size - begin[at], size)
    out = LOWER[data[np.minimum(place, len(data) - 1)]] if len(place) else np.zeros(0, np.uint8)
    out[stop - 1] = 32
    last = stop[n - 1::n] - 1
    keep = np.ones(len(out), dtype=bool)
    keep[last] = False
    offsets = np.r_[0, last - np.arange(len(last))].astype(np.int64)
    return pa.LargeStringArray.from_buffers(len(first), pa.py_buffer(offsets), pa.py_buffer(out[keep].tobytes()))


def _rows(lang: str, phrases: pa.Array, counts: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([lang] * len(phrases), pa.string()), phrases.cast(pa.string()), pa.array(counts, pa.int64())],
                                      ["lang", "phrase", "n"])


def _distinct(hashes: np.ndarray, checks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each distinct run first stands, and how often it does."""
    _, first, number, count = np.unique(hashes, return_index=True, return_inverse=True, return_counts=True)
    if (checks[first][number] != checks).any():  # different runs of one hash
        both = np.empty(len(hashes), dtype=[("hash", "<u8"), ("check", "<u4")])
        both["hash"], both["check"] = hashes, checks
        _, first, count = np.unique(both, return_index=True, return_counts=True)
    return first, count


def counted(docs: DataFrame, n: int, pairs=None, grow=None, end=None, whole=None) -> DataFrame:
    """(lang, phrase, n) of the runs of ``n`` words; for single words also the empty phrase, which stands for any word.

    Bit tables say which: every two neighbours of a run must be in ``pairs`` (words themselves in a run of two), and its prefix in
    ``grow`` or its last n - 1 words in ``end``, or the run itself in ``whole``. None: no such condition.
    """
    spark = docs.sparkSession
    tables = spark.sparkContext.broadcast((pairs, grow, end, whole))

    def tally(batches):
        pairs, grow, end, whole = tables.value
        for batch in batches:
            for lang, texts in _by_language(batch):
                data, _ = flat_bytes(texts)
                words = words_of(texts, lower=True, separators=IS_GAP, places=True)
                if len(words.hash) < n:
                    continue
                piece = np.cumsum(IS_BREAK[data], dtype=np.int32)[words.begin]
                last = len(words.hash) - n + 1
                text = words.text_of_word()
                fits = (text[:last] == text[n - 1:]) & (piece[:last] == piece[n - 1:])
                if pairs is not None:
                    length = min(n - 1, 2)
                    good = _marked(pairs, _slot(rolling(words.hash, length), lang))
                    for i in range(n - length + 1):
                        fits &= good[i:i + last]
                if grow is not None:
                    shorter = _slot(rolling(words.hash, n - 1), lang)
                    fits &= _marked(grow, shorter[:last]) | _marked(end, shorter[1:])
                hashes = rolling(words.hash, n)
                if whole is not None:
                    fits &= _marked(whole, _slot(hashes, lang))
                at = np.flatnonzero(fits)
                first, count = _distinct(hashes[at], rolling_check(words.hash, n)[at])
                first = at[first]
                for a in range(0, len(first), PHRASES_AT_ONCE):
                    yield _rows(lang, _phrases(data, words.begin, words.end, first[a:a + PHRASES_AT_ONCE], n), count[a:a + PHRASES_AT_ONCE])
                if n == 1:
                    yield _rows(lang, pa.array([""], pa.large_string()), np.array([len(words.hash)]))
            pa.default_memory_pool().release_unused()  # workers live on

    return docs.mapInArrow(tally, COUNTED).groupBy("lang", "phrase").agg(F.sum("n").alias("n"))


def bit_table(phrases: DataFrame, n: int) -> np.ndarray:
    """A table of fixed size with a bit for each (lang, phrase) of ``n`` words."""
    def slots(batches):
        for batch in batches:
            lang = batch.column("lang").dictionary_encode()
            for code, name in enumerate(lang.dictionary.to_pylist()):
                words = words_of(batch.column("phrase").filter(pc.equal(lang.indices, code)), separators=IS_GAP)
                found = np.unique(_slot(rolling(words.hash, n)[words.first[:-1]], name)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(found >> 6), pa.array(found & 63)], ["word", "bit"])

    bits = F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bit").cast("int")))
    rows = phrases.select("lang", "phrase").mapInArrow(slots, "word long, bit long").groupBy("word").agg(bits.alias("bits")).toArrow()
    table = np.zeros(2**(TABLE_BITS - 6), dtype=np.uint64)
    table[rows["word"].to_numpy()] = rows["bits"].to_numpy().view(np.uint64)
    return table


def _wide(c: Column) -> Column:
    return c.cast("decimal(19,0)")


def _score(a: Column, l: Column, r: Column) -> Column:  # noqa: E741
    """floor(2000000 a / (l + r)) without rounding: the product may pass 64 bits."""
    return F.call_function("div", F.lit(SCALE).cast("decimal(8,0)") * _wide(a), _wide(l) + _wide(r))


def _word(i: int) -> Column:
    return F.split("phrase", " ").getItem(i)


def _run(begin: int, n: int) -> Column:
    return F.array_join(F.slice(F.split("phrase", " "), begin + 1, n), " ")


def _with_count(df: DataFrame, counts: DataFrame, phrase: Column, name: str) -> DataFrame:
    """``df`` with the count of a part of its phrase; rows whose part has none are left out."""
    other = counts.select(F.col("lang").alias("of_lang"), F.col("phrase").alias("of"), F.col("n").alias(name))
    return df.join(other, (F.col("lang") == F.col("of_lang")) & (phrase == F.col("of"))).drop("of_lang", "of")


def scored(phrases: DataFrame, shorter: dict[int, DataFrame], n: int) -> DataFrame:
    """(lang, phrase, a, l, r, score, bound) of phrases of ``n`` words: the worst cut, and what no longer phrase can exceed."""
    df, cuts = phrases.withColumnRenamed("n", "a"), []
    for k in range(1, n):
        df = _with_count(df, shorter[k], _run(0, k), f"l{k}")
        df = _with_count(df, shorter[n - k], _run(k, n - k), f"r{k}")
        cuts.append(F.struct(_score(F.col("a"), F.col(f"l{k}"), F.col(f"r{k}")).alias("score"), F.lit(k).alias("k"),
                             F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r")))
    worst = F.least(*cuts) if len(cuts) > 1 else cuts[0]
    return (df.withColumn("cut", worst)
            .select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score", _score(F.col("a"), F.col("l1"), F.col("a")).alias("bound")))


def _alive(phrases: DataFrame, longer: DataFrame, n: int, percent: int) -> DataFrame:
    """Phrases of ``n`` words without those that lie in a phrase of one more word which is nearly as frequent."""
    parts = longer.select(F.col("lang").alias("in_lang"), F.explode(F.array(_run(0, n), _run(1, n))).alias("part"), F.col("n").alias("m"))
    most = parts.groupBy("in_lang", "part").agg(F.max("m").alias("m"))
    falls = 100 * _wide(F.col("m")) >= percent * _wide(F.col("a"))
    return phrases.join(most, (F.col("lang") == F.col("in_lang")) & (F.col("phrase") == F.col("part")) & falls, "left_anti")


def _best(df: DataFrame, limit: int) -> DataFrame:
    """The first ``limit`` rows of every language with their rank; partitions cut down to so many before they meet."""
    order = W.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), F.col("phrase"))
    return df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)


def collocations(docs: DataFrame, limit: int = 2000, least: int = 30, percent: int = 80, ahead: int = 2) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the ``limit`` best phrases of two to four words per language of ``docs`` (lang, text).

    Texts (null: empty) are lower-cased (A-Z), cut into pieces at ``. , ; : ! ?`` and line ends, and into words at blanks and
    tabs. Phrases occur ``least`` times or more. One that lies in a longer phrase with ``percent`` of its count or more is left
    out. ``a`` is the count of the phrase, ``l`` and ``r`` those of the parts at the cut with the lowest score (ties: the earliest),
    ``n`` all words of the language; null languages are 'und'. Order: score, then a, both downwards, then phrase. Repeated rows count
    each time. An empty table, or one without frequent phrases, gives an empty result; other columns are ignored.

    ``ahead`` times ``limit`` is the number of two-word phrases whose lowest score the first round tries to reach.
    """
    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text")).where("text is not null")
    often = lambda df: df.where(F.col("n") >= least)
    words = stored(counted(rows, 1).where((F.col("n") >= least) | (F.col("phrase") == "")), "words")
    total = words.where("phrase = ''").select("lang", "n")
    words = words.where("phrase <> ''")
    pairs = stored(often(counted(rows, 2, pairs=bit_table(words, 1))), "pairs")
    two = stored(scored(pairs, {1: words}, 2), "two")
    frequent = bit_table(pairs, 2)

    done, ahead = None, ahead * limit
    while True:
        reach = (_best(two, ahead).groupBy("lang").agg(F.count("*").alias("k"), F.min("score").alias("least"))
                 .select("lang", F.when(F.col("k") < ahead, 0).otherwise(F.col("least")).alias("reach")))
        if done is not None:
            reach = reach.join(done.select("lang").distinct(), "lang", "left_anti")
        reach = stored(reach, "reach")
        if reach.isEmpty():
            break
        open_rows = rows.join(reach.select("lang"), "lang", "left_semi") if done is not None else rows
        two_now = two.join(reach, "lang")
        grow = bit_table(two_now.where("bound >= reach"), 2)
        triples = stored(often(counted(open_rows, 3, frequent, grow, bit_table(two_now.where("score >= reach"), 2))), "triples")
        three = stored(scored(triples, {1: words, 2: pairs}, 3), "three")
        three_now = three.join(reach, "lang")
        grow = bit_table(three_now.where("bound >= reach"), 3)
        fours = stored(often(counted(open_rows, 4, frequent, grow, bit_table(three_now.where("score >= reach"), 3))), "fours")
        # of those that grew from a prefix in bound, the last three words may not have been counted yet
        grown = three_now.where("bound >= reach").select("lang", F.col("phrase").alias("prefix"))
        own = fours.withColumn("prefix", _run(0, 3)).join(grown, ["lang", "prefix"], "left_semi").drop("prefix")
        lack = own.select("lang", _run(1, 3).alias("phrase")).distinct().join(triples, ["lang", "phrase"], "left_anti")
        lack = stored(lack, "lack")
        tails = triples if lack.isEmpty() else triples.unionByName(
            counted(open_rows, 3, whole=bit_table(lack, 3)).join(lack, ["lang", "phrase"], "left_semi"))
        four = scored(own, {1: words, 2: pairs, 3: tails}, 4)
        alive = (_alive(two_now.where("score >= reach").drop("reach"), triples, 2, percent)
                 .unionByName(_alive(three_now.where("score >= reach").drop("reach"), fours, 3, percent))
                 .unionByName(four.join(reach, "lang").where("score >= reach").drop("reach")))
        best = stored(_best(alive, limit), "best")
        size = best.groupBy("lang").agg(F.count("*").alias("k"))
        settled = reach.join(size, "lang", "left").where((F.col("reach") == 0) | (F.col("k") >= limit)).select("lang")
        settled = best.join(settled, "lang", "left_semi")
        # a language without a survivor is settled too once all of it has grown
        empty = reach.where("reach = 0").join(best.select("lang"), "lang", "left_anti").select("lang")
        settled = stored(settled.unionByName(empty, allowMissingColumns=True), "settled")
        done = settled if done is None else done.unionByName(settled)
        ahead *= 8
    shape = "lang string, rank long, phrase string, a long, l long, r long, n long, score long"
    if done is None:
        return docs.sparkSession.createDataFrame([], shape)
    return done.where("phrase is not null").join(total, "lang").select(
        "lang", F.col("rank").cast("long"), "phrase", "a", "l", "r", "n", F.col("score").cast("long"))
