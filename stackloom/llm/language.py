"""Language identification, word first: known words score by their log frequency in each language, and a word that was never
seen falls back to its character n-grams, the longest length of which any is known.

The model holds all words and n-grams of a training sample that is bounded by language, counted in Spark, with an entry for each
language that has them. It travels to the tasks as one value. Texts are scored whole, distinct words once per text.
"""

from __future__ import annotations

import math
import re
from collections import Counter, OrderedDict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stackloom.session import stored

WORD = re.compile(r"[^\W\d_]+")
LONGEST = 5
CACHE = 200_000
COUNTED = "lang string, key string, n long"


def words_in(text: str) -> Counter:
    """Distinct lower-cased runs of letters with their numbers."""
    return Counter(WORD.findall(text.lower()))


def grams_of(word: str, n: int) -> list[str]:
    marked = f"<{word}>"
    return [marked[i:i + n] for i in range(len(marked) - n + 1)] if n > 1 else list(word)


class Model:
    """Log frequencies by language of words (kind 0) and n-grams of each length: ``base`` by kind, for keys a language does not
    hold, and what the languages that hold the key ``rows[kind][key]`` gain on it, from ``first`` of the key to that of the next.
    """

    def __init__(self, counts: pa.Table):
        """``counts``: lang, key (its kind in front) and n, once for each language and key."""
        counts = counts.sort_by([("key", "ascending"), ("lang", "ascending")]).combine_chunks()
        self.languages = sorted(pc.unique(counts["lang"]).to_pylist())
        self.lang = pc.index_in(counts["lang"], pa.array(self.languages, pa.string())).to_numpy().astype(np.int32)
        n, key = counts["n"].to_numpy().astype(float), counts["key"]
        new = np.r_[True, pc.not_equal(key[1:], key[:-1]).to_numpy()] if len(key) else np.zeros(0, dtype=bool)
        begins = np.flatnonzero(new)
        self.first = np.r_[begins, len(key)]
        self.rows: list[dict[str, int]] = [{} for _ in range(LONGEST + 1)]
        for i, k in enumerate(key.take(pa.array(begins)).to_pylist()):
            self.rows[int(k[0])][k[1:]] = i
        kind = np.repeat([i for i, known in enumerate(self.rows) for _ in known], np.diff(self.first)).astype(int)
        total = np.bincount(kind * len(self.languages) + self.lang, n, (LONGEST + 1) * len(self.languages)).reshape(LONGEST + 1, -1)
        # half an occurrence for every key of the kind, so that a language with little text gains nothing by it
        self.base = np.log(0.5) - np.log(total + 0.5 * np.maximum([[len(known)] for known in self.rows], 1))
        self.gain = (np.log(n + 0.5) - np.log(0.5)).astype(np.float32)

    def _gains(self, keys: list[int], weights) -> np.ndarray:
        """Weighted sum of what the languages gain on the keys."""
        at = np.asarray(keys)
        begin, n = self.first[at], self.first[at + 1] - self.first[at]
        ends = np.cumsum(n)
        place = np.repeat(begin - ends + n, n) + np.arange(ends[-1])
        return np.bincount(self.lang[place], self.gain[place] * np.repeat(weights, n), len(self.languages))

    def word(self, word: str) -> np.ndarray | None:
        """Scores of one word in all languages; None if not even a letter of it is known."""
        at = self.rows[0].get(word)
        if at is not None:
            return self.base[0] + self._gains([at], [1.0])
        for n in range(LONGEST, 0, -1):
            found = [self.rows[n][g] for g in grams_of(word, n) if g in self.rows[n]]
            if found:
                return self.base[n] + self._gains(found, np.full(len(found), 1 / len(found)))
        return None

    def predict(self, text: str | None, cache: OrderedDict) -> tuple[str, float]:
        words = words_in(text) if text else None
        if not words or not self.languages or not any(c.isalpha() for w in words for c in w):
            return "und", 0.0
        total = np.zeros(len(self.languages))
        known, weights, unseen, unseen_weights = [], [], [], []
        for word, n in words.items():
            at = self.rows[0].get(word)
            if at is not None:
                known.append(at)
                weights.append(n)
                continue
            scores = cache.get(word)
            if scores is None:
                scores = self.word(word)
                if scores is None:
                    continue
                if len(cache) >= CACHE:
                    cache.popitem(last=False)
                cache[word] = scores
            unseen.append(scores)
            unseen_weights.append(n)
        if known:
            weights = np.asarray(weights, dtype=float)
            total += weights.sum() * self.base[0] + self._gains(known, weights)
        if unseen:
            total += np.asarray(unseen_weights, dtype=float) @ np.asarray(unseen)
        best = int(np.argmax(total))
        return self.languages[best], float(1 / np.exp(total - total[best]).sum())


def fit(docs: DataFrame, train: Column, sample_rows: int = 10_000, least_rows: int = 1_000, sample_chars: int = 100_000_000) -> Model:
    """A model of ``docs`` (doc_id, text, lang) where ``train`` holds and lang is known.

    About ``sample_rows`` rows are drawn by a hash of doc_id (all, if there are no more), and of every language about
    ``least_rows`` at least (all, if it has no more); where these would hold more than ``sample_chars`` characters, every language
    gives as much less. All words and n-grams that they hold are kept.
    """
    rows = docs.where(train & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", F.col("text").cast("string"), F.col("lang").cast("string"))
    sizes = {r["lang"]: (r["n"], r["chars"]) for r in rows.groupBy("lang").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.length("text").cast("long")).alias("chars")).collect()}
    n = sum(k for k, _ in sizes.values())
    share = {lang: min(1.0, max(sample_rows / n, least_rows / k)) if n > sample_rows else 1.0 for lang, (k, _) in sizes.items()}
    less = min(1.0, sample_chars / max(1, sum(share[lang] * chars for lang, (_, chars) in sizes.items())))
    if n > sample_rows or less < 1:
        shares = [(lang, math.ceil(1_000_000 * less * share[lang])) for lang in sizes]
        drawn = F.broadcast(docs.sparkSession.createDataFrame(shares, "lang string, share long"))
        rows = rows.join(drawn, "lang").where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000).cast("long")) < F.col("share"))

    def count(batches):
        for b in batches:
            found: Counter = Counter()
            for text, lang in zip(b.column("text").to_pylist(), b.column("lang").to_pylist()):
                for word, k in words_in(text).items():
                    found[lang, word] += k
            yield _counted(found)

    def cut(batches):  # n-grams of distinct words, each with the number of its word
        for b in batches:
            found: Counter = Counter()
            for lang, word, n in zip(*(b.column(c).to_pylist() for c in ("lang", "key", "n"))):
                for length in range(1, LONGEST + 1):
                    for gram in grams_of(word, length):
                        found[lang, f"{length}{gram}"] += n
            yield _counted(found)

    added = lambda frame: frame.groupBy("lang", "key").agg(F.sum("n").alias("n"))
    words = stored(added(rows.select("text", "lang").mapInArrow(count, COUNTED)), "words")
    grams = stored(added(words.mapInArrow(cut, COUNTED)), "grams")
    return Model(words.withColumn("key", F.concat(F.lit("0"), "key")).unionByName(grams).toArrow())


def _counted(found: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([k[0] for k in found], pa.string()), pa.array([k[1] for k in found], pa.string()),
                                       pa.array(list(found.values()), pa.int64())], ["lang", "key", "n"])


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang_pred, score) per row of ``docs`` (doc_id, text); score is the share of the best language's likelihood.

    Null texts and texts without a letter are 'und' with score 0, as is every text if the model knows no language. Ties go to
    the language first in order. Repeated rows are answered one by one; an empty table gives an empty result; other columns,
    lang among them, are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def predict(batches):
        cache: OrderedDict = OrderedDict()
        for b in batches:
            found = [shared.value.predict(text, cache) for text in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([f[0] for f in found], pa.string()),
                                              pa.array([f[1] for f in found], pa.float64())], ["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(predict, "doc_id long, lang_pred string, score double")
