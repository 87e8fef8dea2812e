"""Quality of texts by logistic regression on hashed word n-grams, trained by follow-the-regularised-leader updates.

Words are runs of letters and digits, and runs of marks between them; every word and every pair of neighbours names one of
2**bits weights by its hash, and a pair of equal words one more that all such pairs share. A text is a sparse vector of tf / sqrt(number of n-grams), so its score is a sum of gathered
weights, a whole batch of texts at a time. The trainer is the per-coordinate proximal form (McMahan et al. 2013): it takes the
examples one by one and keeps weights at exactly zero until their evidence passes an L1 threshold.

Training sees a bounded sample of labelled texts, in one task that a lost executor only repeats; all texts are scored. The model
is an array of fixed size.
"""

from __future__ import annotations

import dataclasses

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stackloom.llm.words import IS_MARK, IS_SPACE, mix, words_of
from stackloom.session import stored

PAIR, REPEAT = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xD1342543DE82EF95)
NOT_MARK = ~IS_MARK | IS_SPACE
PLACES = 1_000_000


@dataclasses.dataclass
class Model:
    """One weight per hash value, and the bias that every text has."""

    weights: np.ndarray
    bias: float


def ngram_slots(texts, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The weight number of every word and pair of words of all texts, text by text, and where each text begins (and ends)."""
    parts = [words_of(texts, lower=True, separators=s, places=True) for s in (IS_MARK, NOT_MARK)]
    text, begin, word = (np.concatenate(p) for p in zip(*[(w.text_of_word(), w.begin, w.hash) for w in parts]))
    order = np.argsort(begin, kind="stable")  # both kinds of words in the order of the text
    text, word = text[order], word[order]
    inside = text[1:] == text[:-1]
    pair, second = mix(word[:-1] * PAIR + word[1:])[inside], text[1:][inside]
    again = second[(word[:-1] == word[1:])[inside]]
    hashes = np.r_[word, pair, np.full(len(again), REPEAT)]
    slots, owner = (hashes >> np.uint64(64 - bits)).astype(np.int64), np.r_[text, second, again]
    order = np.argsort(owner, kind="stable")
    return slots[order], np.searchsorted(owner[order], np.arange(len(parts[0].first)))


def train_ftrl(slots: np.ndarray, first: np.ndarray, label: np.ndarray, weight: np.ndarray, bits: int, epochs: int = 4,
               alpha: float = 0.3, beta: float = 1.0, l1: float = 0.05, l2: float = 0.5) -> Model:
    """Passes over the examples in the order given. ``weight`` scales the loss of an example; the bias has no penalty."""
    z, n = np.zeros(2**bits + 1), np.zeros(2**bits + 1)
    examples = []
    for a, b in zip(first, first[1:]):
        at, count = np.unique(slots[a:b], return_counts=True)
        examples.append((np.r_[at, 2**bits], np.r_[count / np.sqrt(max(b - a, 1)), 1.0]))

    def solved(at):
        zi = z[at]
        w = -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(n[at])) / alpha + l2)
        w[np.abs(zi) <= l1] = 0.0
        if at[-1] == 2**bits:  # the bias
            w[-1] = -z[-1] * alpha / (beta + np.sqrt(n[-1]))
        return w

    for _ in range(epochs):
        for (at, x), y, c in zip(examples, label, weight):
            w = solved(at)
            g = c * (1 / (1 + np.exp(-np.clip(w @ x, -35, 35))) - y) * x
            grown = n[at] + g * g
            z[at] += g - (np.sqrt(grown) - np.sqrt(n[at])) / alpha * w
            n[at] = grown
    w = solved(np.arange(2**bits + 1))
    return Model(w[:-1].astype(np.float32), float(w[-1]))


def fit(docs: DataFrame, labels: DataFrame, train: Column, sample_rows: int = 4_000, sample_chars: int = 6_000_000,
        bits: int = 18) -> Model:
    """A model from the rows of ``labels`` (doc_id, quality) where ``train`` holds and their texts in ``docs`` (doc_id, text).

    Of each label about ``sample_rows`` distinct texts are drawn by a hash of the text, fewer if they would hold more than
    ``sample_chars`` characters (all, if they stay below both); examples weigh as much as their label has distinct texts. A text
    that carries both labels teaches nothing. With one label only every score is that label, without any it is 0.
    """
    marked = labels.where(train & F.col("quality").isNotNull()).select(
        F.col("doc_id").cast("long").alias("doc_id"), (F.col("quality") == 1).cast("int").alias("y")).distinct()
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_key"), F.length(text).alias("chars"))
    # texts stay behind: their hashes meet the labels
    clear = stored(keyed.join(marked, "doc_id").groupBy("text_key").agg(F.min("y").alias("y"), F.max("y").alias("most"), F.min("chars").alias("chars"))
                   .where("y = most").select("text_key", "y", "chars"), "labelled")
    sizes = {r["y"]: r for r in clear.groupBy("y").agg(F.count("*").alias("n"), F.sum("chars").alias("chars")).collect()}
    if len(sizes) < 2:
        return Model(np.zeros(2**bits, np.float32), {(): -40.0, (0,): -40.0, (1,): 40.0}[tuple(sizes)])
    share = {y: min(1.0, sample_rows / r["n"], sample_chars / max(r["chars"], 1)) for y, r in sizes.items()}
    total = sum(r["n"] for r in sizes.values())
    drawn = F.pmod(F.xxhash64("text_key", F.lit(7)), F.lit(PLACES).cast("long")) < F.when(F.col("y") == 1, int(share[1] * PLACES)).otherwise(
        int(share[0] * PLACES))
    chosen = F.broadcast(clear.where(drawn).select("text_key", "y"))  # about sample_rows rows of each label
    sample = (docs.select(text.alias("text"), F.xxhash64(text).alias("text_key")).join(chosen, "text_key")
              .groupBy("text_key").agg(F.first("y").alias("y"), F.first("text").alias("text")))

    def learn(key, table):
        table = table.sort_by([("text_key", "ascending")])  # an order that has nothing to do with label or place
        y = table["y"].to_numpy().astype(float)
        weight = np.array([sizes[int(v)]["n"] / total / max((y == v).mean(), 1e-9) for v in y])
        model = train_ftrl(*ngram_slots(table["text"], bits), y, weight, bits)
        at = np.flatnonzero(model.weights)
        return pa.table({"slot": pa.array(np.r_[at, -1], pa.int64()), "weight": pa.array(np.r_[model.weights[at], model.bias], pa.float64())})

    found = sample.withColumn("all", F.lit(0)).groupBy("all").applyInArrow(learn, "slot long, weight double").toArrow()
    slot, weight = found["slot"].to_numpy(), found["weight"].to_numpy()
    weights = np.zeros(2**bits, np.float32)
    weights[slot[slot >= 0]] = weight[slot >= 0]
    return Model(weights, float(weight[slot < 0].sum()))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) per row of ``docs`` (doc_id, text): the probability of label 1.

    Null text is empty; a text without words has the score of the bias. Repeated rows are answered one by one; an empty table
    gives an empty result; other columns are ignored.
    """
    shared, bits = docs.sparkSession.sparkContext.broadcast(model), int(np.log2(len(model.weights)))

    def judge(batches):
        for b in batches:
            for start in range(0, b.num_rows, 1000):
                part = b.slice(start, 1000)
                slots, first = ngram_slots(part.column("text"), bits)
                total = np.r_[0.0, np.cumsum(shared.value.weights[slots], dtype=float)]
                x = shared.value.bias + (total[first[1:]] - total[first[:-1]]) / np.sqrt(np.maximum(np.diff(first), 1))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(0.5 * (1 + np.tanh(0.5 * x)))], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(judge, "doc_id long, score double")
