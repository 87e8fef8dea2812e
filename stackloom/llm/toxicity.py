"""Toxic spans by a linear-chain conditional random field, and document scores from its marginals.

Only documents are labelled, so tokens get their labels first. Words and word beginnings that stand in many more different
contexts (pairs of neighbours) in toxic than in other documents of a bounded sample, beyond chance for so many features, are
telling; of a family of near copies only the first document counts, so that it is not evidence for each of its words. In
toxic documents, tokens with a telling feature are labelled toxic. On these labelled tokens a two-state chain is trained. Its forward-backward marginals give the
offending offsets; one minus the chance that no token is toxic, calibrated on the sample, gives the score of a document.

Training is bounded by its parameters and runs where the job is started; the model is a table of fixed size. Spark finds the
sample and scores all texts, whole, many at a time: the recursion runs over places, vectorised over the texts.
"""

from __future__ import annotations

import dataclasses
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stackloom.llm.words import IS_MARK, flat_bytes, mix, words_of

HEADS = (4, 5, 6)
LEAST_MARGINAL = 0.05
LEAST_HELD = 20
BLOCK = 1 << 16
LITTLE = 0.1  # evidence far below that of one toxic token makes no difference
TRIPLE = np.uint64(0x9E3779B97F4A7C15)
SURE = 3.0  # minus the log of the chance that any feature of a kind is taken for telling wrongly
SCORED = "doc_id long, score double, spans array<struct<begin: long, end: long, probability: double>>"


@dataclasses.dataclass
class Model:
    """Emission weights by feature (sorted hashes), transition scores [from, to], start, and the calibration of documents."""

    features: np.ndarray
    weights: np.ndarray
    bias: float
    moves: np.ndarray
    start: float
    intercept: float
    slope: float


class _Tokens:
    """Tokens of many texts (runs of ASCII letters, digits and bytes beyond ASCII) and the hashes of their features."""

    def __init__(self, texts):
        self.words = words_of(texts, lower=True, separators=IS_MARK, heads=HEADS, places=True)
        self.features = [self.words.hash, *(h + np.uint64(i + 1) for i, h in enumerate(self.words.heads))]
        self.first, self.count = self.words.first, self.words.count


def _sigmoid(x):
    return 0.5 * (1 + np.tanh(0.5 * x))


def _softplus(x):
    return np.logaddexp(0.0, x)


def _recursions(model: Model, first: np.ndarray, emission: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward scores (with the emission of their place) and backward scores, in log odds, over all texts side by side."""
    count = np.diff(first)
    order = np.argsort(-count, kind="stable")
    begin, count = first[:-1][order], count[order]
    stay, leave, enter, remain = model.moves[0, 0], model.moves[1, 0], model.moves[0, 1], model.moves[1, 1]
    longest = int(count[0]) if len(count) else 0
    active = np.searchsorted(-count, -np.arange(longest), side="left") if longest else []
    forward, backward = np.empty(len(emission)), np.zeros(len(emission))
    state = np.zeros(len(count))
    for t in range(longest):
        n = active[t]
        at = begin[:n] + t
        if t:
            f = state[:n]
            state[:n] = enter - stay + _softplus(f + remain - enter) - _softplus(f + leave - stay) + emission[at]
        else:
            state[:n] = model.start + emission[at]
        forward[at] = state[:n]
    state[:] = 0
    for t in range(longest - 2, -1, -1):  # texts whose last token is this one begin with even odds
        n = active[t + 1]
        at = begin[:n] + t
        g = state[:n] + emission[at + 1]
        state[:n] = leave - stay + _softplus(g + remain - leave) - _softplus(g + enter - stay)
        backward[at] = state[:n]
    return forward, backward


def marginals(model: Model, first: np.ndarray, emission: np.ndarray) -> np.ndarray:
    """P(token is toxic) by the forward-backward recursions."""
    forward, backward = _recursions(model, first, emission)
    return _sigmoid(forward + backward)


def pair_marginals(model: Model, first: np.ndarray, emission: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The marginals, and the expected number of neighbours by [from, to]."""
    forward, backward = _recursions(model, first, emission)
    begins = np.zeros(len(emission), dtype=bool)
    begins[first[:-1][np.diff(first) > 0]] = True
    expected = np.zeros(4)
    for a in range(1, len(emission), BLOCK):  # a block at a time: four numbers for every token would be much at once
        at = np.arange(a, min(a + BLOCK, len(emission)))
        at = at[~begins[at]]
        after = emission[at] + backward[at]
        scores = np.stack([np.full(len(at), model.moves[0, 0]), model.moves[0, 1] + after, model.moves[1, 0] + forward[at - 1],
                           model.moves[1, 1] + forward[at - 1] + after])
        weight = np.exp(scores - scores.max(axis=0)) if len(at) else scores
        expected += (weight / weight.sum(axis=0)).sum(axis=1)
    forward += backward
    return _sigmoid(forward), expected.reshape(2, 2)


def _places(known: np.ndarray, features: np.ndarray) -> np.ndarray:
    """Of each feature its place among the known ones, len(known) if it is none."""
    at = np.searchsorted(known, features)
    found = np.zeros(len(features), dtype=bool)
    inside = at < len(known)
    found[inside] = known[at[inside]] == features[inside]
    return np.where(found, at, len(known))


def _emission(model: Model, places: list[np.ndarray]) -> np.ndarray:
    weights = np.r_[model.weights, 0.0]
    return sum((weights[p] for p in places), np.zeros(len(places[0]))) + model.bias


def _emissions(model: Model, tokens: _Tokens) -> np.ndarray:
    return _emission(model, [_places(model.features, f) for f in tokens.features])


def _evidence(probability: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Per text: minus the log of the chance that no token is toxic; tokens near the background of any token count nothing."""
    counted = np.where(probability >= LEAST_MARGINAL, np.minimum(probability, 1 - 1e-12), 0.0)
    total = np.r_[0.0, np.cumsum(-np.log1p(-counted))]
    return total[first[1:]] - total[first[:-1]]


def _new_texts(tokens: _Tokens) -> np.ndarray:
    """Whether at least half of a text's three-word runs stand in no text before it: of a family of near copies, the first."""
    word, text = tokens.words.hash, tokens.words.text_of_word()
    runs = mix(mix(word[:-2] * TRIPLE + word[1:-1]) * TRIPLE + word[2:])[text[2:] == text[:-2]] if len(word) > 2 else np.zeros(0, np.uint64)
    owner = text[2:][text[2:] == text[:-2]] if len(word) > 2 else np.zeros(0, np.int64)
    first = np.zeros(len(runs), dtype=bool)
    distinct, at, number = np.unique(runs, return_index=True, return_inverse=True)
    first = owner[at][number] == owner  # repeats inside a text are its own
    n = len(tokens.count)
    total, own = np.bincount(owner, minlength=n), np.bincount(owner, first, minlength=n)
    return own >= 0.5 * total


def _contexts(features: np.ndarray, context: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each feature and in how many different contexts it stands."""
    pairs = np.unique(np.stack([features, context], axis=1).view([("f", "<u8"), ("c", "<u8")]).reshape(-1))
    return np.unique(pairs["f"], return_counts=True)


def _telling(tokens: _Tokens, toxic: np.ndarray, least_ratio: float, most: int) -> np.ndarray:
    """The features (sorted) that stand in toxic texts far more than elsewhere, the strongest ``most`` of them."""
    new = np.repeat(_new_texts(tokens), tokens.count)
    token_toxic = np.repeat(toxic > 0, tokens.count)
    word = tokens.words.hash
    before, after = np.r_[np.uint64(0), word[:-1]], np.r_[word[1:], np.uint64(0)]
    context = mix(before * TRIPLE + mix(after))
    names, scores = [], []
    for i, feature in enumerate(tokens.features):
        own = new & (tokens.words.end - tokens.words.begin > HEADS[i - 1] if i else np.ones(len(word), dtype=bool))
        bad, n_bad = _contexts(feature[token_toxic & own], context[token_toxic & own])
        good, n_good = _contexts(feature[~token_toxic & own], context[~token_toxic & own])
        if not len(bad):
            continue
        at = _places(good, bad)
        other = np.r_[n_good, 0][at]
        expected = max(n_bad.sum(), 1) / max(n_good.sum(), 1)
        ratio = n_bad / ((other + 0.5) * expected)
        total, p = n_bad + other, expected / (1 + expected)
        share = n_bad / total
        # large deviation bound of a binomial, corrected for the number of features
        excess = total * (share * np.log(np.maximum(share, 1e-12) / p) + np.where(share < 1, (1 - share) * np.log(np.maximum(1 - share, 1e-12) / (1 - p)), 0))
        good_ones = (ratio >= least_ratio) & (share > p) & (excess > math.log(len(bad)) + SURE)
        names.append(bad[good_ones])
        scores.append(excess[good_ones])
    if not names:
        return np.zeros(0, np.uint64)
    names, scores = np.concatenate(names), np.concatenate(scores)
    return np.unique(names[np.argsort(-scores, kind="stable")[:most]])


def _train_chain(tokens: _Tokens, telling: np.ndarray, toxic: np.ndarray, rounds: int) -> Model:
    """The chain on the labelled tokens: all weights by gradient steps, expected minus seen, from the marginals of tokens and pairs."""
    known = [_places(telling, f).astype(np.int32) for f in tokens.features]
    label = (np.min(known, axis=0) < len(telling)) & np.repeat(toxic > 0, tokens.count)
    label = label.astype(float)
    model = Model(telling, np.zeros(len(telling)), -3.0, np.zeros((2, 2)), -2.0, 0.0, 1.0)
    follows = np.ones(len(label), dtype=bool)
    follows[tokens.first[:-1][tokens.count > 0]] = False
    after, heads = np.flatnonzero(follows), np.flatnonzero(~follows)
    pairs = np.bincount((2 * label[after - 1] + label[after]).astype(int), minlength=4).reshape(2, 2) + 1.0
    del follows, after
    # transitions and start begin at their smoothed relative frequencies; all weights follow the gradient of the likelihood
    model.moves = np.log(pairs / pairs.sum(axis=1, keepdims=True))
    model.start = float(np.log((label[heads].sum() + 1) / ((1 - label[heads]).sum() + 1)))
    seen = pairs - 1.0
    grown, bias_grown = np.full(len(telling) + 1, 1e-4), 1e-4
    moves_grown, start_grown = np.full((2, 2), 1e-4), 1e-4
    for _ in range(rounds):
        emission = _emission(model, known)
        p, expected = pair_marginals(model, tokens.first, emission)
        error = p - label
        slope = sum((np.bincount(at, error, len(telling) + 1) for at in known), np.zeros(len(telling) + 1))
        slope[:-1] += 0.02 * model.weights
        grown += slope**2
        model.weights -= 1.5 * (slope / np.sqrt(grown))[:-1]
        bias_grown += error.sum() ** 2
        model.bias -= 0.5 * error.sum() / math.sqrt(bias_grown)
        steps = expected - seen
        moves_grown += steps**2
        model.moves = model.moves - 0.3 * steps / np.sqrt(moves_grown)
        begin = error[heads].sum()
        start_grown += begin**2
        model.start -= 0.3 * begin / math.sqrt(start_grown)
    return model


def fit(docs: DataFrame, labels: DataFrame, train: Column, sample_rows: int = 5_000, sample_chars: int = 6_000_000,
        least_ratio: float = 10.0, most_features: int = 20_000, chain_rounds: int = 25) -> Model:
    """A model from the rows of ``labels`` (doc_id, toxic) where ``train`` holds and their texts in ``docs`` (doc_id, text).

    Of each label about ``sample_rows`` rows are drawn by a hash of doc_id (all, if there are no more), and whole texts as far
    as ``sample_chars`` go; equal texts count once, and a doc_id with both labels teaches nothing. The score is calibrated on a quarter
    of the sample that the chain has not seen, to the shares of the labels among all labelled rows. Without rows of both labels
    every score is the share of toxic rows, 0 without any.
    """
    marked = (labels.where(train & F.col("toxic").isNotNull()).groupBy("doc_id")
              .agg(F.min((F.col("toxic") == 1).cast("int")).alias("toxic"), F.max((F.col("toxic") == 1).cast("int")).alias("other"))
              .where("toxic = other").drop("other"))
    number = {r["toxic"]: r["n"] for r in marked.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n1, n0 = number.get(1, 0), number.get(0, 0)
    share = (n1 + 0.0) / max(n1 + n0, 1)
    none = Model(np.zeros(0, np.uint64), np.zeros(0), -30.0, np.zeros((2, 2)), -30.0, math.log(max(share, 1e-9) / max(1 - share, 1e-9)), 0.0)
    if not n1 or not n0:
        return none
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000).cast("long"))
    kept = F.when(F.col("toxic") == 1, place < math.ceil(1e6 * min(1, sample_rows / n1))).otherwise(place < math.ceil(1e6 * min(1, sample_rows / n0)))
    chosen = F.broadcast(marked.where(kept))  # twice sample_rows rows or so
    # one row per text: rows that repeat a document are folded before they reach the driver
    lengths = (docs.join(chosen, "doc_id").groupBy(F.xxhash64("text").alias("key"))
               .agg(F.min("doc_id").alias("doc_id"), F.min("toxic").alias("toxic"), F.min(F.length("text").cast("long")).alias("chars")))
    picked, used = [], {0: 0, 1: 0}
    for r in sorted(lengths.where("chars > 0").collect(), key=lambda r: (r["key"], r["doc_id"])):
        if used[r["toxic"]] < sample_chars // 2 and (not picked or picked[-1][0] != r["key"]):
            used[r["toxic"]] += r["chars"]
            picked.append((r["key"], r["doc_id"], r["toxic"]))
    if not picked:
        return none
    wanted = docs.sparkSession.createDataFrame(picked, "wanted long, doc_id long, toxic int")
    table = (docs.select("doc_id", F.col("text").cast("string").alias("text"), F.xxhash64("text").alias("key")).join(F.broadcast(wanted), "doc_id")
             .where("key = wanted").dropDuplicates(["key"]).orderBy("key").select("key", "text", "toxic").toArrow())
    toxic = table["toxic"].to_numpy().astype(float)
    if not (0 < toxic.sum() < len(toxic)):
        return none
    held = table["key"].to_numpy() % 4 == 0
    if not all(0 < toxic[part].sum() < part.sum() for part in (held, ~held)) or toxic[held].sum() < LEAST_HELD:
        held = np.zeros(len(toxic), dtype=bool)  # too few to hold any back
    tokens = _Tokens(table["text"].filter(pa.array(~held)))
    model = _train_chain(tokens, _telling(tokens, toxic[~held], least_ratio, most_features), toxic[~held], chain_rounds)
    if held.any():
        tokens, toxic = _Tokens(table["text"].filter(pa.array(held))), toxic[held]
    evidence = np.log(_evidence(marginals(model, tokens.first, _emissions(model, tokens)), tokens.first) + LITTLE)
    weight = np.where(toxic > 0, n1 / max(toxic.sum(), 1), n0 / max((1 - toxic).sum(), 1))
    model.intercept, model.slope = _calibrate(evidence, toxic, weight / weight.sum())
    return model


def _calibrate(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Weighted logistic regression on one variable by damped Newton steps."""
    beta, ridge = np.zeros(2), np.diag([1e-6, 1e-4])
    design = np.stack([np.ones(len(x)), x])
    for _ in range(100):
        p = _sigmoid(beta @ design)
        gradient = design @ (weight * (p - y)) + ridge @ beta
        curve = (design * (weight * p * (1 - p))) @ design.T + ridge
        move = np.linalg.solve(curve, gradient)
        move *= min(1.0, 2.0 / max(np.abs(move).max(), 1e-12))
        beta -= move
        if np.abs(move).max() < 1e-9:
            break
    return float(beta[0]), float(beta[1])


def score(docs: DataFrame, model: Model, span_probability: float = 0.5) -> DataFrame:
    """(doc_id, score, spans) per row of ``docs`` (doc_id, text); spans are the tokens at least ``span_probability`` toxic.

    Offsets count code points, end exclusive; neighbouring toxic tokens are one span. Null text is empty; a text without tokens
    has the score of no evidence. Repeated rows are answered one by one; an empty table gives an empty result; other columns
    are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def judge(batches):
        for b in batches:
            for start in range(0, b.num_rows, 1000):
                yield _judge(b.slice(start, 1000), shared.value, span_probability)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(judge, SCORED)


def below(docs: DataFrame, model: Model, threshold: float) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose score is below the threshold; in one pass and without a join."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def keep(batches):
        for b in batches:
            for start in range(0, b.num_rows, 1000):
                part = b.slice(start, 1000)
                tokens = _Tokens(part.column("text"))
                p = marginals(shared.value, tokens.first, _emissions(shared.value, tokens))
                scores = _sigmoid(shared.value.intercept + shared.value.slope * np.log(_evidence(p, tokens.first) + LITTLE))
                yield part.filter(pa.array(scores < threshold))

    return docs.mapInArrow(keep, docs.schema)


def _judge(b: pa.RecordBatch, model: Model, least: float) -> pa.RecordBatch:
    texts = b.column("text")
    tokens = _Tokens(texts)
    p = marginals(model, tokens.first, _emissions(model, tokens))
    scores = _sigmoid(model.intercept + model.slope * np.log(_evidence(p, tokens.first) + LITTLE))
    spans: list[list[dict]] = [[] for _ in range(b.num_rows)]
    hot = np.flatnonzero(p >= least)
    if len(hot):
        data, offsets = flat_bytes(texts)
        points = np.r_[0, np.cumsum((data & 0xC0) != 0x80)]
        text = tokens.words.text_of_word()[hot]
        for i, d in zip(hot, text):
            begin, end = (int(points[x] - points[offsets[d]]) for x in (tokens.words.begin[i], tokens.words.end[i]))
            if spans[d] and spans[d][-1]["last"] == i - 1:
                spans[d][-1] |= {"end": end, "last": i, "probability": max(spans[d][-1]["probability"], float(p[i]))}
            else:
                spans[d].append({"begin": begin, "end": end, "probability": float(p[i]), "last": i})
    kind = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64()), ("probability", pa.float64())]))
    listed = [[{k: s[k] for k in ("begin", "end", "probability")} for s in row] for row in spans]
    return pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(scores, pa.float64()), pa.array(listed, kind)], ["doc_id", "score", "spans"])
