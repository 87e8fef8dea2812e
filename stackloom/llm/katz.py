"""Katz back-off language model over words, counted and evaluated in Spark.

A token is a word (A-Z lower-cased) or the end of a text. Token probabilities are bigram probabilities: Good-Turing discounted
relative frequencies where the bigram was seen in training, otherwise the backed-off unigram probability of the token times
the context's back-off weight, which makes each context sum to one over the vocabulary and the class of unknown words.
Unigrams are discounted the same way; what they lose is the probability of an unknown word.

Tables of counts are partitioned by key: batches of documents send their distinct unigrams and bigrams with local training
counts to buckets, buckets add them up and answer each batch (see ``exchange``). One batch owns each distinct training
bigram and adds its discounted count and its unigram probability to the sums of its context, which travel the same way and
come back as the back-off weight (in single precision); contexts that only one batch holds stay there. The vocabulary needs no place in any single task or the driver; only token and type
totals are collected. Every bucket of bigrams tells every batch how many of its types were seen once, twice and so on; the
batches add these up, so all discount by the counts of the whole corpus.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stackloom.llm import exchange
from stackloom.llm.words import CHECK_BASE, mix, words_of

END, BEGIN = np.uint64(0x9D39247E33776D41), np.uint64(0x2AF7398005AAA5C7)
MOST = 5  # counts above this are trusted as they are (the usual choice of Katz)
UNIGRAM, BIGRAM, WEIGHT = 1, 2, 3
ROW = "kind int, bucket long, batch long, keys binary, extra binary"
ANSWER = "batch long, kind int, bucket long, payload binary, flags binary, seen binary"
SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, base_part double, score double"


def discounts(count_of_counts: np.ndarray) -> np.ndarray:
    """Katz's factors for counts 0..MOST+1 (last: 1) from the numbers of types seen 1, 2, ... MOST + 1 times.

    Where Good-Turing estimates are not in (0, 1), as in tiny tables, a count keeps all but half an occurrence.
    """
    n = np.r_[0.0, count_of_counts.astype(float)]
    d = np.ones(MOST + 2)
    for r in range(1, MOST + 1):
        d[r] = 1 - 0.5 / r
        if n[1] > 0 and n[r] > 0:
            spill = (MOST + 1) * n[MOST + 1] / n[1]
            if spill < 1:
                estimate = ((r + 1) * n[r + 1] / (r * n[r]) - spill) / (1 - spill)
                if 0 < estimate < 1:
                    d[r] = estimate
    return d


def _planes(values: np.ndarray) -> bytes:
    return values.astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes()


def _unplane(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).view("<u8").reshape(-1).astype(np.int64)


def _floats(values: np.ndarray, kind: str = "<f8") -> bytes:
    return np.ascontiguousarray(values, dtype=kind).view(np.uint8).reshape(-1, int(kind[2])).T.tobytes()


def _unfloat(data: bytes, kind: str = "<f8") -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(int(kind[2]), -1).T).view(kind).reshape(-1).astype(float)


def _rows(kind: int, batch: int, keys: np.ndarray, bits: int, extra) -> list[tuple]:
    return [(kind, b, batch, exchange.encode(keys[x:y]), extra(x, y)) for b, x, y in exchange.slices(keys, bits)]


def _row_table(rows: list[tuple]) -> pa.Table:
    kinds = (pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
    return pa.table({c: pa.array([r[i] for r in rows], k) for i, (c, k) in enumerate(zip(("kind", "bucket", "batch", "keys", "extra"), kinds))})


class _Batch:
    """Tokens of a batch of documents, its distinct unigrams and bigrams and their training counts."""

    def __init__(self, blobs: pa.Table):
        parts = [pa.ipc.open_stream(b).read_all() for b in blobs["blob"].to_pylist()]
        table = pa.concat_tables(parts).combine_chunks()
        self.ids, self.train = table["doc_id"], table["train"].to_numpy()
        words = words_of(table["text"], lower=True)
        n = len(table)
        self.count = words.count + 1
        self.token = np.insert(words.hash, words.first[1:], END)
        self.begins = np.r_[0, np.cumsum(self.count)[:-1]]
        context = np.r_[BEGIN, self.token[:-1]]
        context[self.begins] = BEGIN
        learn = np.repeat(self.train, self.count)
        self.unigrams, number = np.unique(np.r_[self.token, BEGIN], return_inverse=True)
        self.tok, begin = number[:-1], number[-1]
        self.ctx = np.r_[begin, self.tok[:-1]]
        self.ctx[self.begins] = begin
        self.unigram_counts = np.bincount(self.tok[learn], minlength=len(self.unigrams))
        self.unigram_counts[begin] = int(self.train.sum())
        self.bigrams, first, self.big = np.unique(mix(context * CHECK_BASE + self.token), return_index=True, return_inverse=True)
        self.big_tok, self.big_ctx = self.tok[first], self.ctx[first]
        self.bigram_counts = np.bincount(self.big[learn], minlength=len(self.bigrams))
        assert len(self.count) == n


def _spread(keys: np.ndarray, bits: int, replies: dict, read, empty):
    """One array over ``keys`` from the replies of its buckets."""
    out = [read(replies[b]) if b in replies else empty(y - x) for b, x, y in exchange.slices(keys, bits)]
    return np.concatenate(out) if out else empty(0)


class _Model:
    """What the buckets answered to one batch."""

    def __init__(self, batch: _Batch, answers: pa.Table, bits: int, factors: np.ndarray, total: int, unknown: float):
        rows = answers.to_pylist()
        of = {kind: {r["bucket"]: r for r in rows if r["kind"] == kind and r["payload"] is not None} for kind in (UNIGRAM, BIGRAM, WEIGHT)}
        seen = sum((np.frombuffer(r["seen"], "<i8") for r in rows if r["kind"] == BIGRAM), np.zeros(MOST + 1, dtype=np.int64))
        zeros = lambda n: np.zeros(n, dtype=np.int64)
        self.unigram = _spread(batch.unigrams, bits, of[UNIGRAM], lambda r: _unplane(r["payload"]), zeros)
        self.probability = np.where(self.unigram > 0, factors[np.minimum(self.unigram, MOST + 1)] * self.unigram / max(total, 1), unknown)
        self.bigram = _spread(batch.bigrams, bits, of[BIGRAM], lambda r: _unplane(r["payload"]), zeros)
        self.discounted = discounts(seen)[np.minimum(self.bigram, MOST + 1)] * self.bigram
        owner = [np.unpackbits(np.frombuffer(of[BIGRAM][b]["flags"], np.uint8), count=y - x).astype(bool) if b in of[BIGRAM]
                 else np.zeros(y - x, dtype=bool) for b, x, y in exchange.slices(batch.bigrams, bits)]
        self.owner = np.concatenate(owner) if owner else np.zeros(0, bool)
        self.total = {b: r["payload"] for b, r in of[WEIGHT].items()}
        # sums over the contexts of this batch; complete for a context that no other batch holds
        own = self.owner
        self.mass = np.bincount(batch.big_ctx[own], self.discounted[own], len(batch.unigrams))
        self.covered = np.bincount(batch.big_ctx[own], self.probability[batch.big_tok[own]], len(batch.unigrams))
        used = np.zeros(len(batch.unigrams), dtype=bool)
        used[batch.ctx] = True
        used &= self.unigram > 0
        alone = [np.unpackbits(np.frombuffer(of[UNIGRAM][b]["flags"], np.uint8), count=y - x).astype(bool) if b in of[UNIGRAM]
                 else np.zeros(y - x, dtype=bool) for b, x, y in exchange.slices(batch.unigrams, bits)]
        self.here = used & (np.concatenate(alone) if alone else used)
        self.shared = used & ~self.here


def back_off(count: np.ndarray, mass: np.ndarray, covered: np.ndarray) -> np.ndarray:
    """Back-off weights of contexts from their count, and the discounted count and unigram probability of their bigrams.

    Negative where nothing was discounted: one more occurrence of the context then makes room for the unseen.
    """
    left = count - mass
    whole = left <= 1e-9 * count
    weight = np.where(whole, 1 / (count + 1), left / np.maximum(count, 1)) / np.maximum(1 - covered, 1e-12)
    return np.where(whole, -weight, weight)


def score_texts(docs: DataFrame, train: Column, batch_chars: int = 8_000_000) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): held_out, n_tokens, n_known, train_tokens, base_score and score.

    ``train`` says which rows the model learns from (null: all but those count as held out). ``score`` is the log10
    probability of all tokens of the text under the model, ``base_score`` the same under add-one-half unigrams. Null text is
    empty and has one token, its end. Rows that repeat a doc_id are scored one by one and counted one by one. An empty table
    gives an empty result; without training rows every word is unknown. Other columns are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
                       F.coalesce(train, F.lit(False)).alias("train"))
    chars = exchange.total_chars(rows)
    n_batches = exchange.batches_for(chars, batch_chars)
    bits = exchange.bucket_bits(chars // 6, n_batches)

    def vocabulary(batches):
        for b in batches:
            b = b.filter(b.column("train"))
            words = words_of(b.column("text"), lower=True)
            keys, counts = np.unique(np.r_[words.hash, np.full(b.num_rows, END)], return_counts=True)
            yield from _row_table(_rows(UNIGRAM, 0, keys, bits, lambda x, y: _planes(counts[x:y]))).to_batches()

    def summed(table: pa.Table):
        keys, at, order = exchange.gather(table["keys"].to_pylist())
        counts = np.concatenate([_unplane(e) for e in table["extra"].to_pylist()])
        number, begins = exchange.group_of(keys[order])
        return at, order, number, begins, counts, np.add.reduceat(counts[order], begins)

    def census(key, table):
        total = summed(table)[-1]
        seen = [int((total == r).sum()) for r in range(1, MOST + 2)]
        return exchange.released(pa.table({"n": [[int(total.sum()), len(total), *seen]]}))

    counted = (rows.where("train").mapInArrow(vocabulary, ROW).groupBy("bucket").applyInArrow(census, "n array<long>")
               .agg(*[F.sum(F.col("n")[i]) for i in range(MOST + 3)]).first())
    tokens, types, *seen = [v or 0 for v in counted]
    factors = discounts(np.array(seen))
    lost = sum(seen[r - 1] * r * (1 - factors[r]) for r in range(1, MOST + 1))
    unknown = lost / tokens if lost else 1 / (tokens + 1)
    if not lost:  # nothing was seen a few times only: one more token stands for the unknown
        factors = factors * tokens / (tokens + 1)

    def deal(batches):
        for b in batches:
            batch = b.column("batch").to_numpy()
            for k in np.unique(batch):
                part = b.select(["doc_id", "text", "train"]).take(pa.array(np.flatnonzero(batch == k)))
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, part.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 6))) as writer:
                    writer.write_batch(part)
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["batch", "blob"])

    dealt = (rows.withColumn("batch", F.pmod(F.xxhash64("doc_id"), F.lit(n_batches).cast("long")))
             .mapInArrow(deal, "batch long, blob binary").repartition(n_batches, "batch"))

    def send(key, blobs):
        batch, name = _Batch(blobs), key[0].as_py()
        return exchange.released(_row_table(_rows(UNIGRAM, name, batch.unigrams, bits, lambda x, y: _planes(batch.unigram_counts[x:y]))
                          + _rows(BIGRAM, name, batch.bigrams, bits, lambda x, y: _planes(batch.bigram_counts[x:y]))))

    def answer(key, table):
        kind, bucket = key[0].as_py(), key[1].as_py()
        table = table.sort_by([("batch", "ascending")])
        at, order, number, begins, counts, total = summed(table)
        found = np.empty(len(counts), dtype=np.int64)
        found[order] = total[number]
        mark, seen = np.zeros(len(counts), dtype=bool), None
        if kind == UNIGRAM:  # marked: no other batch has this word
            mark[order] = np.bincount(number)[number] == 1
        else:  # marked: this batch owns the bigram
            place = np.flatnonzero((counts > 0)[order])
            mark[order[place[np.r_[True, number[place][1:] != number[place][:-1]]]] if len(place) else place] = True
            seen = np.array([(total == r).sum() for r in range(1, MOST + 2)]).astype("<i8").tobytes()
        out = [(b, kind, bucket, _planes(found[x:y]), np.packbits(mark[x:y]).tobytes(), seen)
               for b, x, y in zip(table["batch"].to_pylist(), at, at[1:]) if found[x:y].any()]
        if kind == BIGRAM:  # the others get the counts alone
            out += [(b, kind, bucket, None, None, seen) for b in sorted(set(range(n_batches)) - {r[0] for r in out})]
        return exchange.released(_answer_table(out))

    def contexts(key, left, right):
        if not len(left):
            return _row_table([])
        batch = _Batch(left)
        model = _Model(batch, right, bits, factors, tokens, unknown)
        keys, count, mass, covered = (v[model.shared] for v in (batch.unigrams, model.unigram, model.mass, model.covered))
        return exchange.released(_row_table(_rows(WEIGHT, key[0].as_py(), keys, bits,
                                lambda x, y: _planes(count[x:y]) + _floats(mass[x:y]) + _floats(covered[x:y], "<f4"))))

    def weights(key, table):
        keys, at, order = exchange.gather(table["keys"].to_pylist())
        extra = [(e, len(e) // 20) for e in table["extra"].to_pylist()]
        count = np.concatenate([_unplane(e[:8 * n]) for e, n in extra])
        number, begins = exchange.group_of(keys[order])
        add = lambda parts: np.add.reduceat(np.concatenate(parts)[order], begins)
        mass, covered = add([_unfloat(e[8 * n:16 * n]) for e, n in extra]), add([_unfloat(e[16 * n:], "<f4") for e, n in extra])
        found = np.empty(len(keys))
        found[order] = back_off(count[order][begins].astype(float), mass, covered)[number]
        return exchange.released(_answer_table([(b, WEIGHT, key[0].as_py(), _floats(found[x:y], "<f4"), None, None)
                              for b, x, y in zip(table["batch"].to_pylist(), at, at[1:])]))

    def evaluate(key, left, right):
        if not len(left):
            return _score_table(*[[]] * 6)
        batch = _Batch(left)
        model = _Model(batch, right, bits, factors, tokens, unknown)
        weight = np.ones(len(batch.unigrams))
        weight[model.shared] = _spread(batch.unigrams[model.shared], bits, model.total, lambda p: _unfloat(p, "<f4"), np.ones)
        weight[model.here] = back_off(*(v[model.here].astype(float) for v in (model.unigram, model.mass, model.covered)))
        context = model.unigram + (weight < 0)
        seen = model.bigram[batch.big] > 0
        backed = np.abs(weight)[batch.ctx] * model.probability[batch.tok]
        p = np.where(seen, model.discounted[batch.big] / np.maximum(context[batch.ctx], 1), backed)
        c = model.unigram[batch.tok]
        add = lambda values: np.add.reduceat(values, batch.begins) if len(batch.begins) else np.zeros(0)
        return exchange.released(_score_table(batch.ids.cast(pa.int64()), ~batch.train, batch.count, add((c > 0).astype(np.int64)),
                                              add(np.log10(c + 0.5)), add(np.log10(p))))

    answers = dealt.groupBy("batch").applyInArrow(send, ROW).groupBy("kind", "bucket").applyInArrow(answer, ANSWER)
    weighed = (dealt.groupBy("batch").cogroup(answers.groupBy("batch")).applyInArrow(contexts, ROW)
               .groupBy("bucket").applyInArrow(weights, ANSWER))
    scored = dealt.groupBy("batch").cogroup(answers.unionByName(weighed).groupBy("batch")).applyInArrow(evaluate, SCORES)
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"),
                         (F.col("base_part") - F.col("n_tokens") * float(np.log10(tokens + 0.5 * (types + 1)))).alias("base_score"), "score")


def _answer_table(rows: list[tuple]) -> pa.Table:
    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
    names = ("batch", "kind", "bucket", "payload", "flags", "seen")
    return pa.table({c: pa.array([r[i] for r in rows], k) for i, (c, k) in enumerate(zip(names, kinds))})


def _score_table(ids, held_out, n_tokens, n_known, base_part, score) -> pa.Table:
    columns = {"doc_id": (ids, pa.int64()), "held_out": (held_out, pa.bool_()), "n_tokens": (n_tokens, pa.int64()),
               "n_known": (n_known, pa.int64()), "base_part": (base_part, pa.float64()), "score": (score, pa.float64())}
    return pa.table({name: values if isinstance(values, pa.ChunkedArray) else pa.array(values, kind) for name, (values, kind) in columns.items()})
