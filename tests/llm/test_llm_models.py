"""Language model, language identification and toxicity: exact sums, brute force and held-out accuracy."""

import itertools
import math
import random
import re
from collections import Counter, OrderedDict, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from stackloom.llm import katz, language, toxicity
from stackloom.llm.words import rolling, words_of

FOLDER = "/root/testdata/sf0.01"


def test_words_and_runs():
    texts = ["", None, "Ab ä\tab\x0b\n", " x", "ab" * 900_000 + " q", "ab ab ab ab ab ab ab"]
    words = words_of(pa.array(texts, pa.string()), lower=True)
    assert list(words.count) == [0, 0, 3, 1, 2, 7]
    h = words.hash
    assert h[0] == h[2] == h[6] and h[0] != h[1] and len(set(h[6:])) == 1
    for length in (1, 2, 3, 5, 7, 50):
        runs = rolling(np.tile(h[1:5], 30), length)
        assert len(runs) == 121 - length and len(set(runs)) == min(4, 121 - length)
    assert rolling(h[:1], 2).size == 0


def test_words_alike_modulo_powers_of_two(spark):
    word = "a"
    for _ in range(10):
        word += word.translate(str.maketrans("ab", "ba"))
    other = word.translate(str.maketrans("ab", "ba"))
    assert len(set(words_of(pa.array([word, other])).hash)) == 2
    docs = spark.createDataFrame([(1, f"{word} x"), (2, f"{other} x")], "doc_id long, text string")
    found = {r.doc_id: r for r in katz.score_texts(docs, F.col("doc_id") == 1).collect()}
    assert (found[1].n_known, found[2].n_known) == (3, 2) and found[2].score < found[1].score


def katz_by_hand(docs, train):
    tokens = [re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c < "\x7f" else c for c in t or "")) + ["</s>"] for _, t in docs]
    uni, big = Counter(), defaultdict(Counter)
    for w, learn in zip(tokens, train):
        if learn:
            for a, b in zip(["<s>", *w], w):
                uni[b] += 1
                big[a][b] += 1
    n = sum(uni.values())
    of = lambda c: katz.discounts(np.array([c[r] for r in range(1, 7)]))
    d1, d2 = of(Counter(uni.values())), of(Counter(c for f in big.values() for c in f.values()))
    p1 = {w: d1[min(c, 6)] * c / n for w, c in uni.items()}
    unknown = 1 - sum(p1.values())
    if unknown <= 1e-12:
        p1, unknown = {w: p * n / (n + 1) for w, p in p1.items()}, 1 / (n + 1)
    context = {}
    for h, f in big.items():
        total, mass = sum(f.values()), sum(d2[min(c, 6)] * c for c in f.values())
        room = total + 1 if total - mass <= 1e-9 * total else total
        context[h] = (room, (room - mass) / room / (1 - sum(p1[w] for w in f)))

    def p(w, h):
        if h in context and big[h][w]:
            return d2[min(big[h][w], 6)] * big[h][w] / context[h][0]
        return p1.get(w, unknown) * (context[h][1] if h in context else 1)
    return tokens, uni, n, p


def test_katz(spark):
    rng = random.Random(3)
    docs = [(i, " ".join(rng.choice("the of a B c d e f ga hb ic x%d" % rng.randrange(90)) if rng.random() < .3 else rng.choice(["the", "of", "Zu"])
                         for _ in range(rng.randrange(0, 60)))) for i in range(80)] + [(80, None), (81, ""), (3, "the of never seen"), (None, "the of")]
    train = [i is not None and i % 5 != 1 for i, _ in docs]
    rows = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"batch": F.lit(1), "kind": F.lit(2), "blob": F.lit("x")}).repartition(3)
    found = katz.score_texts(rows, F.col("doc_id") % 5 != 1, batch_chars=700).collect()
    tokens, uni, n, p = katz_by_hand(docs, train)
    for h in ("<s>", "the", "of", "x1", "never"):  # every context sums to one over the vocabulary and the unknown
        assert abs(sum(p(w, h) for w in uni) + p("<unknown>", h) - 1) < 1e-9
    want = []
    for (i, _), w, learn in zip(docs, tokens, train):
        want.append((str(i), not learn, len(w), sum(t in uni for t in w), n,
                     round(sum(math.log10((uni[t] + .5) / (n + .5 * (len(uni) + 1))) for t in w), 6),
                     round(sum(math.log10(p(t, h)) for h, t in zip(["<s>", *w], w)), 5)))
    got = [(str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 5)) for r in found]
    assert sorted(got) == sorted(want)


def test_katz_without_training(spark):
    rows = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert [(r.n_tokens, r.n_known, r.train_tokens) for r in katz.score_texts(rows, F.lit(False)).collect()] == [(3, 0, 0)]
    assert katz.score_texts(rows.limit(0), F.lit(True)).count() == 0


def test_language(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").withColumn("key", F.lit(1))
    held = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    found = language.identify(docs, language.fit(docs, ~held)).join(docs.select("doc_id", "lang"), "doc_id")
    hits = found.where(held).agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert hits > 0.97
    assert found.where("score < 0 OR score > 1").count() == 0


def test_language_edges(spark):
    docs = spark.createDataFrame([(1, "the house", "en"), (2, "das Haus über", "de"), (3, None, "en"), (4, "12 ..", None), (5, "überhaus", None),
                                  (5, "overhouse", None), (None, "ζ", None)], "doc_id long, text string, lang string")
    model = language.fit(docs, F.lit(True))
    found = sorted((str(r.doc_id), r.lang_pred) for r in language.identify(docs, model).collect())
    assert found[:4] == [("1", "en"), ("2", "de"), ("3", "und"), ("4", "und")] and {("5", "de"), ("5", "en")} <= set(found)
    none = language.fit(docs, F.lit(False))
    assert {r.lang_pred for r in language.identify(docs, none).collect()} == {"und"}
    assert model.predict("unbekannt Haus", OrderedDict())[0] == "de"


def test_language_by_hand(spark):
    """Scores against the sums written out in plain Python, unseen words by their longest known n-grams."""
    rng = random.Random(8)
    words = {"de": ["haus", "baum", "und", "der", "straße"], "fr": ["maison", "arbre", "et", "le", "façade"], "xx": ["haus", "arbre", "zoo"]}
    rows = [(i, lang, " ".join(rng.choice(own) for _ in range(rng.randrange(1, 9)))) for i, (lang, own) in enumerate(list(words.items()) * 12)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string").withColumn("key", F.lit("clash"))
    kinds = [defaultdict(Counter) for _ in range(6)]
    for _, lang, text in rows:
        for w in text.split():
            kinds[0][lang][w] += 1
            for n in range(1, 6):
                for g in language.grams_of(w, n):
                    kinds[n][lang][g] += 1
    known = [set().union(*(c.keys() for c in k.values())) for k in kinds]
    total = [{lang: sum(c.values()) for lang, c in k.items()} for k in kinds]
    chance = lambda kind, lang, key: math.log((kinds[kind][lang][key] + 0.5) / (total[kind].get(lang, 0) + 0.5 * max(len(known[kind]), 1)))

    def score(text, lang):
        out = 0.0
        for w in text.lower().split():
            if w in known[0]:
                out += chance(0, lang, w)
                continue
            for n in range(5, 0, -1):
                grams = [g for g in language.grams_of(w, n) if g in known[n]]
                if grams:
                    out += sum(chance(n, lang, g) for g in grams) / len(grams)
                    break
        return out

    tested = ["der Baum und das Häuschen", "maisonette et arbres", "zoologe", "haus arbre", "qqq"]
    found = {r.doc_id: r for r in language.identify(spark.createDataFrame(list(enumerate(tested)), "doc_id long, text string"), language.fit(docs, F.lit(True))).collect()}
    for i, text in enumerate(tested):
        sums = {lang: score(text, lang) for lang in words}
        best = max(sorted(sums), key=sums.get)
        assert found[i].lang_pred == best
        assert math.isclose(found[i].score, 1 / sum(math.exp(v - sums[best]) for v in sums.values()), rel_tol=1e-4)
    few, whole = language.fit(docs, F.lit(True), sample_chars=150), language.fit(docs, F.lit(True))
    assert 0 < few.gain.sum() < whole.gain.sum()


def test_marginals_by_enumeration():
    rng = np.random.default_rng(5)
    model = toxicity.Model(np.zeros(0, np.uint64), np.zeros(0), 0.0, rng.normal(size=(2, 2)), 0.4, 0, 1)
    lengths = [0, 1, 5, 3, 0, 7]
    first = np.r_[0, np.cumsum(lengths)]
    emission = rng.normal(size=first[-1]) * 2
    found = toxicity.marginals(model, first, emission)
    for a, b in zip(first, first[1:]):
        weight = np.zeros((b - a, 2))
        for path in itertools.product((0, 1), repeat=b - a):
            s = sum(emission[a + t] * y for t, y in enumerate(path)) + (model.start * path[0] if path else 0)
            s += sum(model.moves[x, y] for x, y in zip(path, path[1:]))
            for t, y in enumerate(path):
                weight[t, y] += math.exp(s)
        assert np.allclose(found[a:b], weight[:, 1] / weight.sum(axis=1))


def test_pair_marginals_by_enumeration():
    rng = np.random.default_rng(6)
    model = toxicity.Model(np.zeros(0, np.uint64), np.zeros(0), 0.0, rng.normal(size=(2, 2)), -0.3, 0, 1)
    lengths = [1, 4, 0, 6, 2]
    first = np.r_[0, np.cumsum(lengths)]
    emission = rng.normal(size=first[-1])
    marginal, pairs = toxicity.pair_marginals(model, first, emission)
    want = np.zeros((2, 2))
    for a, b in zip(first, first[1:]):
        found, total = np.zeros((2, 2)), 0.0
        for path in itertools.product((0, 1), repeat=b - a):
            s = math.exp(sum(emission[a + t] * y for t, y in enumerate(path)) + (model.start * path[0] if path else 0)
                         + sum(model.moves[x, y] for x, y in zip(path, path[1:])))
            total += s
            for x, y in zip(path, path[1:]):
                found[x, y] += s
        want += found / total
    assert np.allclose(pairs, want) and np.allclose(marginal, toxicity.marginals(model, first, emission))


def test_training_raises_the_likelihood_of_the_labels():
    rng = random.Random(2)
    texts = [" ".join(rng.choice(["bad", "bad", "ok"]) if rng.random() < 0.3 else rng.choice("abcdef") for _ in range(30)) for _ in range(40)]
    tokens = toxicity._Tokens(pa.array(texts))
    telling = np.unique([tokens.words.hash[texts[0].split().index(w)] for w in ("bad",) if w in texts[0].split()])
    toxic = np.ones(40)
    label = np.isin(tokens.words.hash, telling)

    def loss(model):
        p = toxicity.marginals(model, tokens.first, toxicity._emissions(model, tokens))
        return -np.log(np.where(label, p, 1 - p) + 1e-12).sum()
    few, many = (toxicity._train_chain(tokens, telling, toxic, n) for n in (1, 25))
    assert loss(many) < 0.2 * loss(few) and not np.allclose(few.moves, many.moves) and few.start != many.start


def test_documents_with_both_labels_teach_nothing(spark):
    docs, labels = toxic_corpus(spark)
    both = labels.unionByName(labels.where("doc_id % 6 = 0").withColumn("toxic", F.lit(0)))
    assert {round(r.score, 6) for r in toxicity.score(docs, toxicity.fit(docs, both, F.lit(True))).collect()} == {0}


def toxic_corpus(spark, n=900):
    rng = random.Random(11)
    words = ["".join(rng.choice("aeioubdnst") for _ in range(rng.randrange(2, 7))) for _ in range(400)]
    docs, labels = [], []
    for i in range(n):
        text = [rng.choice(words) for _ in range(rng.randrange(5, 80))]
        toxic = i % 6 == 0
        for _ in range(rng.randrange(2, 5) if toxic else 0):
            text.insert(rng.randrange(len(text)), rng.choice(["Vile", "grubb" + rng.choice(["er", "ing", "ö"]), "scoundrel!"]))
        docs.append((i, "ä " + " ".join(text)))
        labels.append((i, int(toxic)))
    docs += [(n, None), (n + 1, ""), (n + 2, "..."), (7, "vile grubbling scoundrel"), (None, "fine words")]
    return spark.createDataFrame(docs, "doc_id long, text string").withColumn("score", F.lit("clash")), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_toxicity(spark):
    docs, labels = toxic_corpus(spark)
    model = toxicity.fit(docs, labels, F.col("doc_id") % 4 != 2)
    found = toxicity.score(docs, model)
    tested = found.where("doc_id % 4 = 2").join(labels, "doc_id").select("toxic", (F.col("score") >= 0.3).cast("int").alias("p")).collect()
    assert np.mean([r.toxic == r.p for r in tested]) > 0.97
    rows = {r.doc_id: r for r in found.where("doc_id > 7 OR doc_id IS NULL").collect()}
    assert all(0 <= rows[i].score < 0.3 and not rows[i].spans for i in (900, 901, 902, None))
    texts = {r.doc_id: r.text for r in docs.collect()}
    spans = [texts[i][s.begin:s.end].lower() for i, r in rows.items() for s in r.spans]
    assert len(spans) > 100 and np.mean([bool(re.search("vile|grubb|scoundrel", s)) for s in spans]) > 0.97
    kept = toxicity.below(docs, model, 0.3)
    assert kept.columns == docs.columns and kept.count() == found.where("score < 0.3").count()


def test_toxicity_without_labels(spark):
    docs, labels = toxic_corpus(spark, 12)
    for marked, share in ((labels.limit(0), 0), (labels.withColumn("toxic", F.lit(1)), 1), (labels.withColumn("toxic", F.lit(None).cast("int")), 0)):
        scores = {round(r.score, 6) for r in toxicity.score(docs, toxicity.fit(docs, marked, F.lit(True))).collect()}
        assert scores == {share}
    assert toxicity.score(docs.limit(0), toxicity.fit(docs.limit(0), labels, F.lit(True))).count() == 0
