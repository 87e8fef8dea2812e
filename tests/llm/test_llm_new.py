"""Quality classifier, collocations and vector codes against plain Python."""

import hashlib
import math
import random
import re
import struct
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from stackloom.llm import codes, collocations, quality

FOLDER = "/root/testdata/sf0.01"
CLASHES = ["n", "phrase", "text_key", "y", "a", "l", "r", "score", "rank", "prefix", "reach", "word", "all", "slot", "weight", "part",
           "entry", "total", "code", "error", "of", "width"]


def clashing(df):
    return df.withColumns({c: F.lit("clash") for c in CLASHES if c not in df.columns}).repartition(3)


# --- quality -----------------------------------------------------------------------------------------------------------

def plain_slots(text, bits):
    """Words, pairs of words and repeats, told apart as text."""
    words = re.findall(r"[0-9A-Za-z\x80-\U0010ffff]+|[^0-9A-Za-z\x80-\U0010ffff\s]+", text or "", re.A)
    words = ["".join(c.lower() if c < "\x80" else c for c in w) for w in words]
    pairs = list(zip(words, words[1:]))
    return Counter(words) + Counter(pairs) + Counter("again" for a, b in pairs if a == b)


def test_ngram_slots():
    texts = ["The cat. The, the", "", None, "a a A b", "x", "##é é## !!", "a a"]
    slots, first = quality.ngram_slots(pa.array(texts, pa.string()), 30)
    for i, text in enumerate(texts):
        own = slots[first[i]:first[i + 1]]
        assert sorted(Counter(own.tolist()).values()) == sorted(plain_slots(text, 30).values()), text
    assert set(slots[first[6]:first[7]]) <= set(slots[first[3]:first[4]])


def test_ftrl_by_hand():
    rng, bits = random.Random(3), 4
    rows = [[rng.randrange(16) for _ in range(rng.randrange(0, 6))] for _ in range(40)]
    label = np.array([float(sum(r) % 3 == 0) for r in rows])
    weight = np.array([1.0 if y else 0.5 for y in label])
    first = np.r_[0, np.cumsum([len(r) for r in rows])]
    model = quality.train_ftrl(np.array(sum(rows, []), dtype=int), first, label, weight, bits, epochs=3, alpha=0.3, beta=1.0, l1=0.05, l2=0.5)
    z, n = [0.0] * 17, [0.0] * 17

    def w(i):
        if i == 16:
            return -z[i] * 0.3 / (1 + math.sqrt(n[i]))
        return 0.0 if abs(z[i]) <= 0.05 else -(z[i] - math.copysign(0.05, z[i])) / ((1 + math.sqrt(n[i])) / 0.3 + 0.5)

    for _ in range(3):
        for r, y, c in zip(rows, label, weight):
            x = {k: v / math.sqrt(len(r)) for k, v in Counter(r).items()} | {16: 1.0}
            now = {i: w(i) for i in x}
            p = 1 / (1 + math.exp(-sum(now[i] * x[i] for i in x)))
            for i in x:
                g = c * (p - y) * x[i]
                z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / 0.3 * now[i]
                n[i] += g * g
    assert np.allclose(model.weights, [w(i) for i in range(16)], atol=1e-6) and math.isclose(model.bias, w(16), rel_tol=1e-9)


def test_quality_held_out(spark):
    docs, labels = (spark.read.parquet(f"{FOLDER}/{t}.parquet") for t in ("documents", "labels"))
    fold = F.crc32(F.col("doc_id").cast("string")) % 5
    model = quality.fit(docs, labels, fold != 0)
    held = quality.score(docs, model).join(labels, "doc_id").where(fold == 0).collect()
    right = sum((r.score >= 0.3) == bool(r.quality) for r in held)
    assert len(held) > 50 and right / len(held) >= 0.9 and all(r.score >= 0.3 for r in held if r.quality == 1)


def test_quality_edges(spark):
    good, bad = "fine words in a row", "### %%% ### %%%"
    docs = clashing(spark.createDataFrame([(i, f"{good if i % 2 else bad} {i}") for i in range(40)] + [(100, None), (101, ""), (None, bad), (1, good),
                                          (102, "both"), (103, good * 3000)], "doc_id long, text string"))
    labels = clashing(spark.createDataFrame([(i, i % 2) for i in range(40)] + [(0, 0), (102, 0), (102, 1), (None, 1), (5, None), (999, 1)],
                                            "doc_id long, quality int"))
    model = quality.fit(docs, labels, F.lit(True))
    found = quality.score(docs, model)
    assert found.columns == ["doc_id", "score"] and found.count() == 46
    score = {r.doc_id: r.score for r in found.collect()}
    assert all((score[i] >= 0.5) == bool(i % 2) for i in range(40)) and score[None] < 0.5 < score[103] and score[100] == score[101]
    assert {r.score for r in quality.score(docs, quality.fit(docs, labels.where("quality = 1 and doc_id < 40"), F.lit(True))).collect()} == {1.0}
    assert {round(r.score, 9) for r in quality.score(docs, quality.fit(docs, labels.limit(0), F.lit(True))).collect()} == {0.0}
    assert quality.score(docs.limit(0), model).count() == 0
    small = quality.fit(docs, labels, F.lit(True), sample_rows=10, sample_chars=200)
    assert 0 < np.count_nonzero(small.weights) < np.count_nonzero(model.weights)


# --- collocations ------------------------------------------------------------------------------------------------------

def plain_collocations(rows, limit, least, percent):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang, text = lang or "und", "".join(c.lower() if c < "\x80" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, 5):
                for i in range(len(words) - k + 1):
                    f[lang, tuple(words[i:i + k])] += 1
    often = {key: a for key, a in f.items() if a >= least and len(key[1]) > 1}
    out = {}
    for (lang, p), a in often.items():
        if any(l2 == lang and len(q) > len(p) and 100 * b >= percent * a and any(q[i:i + len(p)] == p for i in range(len(q) - len(p) + 1))
               for (l2, q), b in often.items()):
            continue
        cuts = [(2_000_000 * a // (f[lang, p[:k]] + f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p))]
        score, _, left, right = min(cuts)
        out.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), left, right))
    return sorted((lang, i + 1, p.decode(), -a, left, right, n[lang], -score)
                  for lang, found in out.items() for i, (score, a, p, left, right) in enumerate(sorted(found)[:limit]))


@pytest.mark.parametrize("seed,limit,ahead", [(1, 4, 1), (2, 10, 2), (3, 2000, 2), (4, 25, 1)])
def test_collocations(spark, seed, limit, ahead):
    rng = random.Random(seed)
    fixed = [[rng.choice("abcdefgh") for _ in range(rng.randrange(2, 6))] for _ in range(12)]
    rows = []
    for i in range(160):
        words = sum((rng.choice(fixed) if rng.random() < 0.5 else [rng.choice(["A", "b", "É", "c", "d", "zz", "g"])] for _ in range(rng.randrange(0, 12))), [])
        rows.append((rng.choice(["en", "en", "fr", None]), "".join(w + rng.choice([" ", " ", "  ", "\t", ", ", "\n", ". ", "! "]) for w in words)))
    rows += [(None, None), ("en", ""), ("und", "a b a b a b"), ("xx", "one two"), rows[0], rows[0], ("en", "word " * 3000)]
    found = collocations.collocations(clashing(spark.createDataFrame(rows, "lang string, text string")), limit=limit, least=3, ahead=ahead)
    assert found.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, found.collect())) == plain_collocations(rows, limit, 3, 80)


def test_collocations_of_nothing(spark):
    for rows in ([], [("en", None)], [("en", "a b c")]):
        assert collocations.collocations(spark.createDataFrame(rows, "lang string, text string")).count() == 0


def test_phrases_of_one_hash():
    hashes, checks = np.array([7, 7, 3, 7], np.uint64), np.array([1, 2, 5, 1], np.uint32)
    first, count = collocations._distinct(hashes, checks)
    assert sorted(zip(first.tolist(), count.tolist())) == [(0, 2), (1, 1), (2, 1)]


# --- vector codes ------------------------------------------------------------------------------------------------------

def plain_codes(rows, parts, entries, rounds):
    def whole(x):
        n, d = x.as_integer_ratio()
        return 4096 * n // d

    kept = [(i, [whole(x) for x in e], lab) for i, e, lab in rows if e and len(e) % parts == 0 and all(x is not None and math.isfinite(x) for x in e)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    kept = [r for r in kept if len(r[1]) == len(kept[0][1])]
    if not kept:
        return []
    width = len(kept[0][1]) // parts
    cut = lambda v, p: v[p * width:(p + 1) * width]
    books = [[cut(v, p) for _, v, _ in kept[:entries]] for p in range(parts)]
    dist = lambda a, b: sum((x - y)**2 for x, y in zip(a, b))
    nearest = lambda v, p: min((dist(cut(v, p), e), i) for i, e in enumerate(books[p]))
    for _ in range(rounds):
        new = []
        for p in range(parts):
            groups = {}
            for _, v, _ in kept:
                groups.setdefault(nearest(v, p)[1], []).append(cut(v, p))
            new.append([[sum(c) // len(c) for c in zip(*groups[i])] if i in groups else e for i, e in enumerate(books[p])])
        books = new
    sha = hashlib.sha256(",".join(str(x) for p in books for e in p for x in e).encode()).hexdigest()
    coded = [(i, "".join(f"{nearest(v, p)[1]:02x}" for p in range(parts)), sum(nearest(v, p)[0] for p in range(parts)), lab) for i, v, lab in kept]
    by = Counter()
    for _, _, e, lab in coded:
        by[lab] += e
    fit = lambda v: v if v < 2**63 else None
    return sorted(((i, c, fit(e), fit(by[lab]), sha) for i, c, e, lab in coded), key=str)


@pytest.mark.parametrize("seed,n,scale", [(1, 120, 1.0), (2, 9, 1.0), (3, 60, 1e5), (4, 40, 3e37), (5, 0, 1.0)])
def test_vector_codes(spark, seed, n, scale):
    rng = random.Random(seed)
    single = lambda x: struct.unpack("f", struct.pack("f", x))[0]
    vector = lambda: [single(rng.choice([0.0, -0.0, 0.5, rng.uniform(-1, 1), rng.uniform(-1, 1) * scale])) for _ in range(16)]
    rows = [(i, vector(), rng.choice([0, 1, None])) for i in range(n)]
    if rows:
        rows += [rows[0], (3, rows[1][1], 1), (None, rows[2][1], None), (500, None, 0), (-5, [], 0), (-6, [1.0] * 15, 1), (501, [None] + [0.0] * 15, 1),
                 (-7, [math.nan] * 16, 1), (-8, [math.inf] + [1.0] * 15, 2), (502, [1.0] * 24, 1)]
    frame = clashing(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"))
    found = codes.vector_codes(frame)
    assert found.columns == ["vec_id", "label", "code", "error", "label_error", "codebooks_sha256"]
    assert sorted(map(tuple, found.drop("label").collect()), key=str) == plain_codes(rows, 8, 16, 6)
