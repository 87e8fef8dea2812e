"""Windows, shingles, fingerprints and lines against plain Python."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from stackloom.llm import jaccard, lines, substring, winnow
from stackloom.llm.components import components

SCHEMA = "doc_id long, text string, source string"
CLASHES = ["batch", "bucket", "kind", "key", "keys", "id", "n", "root", "words", "rank", "token", "found", "items", "line", "host", "gone"]
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def corpus(seed, n=60):
    """Random texts over few words, with nulls, empty texts, repeated rows and ids, copies, near copies and a long text."""
    rng = random.Random(seed)
    word = lambda: rng.choice(["a", "b", "É", "Cc", "d,d", "e"]) + rng.choice(["", "", "x", "Y1"])
    texts = [rng.choice([" ", "\n", "\t "]).join(word() for _ in range(rng.randrange(0, 30))) for _ in range(n)]
    for _ in range(n // 3):
        w = rng.choice(texts).split(" ")
        if w:
            w[rng.randrange(len(w))] = rng.choice(["zz", "a"])
        texts.append(" ".join(w))
    texts += [None, "", " \n ", texts[0], texts[1], texts[1].upper(), " ".join(word() for _ in range(3000))]
    rows = [(i, t, rng.choice(["h1", "h2", None])) for i, t in enumerate(texts)]
    return rows + [(None, texts[2], "h1"), (5, texts[3], "h1"), (5, texts[3], "h1"), rows[4]]


def frame(spark, rows):
    """The rows with columns whose names an operator might use itself."""
    return spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("clash") for c in CLASHES}).repartition(3)


def lower(text):
    return "".join(c.lower() if c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" else c for c in text or "")


@pytest.mark.parametrize("window,batch_chars", [(3, 500), (5, 10**6)])
def test_substring(spark, window, batch_chars):
    rows = corpus(1)
    order = lambda i: (i is None, i or 0)
    first = {}
    for i, text, _ in rows:
        w = WORD.findall(text or "")
        for p in range(len(w) - window + 1):
            k = tuple(w[p:p + window])
            first[k] = min(first.get(k, i), i, key=order)
    want = []
    for i, text, _ in rows:
        w = WORD.findall(text or "")
        gone = set()
        for p in range(len(w) - window + 1):
            if order(first[tuple(w[p:p + window])]) < order(i):
                gone |= set(range(p, p + window))
        want.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    found = substring.remove_repeated_windows(frame(spark, rows), window, batch_chars).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept) for r in found), key=str) == sorted(want, key=str)
    assert all(sum(s.end - s.begin for s in r.removed) == r.n_removed for r in found)
    assert all(a.end < b.begin for r in found for a, b in zip(r.removed, r.removed[1:]))


def test_second_level_of_batches_and_equal_first_hashes(spark):
    rows = [(i if i % 7 else None, "x", None) for i in range(300)]
    dealt = substring.in_order(spark.createDataFrame(rows, SCHEMA).select("doc_id", "text"), 40, most_cuts=4).collect()
    known = sorted((r.doc_id, r.batch) for r in dealt if r.doc_id is not None)
    assert len(dealt) == 300 and [b for _, b in known] == sorted(b for _, b in known) and len({b for _, b in known}) > 25
    assert min(r.batch for r in dealt if r.doc_id is None) >= known[-1][1]
    keys, checks = np.array([5, 9, 5, 5, 9], np.uint64), np.array([1, 1, 2, 1, 1], np.uint32)
    assert list(substring._earlier(keys, checks, np.argsort(keys, kind="stable"))) == [False, False, False, True, True]


def alike():
    """Two words of 1,024 letters that have one polynomial hash modulo a power of two, whatever its base."""
    word = "a"
    for _ in range(10):
        word += word.translate(str.maketrans("ab", "ba"))
    return word, word.translate(str.maketrans("ab", "ba"))


def test_different_long_words(spark):
    one, two = alike()
    rows = [(1, " ".join([one] * 60), None), (2, " ".join([two] * 60), None), (3, " ".join([one] * 60), None)]
    found = {r.doc_id: r.n_removed for r in substring.remove_repeated_windows(frame(spark, rows), 50).collect()}
    assert found == {1: 0, 2: 0, 3: 60}
    assert {r.doc_id: r.component_id for r in jaccard.similar_groups(frame(spark, rows)).collect()} == {1: 1, 2: 2, 3: 1}


@pytest.mark.parametrize("seed,percent,batch_chars", [(2, 75, 400), (3, 60, 10**6)])
def test_groups(spark, seed, percent, batch_chars):
    rows = corpus(seed, 90)
    sets = []
    for _, text, _ in rows:
        w = WORD.findall(lower(text))
        sets.append({tuple(w[p:p + 2]) for p in range(len(w) - 1)} if len(w) >= 2 else {tuple(w)} if w else set())
    group = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    lows = {}
    for (i, _, _), g in zip(rows, group):
        lows.setdefault(g, []).append(i)
    want = []
    for (i, _, _), s, g in zip(rows, sets, group):
        known = [x for x in lows[g] if x is not None]
        want.append((i, len(s), (min(known) if known else None) if s else i))
    found = jaccard.similar_groups(frame(spark, rows), 2, percent, batch_chars).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in found), key=str) == sorted(want, key=str)


def test_components(spark):
    chain = [(i, i + 1) for i in range(0, 40)] + [(100, 102), (101, 102), (205, 200)]
    random.Random(4).shuffle(chain)
    found = {r.id: r.root for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert found == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 102: 100, 200: 200, 205: 200}


def test_contamination(spark):
    rows = corpus(5) + [(900, "one of A-B c d", "h1"), (901, "the SHORT one", "h1")]
    pick = lambda text: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))
    items = [(1, " ".join((rows[7][1] or "").split()[:9])), (2, "short, one"), (3, None), (4, "?!"), (5, "of a b C"), (5, rows[8][1]),
             (None, rows[9][1]), (6, "c"), (12, "c"), (7, " ".join((rows[-6][1] or "x").split()[10:60]))]
    want = []
    for i, text, _ in rows:
        w, hit, ids = pick(text), set(), set()
        for item, t in items:
            b = pick(t)
            k = min(len(b), 6)
            spans = {tuple(b[p:p + k]) for p in range(len(b) - k + 1)} if b else set()
            for p in range(len(w) - k + 1 if item is not None and spans else 0):
                if tuple(w[p:p + k]) in spans:
                    hit |= set(range(p, p + k))
                    ids.add(item)
        want.append((i, len(w), sorted(hit), sorted(ids), bool(hit)))
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("key", F.lit(1))
    found = winnow.contamination(frame(spark, rows), bench, window=6, gram=3).collect()
    assert sorted(((r.doc_id, r.n_words, list(r.hit_words), list(r.items), r.contaminated) for r in found), key=str) == sorted(want, key=str)


def test_contamination_without_broadcast(spark, monkeypatch):
    rows = corpus(6)
    bench = spark.createDataFrame([(1, rows[3][1]), (2, rows[6][1])], "item_id long, text string")
    key = lambda f: sorted((str(r.doc_id), tuple(r.hit_words), tuple(r["items"])) for r in f.collect())
    small = key(winnow.contamination(frame(spark, rows), bench, 4, 2))
    monkeypatch.setattr(winnow, "BROADCAST_BYTES", 0)
    assert key(winnow.contamination(frame(spark, rows), bench, 4, 2)) == small


@pytest.mark.parametrize("share,count", [(None, "documents"), (0.1, "texts"), (None, "texts"), (0.1, "documents")])
def test_quality_rules(spark, share, count):
    rows = corpus(7) + [(1000 + i, f"Common  Line {i % 10}\nown words of text {i} here\n", "h2") for i in range(30)] + [
        (2000 + i, f"common line {i % 10}\ncommon line 7", "h2") for i in range(10)] + [(3000, "x # y *\n\nx # y *\n$<>", "h1")]
    norm = lambda raw: re.sub(r"[\x20\x09-\x0D]+", " ", re.sub("[0-9]", "0", raw.strip(" \t\x0b\x0c\r").lower()))
    docs, sizes = {}, {}
    for i, text, source in rows:
        for raw in (text or "").split("\n"):
            if WORD.search(raw):
                unit = text if count == "texts" or i is None else i
                docs.setdefault((source or "", norm(raw)), set()).add(unit)
                sizes.setdefault(source or "", set()).add(unit)
    often = {k for k, v in docs.items() if len(v) > 5 and (share is None or len(v) > share * len(sizes[k[0]]))}
    assert ("h2", "common line 0") in often
    want = []
    for i, text, source in rows:
        w = WORD.findall(text or "")
        tri = [tuple(w[p:p + 3]) for p in range(len(w) - 2)]
        rep = {q for p, t in enumerate(tri) if tri.count(t) > 1 for q in range(p, p + 3)} if len(tri) < 1000 else None
        raws = [x for x in (text or "").split("\n") if WORD.search(x)]
        gone = sum(len(WORD.findall(x)) for x in raws if (source or "", norm(x)) in often)
        failed = None if rep is None else len(w) < 4 or 100 * len(rep) > 50 * len(w)
        want.append((i, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(raws) - len(set(raws)),
                     None if rep is None else len(rep), failed, len(w) - gone, None if rep is None else not failed and 100 * gone <= 50 * len(w)))
    found = [tuple(r[c] for c in ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "words_left", "kept"))
             for r in lines.quality_rules(frame(spark, rows), 4, 50, 5, share, 50, count).collect()]
    assert any(r[6] is False and r[8] is False for r in found)  # rejected for its lines alone
    blank = lambda r: r if r[1] < 1000 else (*r[:5], None, None, r[7], None)
    assert sorted(map(str, map(blank, found))) == sorted(map(str, want))


def test_lines_are_taken_out(spark):
    got = spark.createDataFrame([("a\nb\n\nc", [1, 3]), ("x", [0])], "t string, r array<int>").select(
        lines.without_lines(F.col("t"), F.col("r")).alias("t")).collect()
    assert [r.t for r in got] == ["a\n", ""]


@pytest.mark.parametrize("run", [
    lambda d, s: substring.remove_repeated_windows(d), lambda d, s: jaccard.similar_groups(d), lambda d, s: lines.quality_rules(d),
    lambda d, s: winnow.contamination(d, s.createDataFrame([(1, "a b")], "item_id long, text string")),
    lambda d, s: winnow.contamination(d, s.createDataFrame([], "item_id long, text string"))])
def test_empty_tables(spark, run):
    assert run(frame(spark, []), spark).count() == 0
