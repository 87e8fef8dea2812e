"""Results that a cut of the work would change: one test per cut that was found and taken out."""

import math
import random
from collections import OrderedDict

from pyspark.sql import functions as F
from test_llm_models import katz_by_hand

from stackloom.llm import exchange, katz, language, pii


def spans_of(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    rows = pii.with_spans(docs, pii.personal_data(docs), []).collect()
    return {r.doc_id: [(s.kind, s.begin, s.end, s.by) for s in r.spans] for r in rows}


def test_addresses_with_zero_parts(spark):
    good = ["10.0.0.1", "192.168.0.1", "127.0.0.1", "0.0.0.0", "000.1.2.3", "00.00.00.00", "0255.010.0.09", "100.200.250.255", f"{'0' * 5000}.1.2.3"]
    bad = ["256.0.0.1", "0.0.0.256", "1.2.0300.4", "0999.0.0.0", "1.2.3", f"{'0' * 5000}999.1.2.3"]
    found = spans_of(spark, [f"at {a} now" for a in good + bad])
    for i, address in enumerate(good + bad):
        assert found[i] == ([("ip", 3, 3 + len(address), "format")] if address in good else []), address
    docs = spark.createDataFrame([(1, "from 10.0.0.1 to 0.0.0.0")], "doc_id long, text string")
    assert pii.redact(docs, pii.personal_data(docs)).first().text == "from [IP] to [IP]"


def test_small_language_beside_a_large_one(spark):
    rng = random.Random(4)
    made = lambda n: ["".join(rng.choice("abdeinorst") for _ in range(rng.randrange(2, 8))) for _ in range(n)]
    large, small = made(400), made(400)
    text = lambda words: " ".join(rng.choice(words) for _ in range(30))
    docs = [(i, text(large), "xx") for i in range(6000)] + [(6000 + i, text(small), "yy") for i in range(60)]
    rows = spark.createDataFrame(docs, "doc_id long, text string, lang string").repartition(4)
    model = language.fit(rows, F.col("doc_id") % 3 != 0, sample_rows=100)
    hits = [r.lang == r.lang_pred for r in language.identify(rows, model).join(rows.select("doc_id", "lang"), "doc_id").where("doc_id % 3 = 0").collect()]
    assert sum(hits) / len(hits) > 0.99
    assert {w for d in docs[6000:] if d[0] % 3 for w in d[1].split()} <= set(model.rows[0])


def test_rare_words_of_a_language_are_kept(spark):
    letters = "abcdefghijklmnop"
    many = ["".join(letters[i >> s & 15] for s in (12, 8, 4, 0)) for i in range(65536)]
    rows = spark.createDataFrame([(i, " ".join(many[i * 512:(i + 1) * 512] * 2), "xx") for i in range(128)] + [(200, "zyzzyva quokka", "yy")],
                                 "doc_id long, text string, lang string")
    model = language.fit(rows, F.lit(True))
    assert set(model.rows[0]) == {*many, "zyzzyva", "quokka"} and len(model.rows[4]) > 60_000
    assert model.predict("zyzzyva", OrderedDict())[0] == "yy" and model.predict("zyzzyvas", OrderedDict())[0] == "yy"


def test_katz_does_not_depend_on_buckets(spark, monkeypatch):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(60)]
    docs = [(i, " ".join(words[min(int(rng.expovariate(0.1)), 59)] for _ in range(rng.randrange(0, 60)))) for i in range(120)]
    docs += [(500, "never seen"), (501, None)]
    train = [i % 5 != 1 and i != 500 for i, _ in docs]
    rows = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    monkeypatch.setattr(exchange, "KEYS_PER_BUCKET", 60)
    monkeypatch.setattr(exchange, "LEAST_KEYS_SENT", 1)
    tokens, _, _, p = katz_by_hand(docs, train)
    want = {i: sum(math.log10(p(t, h)) for h, t in zip(["<s>", *w], w)) for (i, _), w in zip(docs, tokens)}
    for batch_chars in (10**6, 900, 40):  # 40: more batches than documents, so some are empty
        found = katz.score_texts(rows, (F.col("doc_id") % 5 != 1) & (F.col("doc_id") != 500), batch_chars=batch_chars).collect()
        assert {r.doc_id: round(r.score, 4) for r in found} == {i: round(x, 4) for i, x in want.items()}


def test_contexts_hold_neighbouring_matches(spark):
    texts = [f"words to reach me at {i % 9} u{i}@mail.example.com {i + 10} or write" for i in range(30)]
    texts += ["reach me at 7 joe(at)corp7 22 or write", "user Bob7 +49 30 1234567", "a1 b2 c3 d4"]
    found = spans_of(spark, texts)
    assert [(k, texts[30][a:b]) for k, a, b, by in found[30]] == [("email", "joe(at)corp7")]
    assert all([s[3] for s in found[i]] == ["format"] for i in range(30)) and not found[32]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(["1 " * 300, "é x@y.zz 5 é +49 30 1234567, ä2 " * 40, "+1-2" * 90, "q" * 300 + " 7 " + "é8" * 200 + " 9"])],
                                 "doc_id long, text string")
    for r in pii.occurrences(pii._keyed(docs)).join(docs, "doc_id").collect():
        text = r.text
        token = r.kind == "candidate"
        begin = max(text.rfind(" ", 0, r.begin) + 1, 0) if token else r.begin
        end = (text.find(" ", r.end) + len(text) + 1) % (len(text) + 1) if token else r.end
        assert r.left == text[max(begin - 100, 0):begin] and r.right == text[end:end + 100], (r.kind, r.begin, r.value)
