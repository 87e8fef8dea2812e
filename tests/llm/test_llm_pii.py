"""Secrets, contexts and the scores of the pattern graph."""

import math
import random

from pyspark.sql import functions as F

from stackloom.llm import pii
from stackloom.llm.queries import QUERIES


def found_in(spark, texts, **limits):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    rows = pii.with_spans(docs, pii.personal_data(docs, **limits), ["text"]).collect()
    return {r.doc_id: [(s.kind, r.text[s.begin:s.end], s.by) for s in r.spans] for r in rows}


def test_secrets_are_seeds_and_their_context_finds_more(spark):
    rng = random.Random(3)
    secret = lambda n=40: "".join(rng.choice("0123456789abcdef") for _ in range(n - 2)) + "a7"
    texts = [f'words {i} and token = "{secret()}" more' for i in range(8)] + [f"config api_key: {secret(24)}, next" for _ in range(3)]
    texts += ['then token = "short99" here', "PASSWORD='Xy7Zq1Wv9Kt3Mn5b'", "a token of 7 apples", "token = 1234567890123456", "sum = 12 and tokens: many",
              "monkey = 0123456789abcdef0123", "é token\t:\n" + secret(20)]
    found = found_in(spark, texts)
    for i in range(11):
        assert [f[0] for f in found[i] if f[2] == "seed"] == ["secret"], texts[i]
    assert found[11] == [("secret", "short99", "context")]  # no seed, but it stands where secrets stand
    assert found[12] == [("secret", "Xy7Zq1Wv9Kt3Mn5b", "seed")] and not found[13] and not found[15] and not found[16]
    assert ("card", "1234567890123456", "format") not in found[14] and [f[0] for f in found[17]] == ["secret"]


def test_scores_of_the_graph(spark):
    rng = random.Random(5)
    words = ["call", "me", "at", "id", "key", "price", "is", "for"]
    rows = []
    for i in range(400):
        kind = rng.choice(["email", "phone", "secret", "candidate", "candidate", "candidate"])
        value = f"v{rng.randrange(60)}" if kind == "candidate" else f"{kind}{rng.randrange(25)}"
        bias = words[:4] if kind == "email" else words[3:]
        rows.append((kind, value, f"{rng.choice(bias)} {rng.choice(bias)} ", f" {rng.choice(words[:3])} x"))
    found = spark.createDataFrame(rows, "kind string, value string, left string, right string").repartition(3)
    edges = {(r.kind, r.value, p) for r in found.withColumn("p", pii.patterns_of(F.col("left"), F.col("right"))).collect() for p in r.p}
    least_support, least_precision, least_confidence = 2.0, 0.15, 0.3
    total = {}
    for _, v, p in edges:
        total.setdefault(p, set()).add(v)
    known = {}
    for _ in range(3):
        support = {}
        for kind, v, p in edges:
            if kind != "candidate":
                support[p, kind] = support.get((p, kind), 0) + 1
            elif v in known:
                support[p, known[v][0]] = support.get((p, known[v][0]), 0) + known[v][1]
        trusted = {key: s / len(total[key[0]]) for key, s in support.items() if s >= least_support and s / len(total[key[0]]) >= least_precision}
        scores = {}
        for kind, v, p in edges:
            if kind == "candidate":
                for (q, k), precision in trusted.items():
                    if q == p:
                        scores.setdefault(v, {}).setdefault(k, []).append(precision)
        known = {}
        for v, by in scores.items():
            best = max((1 - math.prod(max(1 - x, 1e-9) for x in xs), k) for k, xs in by.items())
            if best[0] >= least_confidence:
                known[v] = (best[1], best[0])
    got = {r.instance: (r.kind, r.confidence) for r in pii.bootstrap(found, 3, least_support, least_precision, least_confidence).collect()}
    assert got.keys() == known.keys() and len(got) > 10
    assert all(got[v][0] == known[v][0] and math.isclose(got[v][1], known[v][1], abs_tol=1e-9) for v in got)


def test_all_secrets_of_the_tables(spark):
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    planted = docs.where(F.lower("text").rlike('token = "[0-9a-f]{40}"')).select("doc_id")
    marked = QUERIES["op1_pii"](spark, folder).where(F.col("spans").contains("secret:")).select("doc_id")
    assert planted.count() > 5 and planted.exceptAll(marked).count() == 0
    clean = pii.redact(docs, pii.personal_data(docs))
    assert clean.where(F.lower("text").rlike("[0-9a-f]{40}")).count() == 0


def test_redaction_of_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "ip 1.2.3.4", "a", "b", "c")], "doc_id long, text string, span_doc string, span_text string, span_list string")
    assert tuple(pii.redact(docs, pii.personal_data(docs)).first()) == (1, "ip [IP]", "a", "b", "c")
