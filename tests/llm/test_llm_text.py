"""Personal data, page text, packing, and the pipeline."""

import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_point
import corpus_pipeline
from stackloom.llm import html_text, packing, pii, toxicity
from stackloom.session import stored

FOLDER = "/root/testdata/sf0.001"
PLAIN = {  # the formats as they are defined, greedy and leftmost
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    return sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(map(int, digits[::-1]))) % 10 == 0


def by_hand(text):
    for kind, pattern in PLAIN.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")),
                    "card": 16 <= len(digits) <= 19 and luhn(digits), "phone": 8 <= len(digits) <= 15}[kind]:
                yield kind, m.start(), m.end()


def found_in(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumns(
        {c: F.lit("clash") for c in ("kind", "begin", "end", "value", "spans", "pattern", "instance", "s", "d", "m")}).repartition(3)
    rows = pii.with_spans(docs, pii.personal_data(docs), ["text"]).collect()
    assert len(rows) == len(texts)
    return {r.doc_id: [(s.kind, s.begin, s.end, s.by) for s in r.spans] for r in rows}


def test_formats(spark):
    rng = random.Random(9)
    parts = ["a@b.c", "x_", "@", ".", "é😀", "1.2.3.4", ".255", "256", " ", "-", "+", "+49", "(0)", "4111 1111 1111 1111", "4111111111111111", "5",
             "0", "00000000000000000000", "user.name+tag@mail-1.example.org", "\n", "+1 (456) 555-2186", "..", "378282246310005 ", "6011000990139424", "--"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 14))) for _ in range(400)]
    texts += [None, "", "a@" * 3000 + "b.c", "1." * 5000, "1 " * 4000, "x" * 50000 + "@", "a@b" + ".c" * 20000]
    found = found_in(spark, texts)
    for i, text in enumerate(texts):
        assert [f[:3] for f in found[i] if f[3] == "format"] == list(by_hand(text)), text


def test_contexts_discover_identifiers(spark):
    rng = random.Random(10)
    texts = [f"some words then reach me at u{i}@mail.example.com or write, text {rng.random():.3f} of {i}" for i in range(30)]
    texts += ["please reach me at joe(at)corp7 or write back", "reach me at \"bob42[at]corp\", or write", "only 7 apples at 5 prices", "model X100 is at hand"]
    texts += ["later joe(at)corp7 came, Room12 too"]
    found = found_in(spark, texts)
    spans = {texts[i][a:b] for i, rows in found.items() for kind, a, b, by in rows if by == "context" and kind == "email"}
    assert spans == {"joe(at)corp7", "bob42[at]corp"}
    assert [f[3] for f in found[34]] == ["context"]
    assert not found[32] and not found[33]


def test_redaction(spark):
    docs = spark.createDataFrame([(1, "é mail a@b.co, ip 1.2.3.4 end", 9, "x"), (2, None, None, "y"), (2, "clean", 5, "z"), (None, "+49 (30) 1234567", 1, None)],
                                 "doc_id long, text string, n_chars long, begin string")
    rows = sorted((str(r.doc_id), r.text, r.n_chars, r.begin) for r in pii.redact(docs, pii.personal_data(docs)).collect() if r.text)
    assert rows == [("1", "é mail [EMAIL], ip [IP] end", 27, "x"), ("2", "clean", 5, "z"), ("None", "[PHONE]", 7, None)]
    spans = spark.createDataFrame([(1, 0, 4, "ip"), (1, 2, 6, "card"), (1, 6, 8, "phone")], "doc_id long, begin long, end long, kind string")
    one = spark.createDataFrame([(1, "0123456789")], "doc_id long, text string")
    spans = spans.crossJoin(one.select(F.xxhash64("text").alias("text_key"))).withColumn("by", F.lit("format"))
    assert pii.redact(one, spans).first().text == "[IP][PHONE]89"


def test_empty_documents(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert pii.personal_data(empty).count() == 0 and packing.packed(empty).count() == 0


def test_pages():
    page = """<!doctype html><html><head><title>T</title><script>if (a<b) "</p>"</script></head><body>
    <header class="site-header"><a href="/">Home</a> <a href="/x">More</a></header><nav><ul><li><a href=1>One</a><li><a href=2>Two</a></ul></nav>
    <div id="cookie-notice">We use cookies to make this page better for you, accept all of them now please.</div>
    <article><h1>A title &amp; more</h1><p>First&nbsp;paragraph of <b>some <i>length</b></i>, with words enough to count&hellip;
      and more<br>words.<p>Ok.<p>A third paragraph that is not closed and has a <a href="q">link</a> inside of it.
      <!-- no --><ul><li>point one of the list</li><li>point two of the list</li></ul></article>
    <aside>Related stories that nobody asked for, in a long text that could be content.</aside>
    <div class="comments"><p>I wrote a comment here that is rather long and full of opinions of mine.</p></div>
    <form><label>Mail</label><input name=a><button>Send</button></form><footer>&copy; 2020 Somebody and others</footer></body></html>"""
    assert html_text.main_blocks(page) == [
        "A title & more", "First paragraph of some length, with words enough to count… and more words.", "Ok.",
        "A third paragraph that is not closed and has a link inside of it.", "point one of the list", "point two of the list"]
    for odd in ("", "<", "<p", "</p></p>", "<!-- x", "<script>", "<a href='", "&#x;&amp", "<p>" * 3000, "<b>" * 3000 + "x"):
        assert isinstance(html_text.main_blocks(odd), list)


PARAGRAPHS = [f"Paragraph {i} tells a long story in many words, so that nobody could take it for a menu or a notice of any kind." for i in range(4)]
BODY = "".join(f"<p>{p}</p>" for p in PARAGRAPHS)


@pytest.mark.parametrize("page,want", [
    (f'<nav><a href=1>Home</a></nav><article class="post category-search tag-copyright">{BODY}</article>', PARAGRAPHS),
    (f'<div class="login page-2"><div class="content">{BODY}</div></div><footer>Somebody</footer>', PARAGRAPHS),
    (f'<article>{BODY}</article><div id="discussion"><p>{PARAGRAPHS[0]} I disagree with that.</p><p>{PARAGRAPHS[1]} Me too.</p></div>', PARAGRAPHS),
    (f'<body class="sidebar-left search"><main class="widget">{BODY}</main><div class="sidebar"><p>Read this other text of ours too.</p></div></body>', PARAGRAPHS),
    (f'<div class="comments">{BODY}{BODY}</div><article><p>{PARAGRAPHS[0]}</p></article>', PARAGRAPHS[:1]),
])
def test_names_are_weak_evidence(page, want):
    assert html_text.main_blocks(page) == want


def test_costs_are_fitted(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").withColumn("y", F.lit("clash"))
    model = html_text.fit(pages)
    weight = dict(zip(html_text.FEATURES, model.weights))
    assert model != html_text.Model() and weight["links"] < 0 < weight["paragraph"] and weight["length"] > 0
    # without an element that says so, the fitted costs find the same text
    bare = f'<ul><li><a href=1>One</a><li><a href=2>Two</a><li><a href=3>Three</a></ul><section>{BODY}</section><table><tr><td><a href=4>Four</a></table>'
    assert html_text.main_blocks(bare, model) == PARAGRAPHS
    drawn = html_text.fit(pages, sample_pages=60)
    assert drawn.weights != model.weights and all(abs(a - b) < 2 for a, b in zip(drawn.weights, model.weights))
    nothing = spark.createDataFrame([("<p>x</p>",), (None,), ("",)], "html string")
    assert html_text.fit(nothing) == html_text.fit(nothing.limit(0)) == html_text.Model()


def test_cut_is_minimal():
    rng = random.Random(2)
    for _ in range(150):
        n = rng.randrange(1, 8)
        scores = [rng.randrange(-6, 7) / 2 for _ in range(n)]
        ties = [(a, b, rng.randrange(0, 5) / 2) for a, b in itertools.combinations(range(n), 2) if rng.random() < .5]
        price = lambda x: sum(max(s, 0) if not k else max(-s, 0) for s, k in zip(scores, x)) + sum(w for a, b, w in ties if x[a] != x[b])
        best = min(price(x) for x in itertools.product((False, True), repeat=n))
        assert abs(price(html_text.minimum_cut(scores, ties)) - best) < 1e-6


def test_page_table(spark):
    pages = spark.read.parquet(f"{FOLDER}/pages.parquet")
    rows = pages.select("page_id", "url", "html").unionByName(spark.createDataFrame([(None, None, None), (-1, "u", "")], "page_id long, url string, html string"))
    found = {(r.page_id, r.url): r.text for r in html_text.main_text(rows.withColumn("text", F.lit(1))).collect()}
    assert found[(None, None)] == found[(-1, "u")] == ""
    import html
    for r in pages.collect():
        inner = re.search(r"<article>(.*?)(</article>|$)", r.html, re.S)[1]
        parts = [" ".join(html.unescape(re.sub(r"<[^>]*>", " ", p)).split()) for p in re.split(r"</?(?:p|h1)>", inner)]
        assert found[(r.page_id, r.url)] == "\n".join(p for p in parts if p)


def test_packing(spark):
    rng = random.Random(3)
    lengths = [rng.choice([0, 1, 7, 8, 9, 15, 16, 17, 40]) for _ in range(300)]
    rows = [(i, " ".join("w" * n)) for i, n in enumerate(lengths)] + [(None, "a b"), (5, "q r s"), (400, None), (401, " ")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"n": F.lit(1), "shard": F.lit(2), "length": F.lit("x")}).repartition(3)
    bins = packing.packed(docs, (4, 8, 16), shard_tokens=500).collect()
    pieces = [(d, b, n) for r in bins for d, b, n in zip(r.doc_ids, r.begins, r.lengths)]
    tokens = sorted(((str(d), b + k) for d, b, n in pieces for k in range(n)))
    assert tokens == sorted((str(d), k) for d, t in rows for k in range(len((t or "").split())))
    for r in bins:
        assert r.used == sum(r.lengths) <= r.capacity == min(c for c in (4, 8, 16) if c >= r.used)
    assert sum(r.used for r in bins) / sum(r.capacity for r in bins) > 0.95


def test_best_fit_by_hand():
    assert packing.pack([6, 5, 3, 2], [8]) == [(8, [0, 3]), (8, [1, 2])]
    assert packing.pack([3], [4, 8, 16]) == [(4, [0])]
    assert packing.pack([], [4]) == [] and packing.pack([0, 0], [4]) == []
    lengths = [random.Random(7).randrange(1, 17) for _ in range(500)]
    bins = packing.pack(lengths, [8, 16])
    assert sorted(i for _, m in bins for i in m) == list(range(500)) and all(sum(lengths[i] for i in m) <= c for c, m in bins)


def test_pipeline_stages(spark):
    """Each stage on what the one before it kept, against the operator's own brute force."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    docs = docs.unionByName(spark.createDataFrame([(None, "a text without id", "en", "s", 17), (10**6, None, None, None, None), (10**6 + 1, "", "en", "s", 0)], docs.schema))
    columns, before = docs.columns, docs
    for name, stage in corpus_pipeline.STAGES:
        after = stored(stage(spark, before, FOLDER), f"test-{name}")
        old, new = before.collect(), after.collect()
        if name != "best_fit_packing":
            assert after.columns == columns
        if name == "toxicity":
            model = toxicity.fit(before, spark.read.parquet(f"{FOLDER}/labels.parquet"), F.crc32(F.col("doc_id").cast("string")) % 4 != 2)
            bad = [r for r in toxicity.score(before, model).collect() if r.score >= 0.3]
            assert len(new) == len(old) - len(bad)
        elif name == "ngram_jaccard_join":
            sets = {}
            for r in old:
                w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c < "\x7f" else c for c in r.text or ""))
                sets[r.doc_id] = {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) > 4 else {tuple(w)} if w else set()
            root = {i: i for i in sets}
            for a, b in itertools.combinations([i for i in sets if i is not None], 2):
                if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                    low, high = sorted((root[a], root[b]))
                    root = {k: low if v == high else v for k, v in root.items()}
            assert {r.doc_id for r in new} == {i for i, r in root.items() if i == r}
        elif name == "benchmark_decontamination":
            words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c < "\x7f" else c for c in t or ""))
            spans = {tuple(w[i:i + 10]) for w in map(words, (r.text for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()))
                     for i in range(len(w) - 9)}
            clean = {r.doc_id for r in old if not any(tuple(w[i:i + 10]) in spans for w in [words(r.text)] for i in range(len(w) - 9))}
            assert {r.doc_id for r in new} == clean
        elif name == "pii":
            texts = {r.doc_id: r.text for r in old}
            assert len(new) == len(old) and any(r.text != texts[r.doc_id] for r in new)
            assert all(not list(by_hand(r.text)) and r.n_chars == (None if r.text is None else len(r.text)) for r in new)
        else:
            total = sum(len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for r in old)
            assert sum(r.used for r in new) == sum(sum(r.lengths) for r in new) == total
        before = after


def test_pipeline_with_clashing_columns_and_repeated_rows(spark):
    long = "a b c d e f g h i j k l m n"
    rows = [(7, long), (7, long), (None, long), (9, long), (8, long + " o"), (None, "other words that stand alone in here"), (None, "other words that stand alone in here"),
            (3, ""), (3, ""), (None, None), (5, "ip 1.2.3.4 of mine and nothing else at all")]
    names = ["gone", "row_number", "span_doc", "span_text", "span_list", "text_key", "batch", "component_id"]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.withColumns({n: F.lit(n) for n in names}).repartition(3)
    columns, left = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, FOLDER), f"clash-{name}")
        left[name] = docs.collect()
        if name != "best_fit_packing":
            assert docs.columns == columns and all(r[n] == n for r in left[name] for n in names)
    assert len(left["toxicity"]) == 11
    kept = sorted(((r.doc_id, r.text) for r in left["ngram_jaccard_join"]), key=str)
    assert kept == sorted([(7, long), (None, "other words that stand alone in here"), (3, ""), (3, ""), (None, None), rows[-1]], key=str)
    assert "ip [IP] of mine and nothing else at all" in [r.text for r in left["pii"]]


@pytest.mark.parametrize("name", [n for n in entry_point.queries() if n.startswith("op")])
def test_contract_columns(spark, name):
    """Documents come back once each, with the columns that are asked for."""
    want = {
        "op1": ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"], "op2": ["doc_id", "n_words", "n_removed", "kept_sha256"],
        "op3": ["doc_id", "held_out", "score", "predicted"],
        "op4": ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
        "op5": ["doc_id", "held_out", "lang_pred", "score"], "op6": ["page_id", "url", "text", "n_chars"],
        "op7": ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
        "op8": ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"],
        "op11": ["doc_id", "held_out", "score", "predicted"], "op12": ["lang", "rank", "phrase", "a", "l", "r", "n", "score"],
        "op13": ["vec_id", "code", "error", "label_error", "codebooks_sha256"],
        "op10": ["doc_id", "n_shingles", "component_id"], "op9": ["bin_id", "capacity", "used", "doc_ids", "begins", "lengths"]}[name.split("_")[0]]
    frame = entry_point.queries()[name](spark, FOLDER)
    assert frame.columns[:len(want)] == want
    assert all(t in ("bigint", "string", "double", "boolean", "int") or "array" in t for _, t in frame.dtypes)
    if want[0] == "doc_id":
        assert sorted(r.doc_id for r in frame.collect()) == sorted(r.doc_id for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect())
