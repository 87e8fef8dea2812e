"""One registered query per operator of this subpackage, over its whole table, and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stackloom.llm import codes, collocations, html_text, jaccard, katz, language, lines, packing, pii, quality, substring, toxicity, winnow
from stackloom.session import ship_package

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(name: str, sql: str | None = None):
    def register(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship_package(spark)
            return fn(spark, sf_dir)
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return run
    return register


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@_query("op2_substring_dedup", r"""
    WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
    pos AS (SELECT doc_id, unnest(range(1, len(words) - 48)) AS p, words FROM w WHERE len(words) >= 50),
    win AS (SELECT doc_id, p, array_to_string(words[p:p + 49], ' ') AS s FROM pos),
    low AS (SELECT s, min(doc_id) AS first FROM win GROUP BY s),
    gone AS (SELECT DISTINCT doc_id, unnest(range(p, p + 50)) AS i FROM win JOIN low USING (s) WHERE first < doc_id),
    out AS (SELECT doc_id, list(i) AS i FROM gone GROUP BY doc_id)
    SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(len(out.i), 0) AS BIGINT) AS n_removed,
           sha256(CASE WHEN out.i IS NULL THEN array_to_string(words, ' ') ELSE array_to_string(
               list_transform(list_filter(range(1, len(words) + 1), lambda k: NOT list_contains(out.i, k)), lambda k: words[k]), ' ') END)
               AS kept_sha256
    FROM w LEFT JOIN out ON w.doc_id = out.doc_id""")
def _op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = substring.remove_repeated_windows(_table(spark, sf_dir, "documents"), window=50)
    return rows.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@_query("op10_ngram_jaccard_join", r"""
    WITH RECURSIVE w AS (
        SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                          '[^\x20\x09-\x0D]+') AS words FROM documents),
    pos AS (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 4, 1) + 1)) AS p FROM w WHERE len(words) > 0),
    sh AS (SELECT DISTINCT doc_id, array_to_string(words[p:p + 4], ' ') AS s FROM pos),
    n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
    common AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM sh x JOIN sh y ON x.s = y.s AND x.doc_id <> y.doc_id
               GROUP BY x.doc_id, y.doc_id),
    links AS (SELECT a, b FROM common JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 75 * (na.n + nb.n - c)),
    reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a)
    SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, r.low AS component_id
    FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN (SELECT a, min(b) AS low FROM reach GROUP BY a) r ON r.a = d.doc_id""")
def _op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similar_groups(_table(spark, sf_dir, "documents"), size=5, percent=75)


@_query("op8_quality_rules", r"""
    WITH w AS (SELECT doc_id, coalesce(source, '') AS host, coalesce(text, '') AS text,
                      regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
    occ AS (SELECT doc_id, host, text, unnest(string_split(text, chr(10))) AS raw FROM w),
    lines AS (SELECT doc_id, host, text, raw, len(regexp_extract_all(raw, '[^\x20\x09-\x0D]+')) AS k,
                     regexp_replace(regexp_replace(lower(trim(raw, chr(32) || chr(9) || chr(11) || chr(12) || chr(13))), '[0-9]', '0', 'g'),
                                    '[\x20\x09-\x0D]+', ' ', 'g') AS line
              FROM occ WHERE regexp_matches(raw, '[^\x20\x09-\x0D]')),
    dup AS (SELECT doc_id, count(*) - count(DISTINCT raw) AS n_dup_lines FROM lines GROUP BY doc_id),
    often AS (SELECT host, line FROM lines GROUP BY host, line HAVING count(DISTINCT doc_id) > 20),
    gone AS (SELECT doc_id, sum(k) AS gone, count(*) AS n FROM lines JOIN often USING (host, line) GROUP BY doc_id),
    tri AS (SELECT doc_id, p, array_to_string(words[p:p + 2], ' ') AS s
            FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS p FROM w WHERE len(words) > 2)),
    rep AS (SELECT doc_id, count(DISTINCT i) AS n FROM (SELECT doc_id, unnest(range(p, p + 3)) AS i FROM (
            SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, s) AS c FROM tri) WHERE c > 1) GROUP BY doc_id),
    base AS (SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
                    CAST(length(text) - length(translate(text, '#*$%&|<>', '')) AS BIGINT) AS n_symbols,
                    CAST(coalesce(dup.n_dup_lines, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words,
                    coalesce(gone.gone, 0) AS gone, coalesce(gone.n, 0) AS n_removed_lines
             FROM w LEFT JOIN dup USING (doc_id) LEFT JOIN rep USING (doc_id) LEFT JOIN gone USING (doc_id))
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, CAST(n_removed_lines AS BIGINT) AS n_removed_lines,
           CAST(n_words - gone AS BIGINT) AS words_left, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
           NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND 100 * gone <= 50 * n_words AS kept FROM base""")
def _op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lines.quality_rules(_table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
                       F.coalesce(F.size("removed_lines"), F.lit(0)).cast("long").alias("n_removed_lines"), "words_left")


@_query("op7_benchmark_decontamination", r"""
    WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                   '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
    b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
              '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark),
    bw AS (SELECT item_id, words, least(len(words), 10) AS k, unnest(range(1, greatest(len(words) - 9, 1) + 1)) AS p FROM b WHERE len(words) > 0),
    bs AS (SELECT DISTINCT item_id, k, array_to_string(words[p:p + k - 1], ' ') AS s FROM bw),
    dw AS (SELECT doc_id, words, k, unnest(range(1, len(words) - k + 2)) AS p FROM d, (SELECT DISTINCT k FROM bs) WHERE len(words) >= k),
    ds AS (SELECT doc_id, k, p, array_to_string(words[p:p + k - 1], ' ') AS s FROM dw),
    hit AS (SELECT ds.doc_id, ds.k, ds.p, bs.item_id FROM ds JOIN bs ON ds.k = bs.k AND ds.s = bs.s),
    n AS (SELECT doc_id, count(DISTINCT i) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + k)) AS i FROM hit) GROUP BY doc_id),
    it AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS items
           FROM hit GROUP BY doc_id)
    SELECT d.doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
           sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
    FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN it ON it.doc_id = d.doc_id""")
def _op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = winnow.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), window=10, gram=5)
    return rows.select("doc_id", "n_words", F.size("hit_words").cast("long").alias("n_hit"), F.size("items").cast("long").alias("n_items"),
                       F.sha2(F.array_join(F.array_sort(F.col("items").cast("array<string>")), ","), 256).alias("items_sha256"), "contaminated")


@_query("op1_pii")
def _op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    rows = pii.with_spans(docs, pii.personal_data(docs), [])
    spans = F.col("spans")
    base = F.filter(spans, lambda s: s["by"] == "format")
    written = lambda a: F.array_join(F.transform(a, lambda s: F.concat_ws(":", s["kind"], s["begin"], s["end"])), ",")
    count = lambda kind: F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    counts = [count(kind) for kind in pii.KINDS]
    return rows.select("doc_id", *counts, F.sha2(written(base), 256).alias("base_sha256"), written(spans).alias("spans"))


def _remainder(divisor: int):
    """crc32 of the doc_id as text modulo a divisor: the folds of the queries."""
    return F.crc32(F.col("doc_id").cast("string")) % divisor


@_query("op4_lm_scoring")
def _op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = katz.score_texts(_table(spark, sf_dir, "documents"), F.coalesce(_remainder(5) != 1, F.lit(True)))
    return rows.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


@_query("op9_best_fit_packing")
def _op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(_table(spark, sf_dir, "documents"))


@_query("op6_html_extraction")
def _op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.main_text(_table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


@_query("op5_language_id")
def _op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    found = language.identify(docs, language.fit(docs, F.coalesce(_remainder(4) != 2, F.lit(True))))
    return found.select("doc_id", F.coalesce(_remainder(4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")


@_query("op3_toxicity")
def _op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, _table(spark, sf_dir, "labels"), F.coalesce(_remainder(4) != 2, F.lit(True)))
    written = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["begin"], s["end"])), ",")
    return toxicity.score(docs, model).select("doc_id", F.coalesce(_remainder(4) == 2, F.lit(False)).alias("held_out"), "score",
                                              (F.col("score") >= 0.3).cast("int").alias("predicted"), written.alias("spans"))


@_query("op11_quality_classifier")
def _op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = quality.fit(docs, _table(spark, sf_dir, "labels"), F.coalesce(_remainder(5) != 0, F.lit(True)))
    return quality.score(docs, model).select("doc_id", F.coalesce(_remainder(5) == 0, F.lit(False)).alias("held_out"), "score",
                                             (F.col("score") >= 0.3).cast("int").alias("predicted"))


@_query("op12_phrase_collocation_mining", r"""
    WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text
               FROM documents),
    p AS (SELECT lang, unnest(regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]')) AS piece FROM d),
    w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS words FROM p),
    g AS (SELECT lang, k, words, unnest(range(1, len(words) - k + 2)) AS i FROM w, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE len(words) >= k),
    f AS (SELECT lang, k, array_to_string(words[i:i + k - 1], ' ') AS phrase, count(*) AS a FROM g GROUP BY lang, k, phrase),
    total AS (SELECT lang, sum(a) AS n FROM f WHERE k = 1 GROUP BY lang),
    c AS (SELECT lang, k, phrase, a, string_split(phrase, ' ') AS words FROM f WHERE k > 1 AND a >= 30),
    cut AS (SELECT lang, k, phrase, a, words, unnest(range(1, k)) AS o FROM c),
    parts AS (SELECT cut.lang, cut.k, cut.phrase, cut.a, o, x.a AS l, y.a AS r,
                     (2000000::HUGEINT * cut.a) // (x.a::HUGEINT + y.a) AS score
              FROM cut JOIN f x ON x.lang = cut.lang AND x.k = o AND x.phrase = array_to_string(words[1:o], ' ')
              JOIN f y ON y.lang = cut.lang AND y.k = cut.k - o AND y.phrase = array_to_string(words[o + 1:], ' ')),
    worst AS (SELECT * FROM parts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, o) = 1),
    inner_ AS (SELECT lang, k, a, words, unnest(range(2, k)) AS m FROM c),
    inside AS (SELECT lang, m, a, words, unnest(range(1, k - m + 2)) AS i FROM inner_),
    most AS (SELECT lang, array_to_string(words[i:i + m - 1], ' ') AS phrase, max(a) AS longer FROM inside GROUP BY ALL),
    alive AS (SELECT worst.* FROM worst LEFT JOIN most USING (lang, phrase) WHERE longer IS NULL OR 100::HUGEINT * longer < 80::HUGEINT * worst.a),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM alive)
    SELECT lang, rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score FROM ranked JOIN total USING (lang) WHERE rank <= 2000""")
def _op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(_table(spark, sf_dir, "documents"))


def _codes_sql(parts: int = 8, entries: int = 16, rounds: int = 6) -> str:
    """The rounds written out one after the other, on a row per vector, part and place."""
    steps = [f"""
    WITH kept AS (SELECT vec_id, label, embedding AS e, len(embedding) // {parts} AS width, row_number() OVER (ORDER BY vec_id) AS row
                  FROM embeddings WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    v AS (SELECT row, i // width AS part, i % width AS place, CAST(floor(4096 * CAST(e[i + 1] AS DOUBLE)) AS BIGINT) AS x
          FROM (SELECT row, e, width, unnest(range(0, {parts} * width)) AS i FROM kept)),
    c0 AS (SELECT part, row - 1 AS entry, place, x FROM v WHERE row <= {entries})"""]
    for r in range(rounds + 1):
        steps.append(f"""
    a{r} AS (SELECT row, part, min(d * {entries} + entry) AS best FROM (
        SELECT row, v.part, c.entry, sum((v.x - c.x) * (v.x - c.x)) AS d FROM v JOIN c{r} c ON c.part = v.part AND c.place = v.place
        GROUP BY row, v.part, c.entry) GROUP BY row, part)""")
        if r < rounds:
            steps.append(f"""
    c{r + 1} AS (SELECT c.part, c.entry, c.place, coalesce(u.x, c.x) AS x FROM c{r} c LEFT JOIN (
        SELECT v.part, best % {entries} AS entry, place, CAST((sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*) AS BIGINT) AS x
        FROM v JOIN a{r} USING (row, part) GROUP BY v.part, best % {entries}, place) u
        ON u.part = c.part AND u.entry = c.entry AND u.place = c.place)""")
    steps.append(f"""
    book AS (SELECT sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY part, entry, place)) AS h FROM c{rounds}),
    coded AS (SELECT row, string_agg(lpad(lower(to_hex(CAST(best % {entries} AS BIGINT))), 2, '0'), '' ORDER BY part) AS code,
                     CAST(sum(best // {entries}) AS BIGINT) AS error FROM a{rounds} GROUP BY row)
    SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, h AS codebooks_sha256
    FROM coded JOIN kept USING (row), book""")
    return ",".join(steps)


@_query("op13_vector_code_compression", _codes_sql())
def _op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.vector_codes(_table(spark, sf_dir, "embeddings")).drop("label")
