"""Quality rules: measures of a text on its own, and lines that too many documents of a host share.

All work is DataFrame expressions. Lines are hashed in normal form (trimmed, lower-cased, digits as 0, blanks as one); a host's
lines are counted over distinct documents (or distinct texts, so that copies of one text count once). A line goes when more
documents of its host have it than a fixed limit allows, however large the host is. Lines are split once, into a table of
hashes; counts shuffle one row per line occurrence at most, summed before the shuffle, and the join that finds the lines
again is an equi-join that Spark splits where a line is hot.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stackloom.llm.text import places, split_words
from stackloom.session import stored

BLANKS = " \t\x0b\x0c\r"


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _has_word(line: Column) -> Column:
    return F.length(F.btrim(line, F.lit(BLANKS))) > 0


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, host and text (null: empty), and a hash of the text; rows that agree in all get equal answers."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("host"),
                       text.alias("text"), F.xxhash64(text).alias("text_key"))


def text_measures(rows: DataFrame) -> DataFrame:
    """Per row: n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words.

    Repeated three-word windows are found by sorting one number per window, its hash in front and its place in the last bits.
    """
    words = rows.select("doc_id", "text_key", "host", "text", split_words(F.col("text")).alias("words"))
    hashed = words.select(
        "doc_id", "text_key", "host", F.size("words").alias("n"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        F.filter(_lines(F.col("text")), _has_word).alias("lines"),
        F.transform("words", lambda w: F.xxhash64(w)).alias("hashes"))
    bits = F.length(F.bin("n"))
    counted = hashed.select(
        "doc_id", "text_key", "host", "n", "word_chars", "n_symbols", bits.alias("bits"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.transform(places(F.col("n"), 3), lambda i: F.call_function(
            "shiftleft", F.xxhash64(F.col("hashes")[i], F.col("hashes")[i + 1], F.col("hashes")[i + 2]), bits)
            .bitwiseOR(i.cast("long"))).alias("packed"))
    ordered = counted.withColumn("packed", F.sort_array("packed"))
    top = lambda x: F.call_function("shiftright", x, F.col("bits"))
    last = F.size("packed") - 1
    repeated = ordered.withColumn("repeated", F.filter("packed", lambda x, i: (
        ((i > 0) & (top(x) == top(F.get("packed", i - 1)))) | ((i < last) & (top(x) == top(F.get("packed", i + 1)))))))
    mask = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bits")) - 1
    covered = F.array_distinct(F.flatten(F.transform("repeated", lambda x: F.array(
        x.bitwiseAND(mask), x.bitwiseAND(mask) + 1, x.bitwiseAND(mask) + 2))))
    return repeated.select("doc_id", "text_key", "host", F.col("n").cast("long").alias("n_words"), "word_chars", "n_symbols",
                           "n_dup_lines", F.size(covered).cast("long").alias("n_repeat_words"))


def line_occurrences(rows: DataFrame) -> DataFrame:
    """(doc_id, text_key, host, place, line, words) per line that has a word; ``line`` is the hash of its normal form."""
    lines = rows.select("doc_id", "text_key", "host", F.posexplode_outer(_lines(F.col("text"))).alias("place", "raw")).where(_has_word(F.col("raw")))
    normal = F.regexp_replace(F.lower(F.btrim(F.col("raw"), F.lit(BLANKS))), r"[0-9]", "0")
    return lines.select("doc_id", "text_key", "host", "place", F.xxhash64(F.regexp_replace(normal, r"[\x20\x09-\x0D]+", " ")).alias("line"),
                        F.size(split_words(F.col("raw"))).cast("long").alias("words"))


def frequent_lines(occurrences: DataFrame, most_documents: int, share: float | None = None, count: str = "documents") -> DataFrame:
    """(host, line, n_docs) of lines in more than ``most_documents`` distinct documents of the host.

    With ``share`` a line also has to be in more than that share of the host's documents. ``count`` is 'documents' (by doc_id; rows
    without one by their text) or 'texts'.
    """
    if count not in ("documents", "texts"):
        raise ValueError(f"count must be documents or texts, not {count!r}")
    text = F.col("text_key")
    unit = text if count == "texts" else F.struct(F.col("doc_id"), F.when(F.col("doc_id").isNull(), text))
    marked = occurrences.withColumn("unit", unit)
    counts = marked.groupBy("host", "line").agg(F.countDistinct("unit").alias("n_docs")).where(F.col("n_docs") > most_documents)
    if share is None:
        return counts
    sizes = marked.groupBy("host").agg(F.countDistinct("unit").alias("n_host"))
    return counts.join(sizes, "host").where(F.col("n_docs") > share * F.col("n_host")).select("host", "line", "n_docs")


def without_lines(text: Column, removed: Column) -> Column:
    """The text without the lines at the given places."""
    return F.array_join(F.filter(_lines(text), lambda line, i: ~F.array_contains(removed, i)), "\n")


def quality_rules(docs: DataFrame, least_words: int = 50, repeat_percent: int = 50, most_documents: int = 20,
                  share: float | None = None, depleted_percent: int = 50, count: str = "documents") -> DataFrame:
    """Per row of ``docs`` (doc_id, source, text): the measures, base_failed, removed_lines, words_left and kept.

    A row fails the base rules with fewer than ``least_words`` words, or more than ``repeat_percent`` of them in repeated
    three-word windows. Lines above the limit of ``frequent_lines`` are removed; the row is rejected if more than
    ``depleted_percent`` of its words go with them. Null text is empty, a null source is a host of its own. Rows that repeat a
    doc_id are judged one by one. ``removed_lines`` are 0-based places (null: none), see ``without_lines``. An empty table gives
    an empty result; other columns are ignored.
    """
    rows = _keyed(docs)
    occurrences = stored(line_occurrences(rows), "lines")
    hits = (occurrences.join(frequent_lines(occurrences, most_documents, share, count).select("host", "line"), ["host", "line"])
            .dropDuplicates(["doc_id", "text_key", "host", "place"]))
    removed = hits.groupBy("doc_id", "text_key", "host").agg(F.sum("words").alias("gone"), F.sort_array(F.collect_list("place")).alias("removed_lines"))
    m, r = text_measures(rows).alias("m"), removed.alias("r")
    same = F.col("m.doc_id").eqNullSafe(F.col("r.doc_id")) & (F.col("m.text_key") == F.col("r.text_key")) & (F.col("m.host") == F.col("r.host"))
    failed = (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > repeat_percent * F.col("n_words"))
    gone = F.coalesce("gone", F.lit(0))
    return m.join(r, same, "left").select(
        "m.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), "removed_lines",
        (F.col("n_words") - gone).alias("words_left"), (~failed & (100 * gone <= depleted_percent * F.col("n_words"))).alias("kept"))
