"""Personal data: fixed formats as seeds, and identifiers that share the contexts of the seeds.

Bootstrapped contextual extraction. Matches of the fixed formats are seed entities, and so are secrets: tokens of many different
characters that stand behind a key word and an equals sign or colon. The words and marks around them are lexical
patterns. Tokens that look like identifiers (a digit or an at sign in them) and match no format are candidates. Spark scores
the graph of patterns and instances in rounds: a pattern is trusted for a kind if enough of the instances it extracts are
known for that kind, an instance becomes known if the trusted patterns that extract it agree; what becomes known helps the
patterns of the next round. Occurrences of instances that became known are spans too.

All work is DataFrame expressions. Offsets come from the lengths of what stands between matches, summed in a window over the
matches of one text, and contexts from a bounded number of neighbours in that window, so a text with many matches costs a sort and nothing quadratic. Patterns and instances are summed before
every shuffle, whatever a hot pattern holds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stackloom.llm.text import free_names
from stackloom.session import stored

KINDS = ("email", "ip", "card", "phone")
SECRET = "secret"
#: The formats, written so that no position is tried twice: they match what the plain greedy forms match, leftmost first.
FORMATS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?+[0-9]){15,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
CANDIDATE = r"(?<![^\s\"'=<>])(?=[^\s\"'=<>0-9@]*+[0-9@])[^\s\"'=<>]++"
#: What a secret stands behind.
KEY_WORD = (r"(?i)(?:^|[^\p{L}])(?:token|secret|passw(?:or)?d|passphrase|pwd|credential|auth|(?:api|access|private|secret)[ _-]?key)s?[\"']?"
            r"\s*[:=]\s*[\"']?$")
SECRET_CHARS, SECRET_DISTINCT = 16, 8
#: A cheap test for each: without such a character there is no match.
NEEDS = {"email": "@", "ip": "[0-9]", "card": "[0-9]", "phone": r"\+", "candidate": "[0-9@]"}
OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
CONTEXT_CHARS = 100
#: A match and the gap beside it have two characters at least, so this many neighbours fill a context.
NEIGHBOURS = CONTEXT_CHARS // 2


def _luhn(digits: Column) -> Column:
    doubled = lambda c, i: F.when(i % 2 == 1, 2 * c - F.when(c > 4, 9).otherwise(0)).otherwise(c)
    total = F.aggregate(F.transform(F.split(F.reverse(digits), ""), lambda c, i: doubled(F.coalesce(c.try_cast("int"), F.lit(0)), i)),
                        F.lit(0), lambda a, b: a + b)
    return total % 10 == 0


def _valid(kind: Column, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    return (F.when(kind == "ip", value.rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$"))
            .when(kind == "card", F.length(digits).between(16, 19) & _luhn(digits))
            .when(kind == "phone", F.length(digits).between(8, 15)).otherwise(True))


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long"), text.alias("text"), F.xxhash64(text).alias("text_key"))


def occurrences(rows: DataFrame) -> DataFrame:
    """(doc_id, text_key, kind, value, begin, end, left, right) per valid match of a format and per candidate token.

    ``left`` and ``right`` are the 100 characters around a match, neighbouring matches among them.
    """
    text, none = F.col("text"), F.array().cast("array<struct<gap:int,value:string,left:string,right:string>>")

    def found(kind: str, pattern: str) -> Column:
        gaps, values = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), 0)
        zipped = F.arrays_zip(gaps.alias("gap"), values.alias("value"), F.slice(gaps, 2, F.greatest(F.size(gaps) - 1, F.lit(0))).alias("next"))
        rows_ = F.transform(F.filter(zipped, lambda z: z["value"].isNotNull()), lambda z: F.struct(
            F.length(z["gap"]).alias("gap"), z["value"].alias("value"), F.substring(z["gap"], -CONTEXT_CHARS, CONTEXT_CHARS).alias("left"),
            F.substring(z["next"], 1, CONTEXT_CHARS).alias("right")))
        return F.struct(F.lit(kind).alias("kind"), F.when(text.rlike(NEEDS[kind]), rows_).otherwise(none).alias("found"))

    kinds = [found(kind, pattern) for kind, pattern in (*FORMATS.items(), ("candidate", CANDIDATE))]
    each = (rows.where(text.rlike(r"[0-9@+]")).select("doc_id", "text_key", F.explode_outer(F.array(*kinds)).alias("k"))
            .select("doc_id", "text_key", "k.kind", F.posexplode_outer("k.found").alias("i", "m")).where("m is not null")
            .dropDuplicates(["doc_id", "text_key", "kind", "i"]))  # rows that repeat a document
    before = W.partitionBy("doc_id", "text_key", "kind").orderBy("i")
    end = F.sum(F.col("m.gap") + F.length("m.value")).over(before)
    # each match with the gap on its far side; one that reaches the limit alone hides what lies beyond it
    last, first = (lambda c: F.substring(c, -CONTEXT_CHARS, CONTEXT_CHARS)), (lambda c: F.substring(c, 1, CONTEXT_CHARS))
    earlier = F.collect_list(last(F.concat("m.left", "m.value"))).over(before.rowsBetween(-NEIGHBOURS, -1))
    later = F.collect_list(first(F.concat("m.value", "m.right"))).over(before.rowsBetween(1, NEIGHBOURS))
    placed = each.select("doc_id", "text_key", "kind", "m.value", (end - F.length("m.value")).alias("begin"), end.alias("end"),
                         last(F.concat(F.array_join(earlier, ""), "m.left")).alias("left"),
                         first(F.concat("m.right", F.array_join(later, ""))).alias("right"))
    bare = F.regexp_extract("value", r"^[(\[{<\"']*+(.*?)[)\]}>\"'.,;:!?]*$", 1)
    lead = F.length(F.regexp_extract("value", r"^[(\[{<\"']*+", 0))
    token = F.col("kind") == "candidate"
    mixed = bare.rlike("[0-9]") & bare.rlike("[A-Za-z]") & (F.size(F.array_distinct(F.split(bare, ""))) >= SECRET_DISTINCT)
    secret = token & (F.length(bare) >= SECRET_CHARS) & F.col("left").rlike(KEY_WORD) & mixed
    return placed.select(
        "doc_id", "text_key", F.when(secret, F.lit(SECRET)).otherwise(F.col("kind")).alias("kind"), F.when(token, bare).otherwise(F.col("value")).alias("value"),
        F.when(token, F.col("begin") + lead).otherwise(F.col("begin")).alias("begin"),
        F.when(token, F.col("begin") + lead + F.length(bare)).otherwise(F.col("end")).alias("end"), "left", "right",
    ).where((F.col("value") != "") & _valid(F.col("kind"), F.col("value")))


def _free(found: DataFrame) -> DataFrame:
    """Without the candidates and secrets that overlap a span of a format."""
    seed = F.col("kind").isin(*KINDS)
    order = W.partitionBy("doc_id", "text_key").orderBy("begin", "end")
    last = F.max(F.when(seed, F.col("end"))).over(order.rowsBetween(W.unboundedPreceding, -1))
    following = F.min(F.when(seed, F.col("begin"))).over(order.rowsBetween(1, W.unboundedFollowing))
    marked = found.withColumns({"last": last, "following": following})
    overlaps = F.coalesce(F.col("last") > F.col("begin"), F.lit(False)) | F.coalesce(F.col("following") < F.col("end"), F.lit(False))
    return marked.where(seed | ~overlaps).drop("last", "following")


def patterns_of(left: Column, right: Column) -> Column:
    """The lexical patterns of an occurrence: the two words before it, the words on either side, and a key with its marks before it."""
    plain = lambda c: F.regexp_replace(F.lower(c), "[0-9]", "0")
    # quotes and brackets around an occurrence are not words
    bare_left, bare_right = F.regexp_replace(plain(left), r"[\"'(\[{<]+$", ""), F.regexp_replace(plain(right), r"^[\"')\]}>.,;:!?]+", "")
    before, after = F.regexp_extract(bare_left, r"(\S*\s+)?(\S+)\s*$", 0), F.regexp_extract(bare_right, r"^\s*(\S+)", 1)
    last = F.regexp_extract(before, r"(\S+)\s*$", 1)
    two = F.regexp_replace(F.btrim(before), r"\s+", " ")
    key = F.regexp_replace(F.regexp_extract(plain(left), r"([\p{L}\p{N}_]++[^\p{L}\p{N}_]*+)$", 1), r"\s+", " ")
    return F.filter(F.array(F.when(two.contains(" "), F.concat(two, F.lit(" _"))), F.when(key.rlike("[=:]"), F.concat(F.lit("key "), key, F.lit("_"))),
                            F.when((last != "") & (after != ""), F.concat(last, F.lit(" _ "), after))), lambda p: p.isNotNull())


def bootstrap(found: DataFrame, rounds: int, least_support: float, least_precision: float, least_confidence: float) -> DataFrame:
    """(instance, kind, confidence) of the identifiers that trusted patterns discover.

    A pattern's support for a kind is the summed confidence of its distinct instances known for that kind (seeds: 1), its
    precision that sum over all its distinct instances; an instance's confidence is 1 - prod(1 - precision) over the patterns
    that reach both limits. Equal confidences go to the kind that comes first in the alphabet.
    """
    edges = stored(found.select("kind", F.lower("value").alias("instance"), F.explode_outer(patterns_of(F.col("left"), F.col("right"))).alias("pattern"))
                   .where("pattern is not null").distinct(), "edges")
    seeds = edges.where("kind <> 'candidate'").select("pattern", "instance", "kind", F.lit(1.0).alias("confidence"))
    unknown = edges.where("kind = 'candidate'").select("pattern", "instance")
    # a pattern without enough seeds may still gain support later, one with too many strangers is judged anew each round
    totals = edges.groupBy("pattern").agg(F.countDistinct("instance").alias("total")).where(F.col("total") >= least_support)
    known = None
    for _ in range(rounds):
        facts = seeds
        if known is not None:
            facts = facts.unionByName(unknown.join(known, "instance").select("pattern", "instance", "kind", "confidence"))
        trusted = (facts.groupBy("pattern", "kind").agg(F.sum("confidence").alias("support")).where(F.col("support") >= least_support)
                   .join(totals, "pattern").withColumn("precision", F.col("support") / F.col("total"))
                   .where(F.col("precision") >= least_precision).select("pattern", "kind", "precision"))
        doubt = F.sum(F.log(F.greatest(1 - F.col("precision"), F.lit(1e-9))))
        scored = (unknown.join(trusted, "pattern").groupBy("instance", "kind").agg((1 - F.exp(doubt)).alias("confidence"))
                  .where(F.col("confidence") >= least_confidence))
        best = scored.groupBy("instance").agg(F.max(F.struct("confidence", "kind")).alias("b"))
        known = stored(best.select("instance", "b.kind", "b.confidence"), "known")
    return known


def personal_data(docs: DataFrame, rounds: int = 3, least_support: float = 5, least_precision: float = 0.75,
                  least_confidence: float = 0.75) -> DataFrame:
    """(doc_id, text_key, kind, begin, end, by) per span of personal data; ``by`` is 'format', 'seed' (a secret) or 'context'.

    Offsets count code points, end exclusive. Formats match leftmost and without overlap within a kind; a match that fails its
    check (ip parts, card digits and Luhn, phone digits) is dropped and not tried again. Spans of secrets and by context never overlap
    those of a format. Null text is empty. ``text_key`` is xxhash64 of the text; rows that repeat both doc_id and text share spans.
    An empty table gives an empty result; columns other than doc_id and text are ignored.
    """
    found = stored(_free(occurrences(_keyed(docs))), "found")
    known = bootstrap(found, rounds, least_support, least_precision, least_confidence).withColumnRenamed("kind", "known_kind")
    by = F.when(F.col("kind") == SECRET, F.lit("seed")).otherwise(F.lit("format"))
    by_format = found.where("kind <> 'candidate'").select("doc_id", "text_key", "kind", "begin", "end", by.alias("by"))
    by_context = (found.where("kind = 'candidate'").withColumn("instance", F.lower("value")).join(known, "instance")
                  .select("doc_id", "text_key", F.col("known_kind").alias("kind"), "begin", "end", F.lit("context").alias("by")))
    return by_format.unionByName(by_context)


def with_spans(docs: DataFrame, spans: DataFrame, columns: list[str]) -> DataFrame:
    """``columns`` of ``docs``, with ``spans``: the array of its spans in order of kind and place."""
    place = F.array_position(F.array(*[F.lit(k) for k in (*KINDS, SECRET)]), F.col("kind"))
    lists = spans.groupBy("doc_id", "text_key").agg(
        F.sort_array(F.collect_list(F.struct(place.alias("order"), "begin", "end", "kind", "by"))).alias("spans")).alias("s")
    d = docs.withColumn("text_key", F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))).select("doc_id", "text_key", *columns).alias("d")
    same = F.col("d.doc_id").eqNullSafe(F.col("s.doc_id")) & (F.col("d.text_key") == F.col("s.text_key"))
    empty = F.array().cast("array<struct<order:long,begin:long,end:long,kind:string,by:string>>")
    return d.join(lists, same, "left").select("d.doc_id", *[F.col(f"d.{c}") for c in columns], F.coalesce("spans", empty).alias("spans"))


def redact(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """``docs`` with every span replaced by its kind in brackets; overlapping spans are one, named after the first.

    A column ``n_chars`` is counted anew. Other columns stay; null texts stay null.
    """
    order = W.partitionBy("doc_id", "text_key").orderBy("begin", F.col("end").desc(), "kind")
    before = F.max("end").over(order.rowsBetween(W.unboundedPreceding, -1))
    opened = spans.withColumn("new", F.when(F.col("begin") < before, 0).otherwise(1))
    numbered = opened.withColumn("number", F.sum("new").over(order))
    merged = numbered.groupBy("doc_id", "text_key", "number").agg(
        F.min("begin").alias("begin"), F.max("end").alias("end"), F.min_by("kind", F.struct("begin", -F.col("end"), "kind")).alias("kind"))
    doc, key, spans_of = free_names(docs, "span_doc", "span_text", "span_list")
    lists = merged.groupBy(F.col("doc_id").alias(doc), F.col("text_key").alias(key)).agg(
        F.sort_array(F.collect_list(F.struct("begin", "end", "kind"))).alias(spans_of))
    text, all_ = F.col("text"), F.col(spans_of)
    parts = F.transform(all_, lambda s, i: F.concat(
        F.substring(text, F.coalesce(F.get(all_, i - 1)["end"], F.lit(0)).cast("int") + 1,
                    (s["begin"] - F.coalesce(F.get(all_, i - 1)["end"], F.lit(0))).cast("int")),
        F.lit("["), F.upper(s["kind"]), F.lit("]")))
    tail = F.substring(text, F.element_at(all_, -1)["end"].cast("int") + 1, F.length(text))
    clean = F.when(all_.isNull(), text).otherwise(F.concat(F.array_join(parts, ""), tail))
    same = F.col("doc_id").eqNullSafe(F.col(doc)) & (F.xxhash64(F.coalesce(text.cast("string"), F.lit(""))) == F.col(key))
    joined = docs.join(lists, same, "left").withColumn("text", clean)
    if "n_chars" in docs.columns:
        joined = joined.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return joined.select(*docs.columns)
