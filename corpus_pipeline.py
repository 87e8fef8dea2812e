"""From raw documents to packed training sequences: each stage works on all that the one before it kept.

Between stages the documents are Parquet tables in the shared folder. Stages that drop documents find their ids first and take
them out by an anti-join; the ids are broadcast while they are few (counted first) and joined by a shuffle beyond that.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stackloom.llm import jaccard, packing, pii, toxicity, winnow
from stackloom.llm.text import free_names
from stackloom.session import ship_package, stored

FEW_IDS = 1_000_000


def _without(docs: DataFrame, ids: DataFrame, column: str = "doc_id") -> DataFrame:
    """``docs`` without the rows whose ``column`` is in ``ids`` (null is in none)."""
    gone_id, = free_names(docs, "gone")
    gone = stored(ids.select(F.col(column).alias(gone_id)).distinct(), "gone")
    few = gone.count() <= FEW_IDS
    return docs.join(F.broadcast(gone) if few else gone, F.col(column) == F.col(gone_id), "left_anti")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model, learnt from the training fold of ``labels``, scores below 0.3."""
    ship_package(spark)
    train = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 != 2, F.lit(True))
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), train)
    return toxicity.below(docs, model, 0.3)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group that links of a similarity of 0.75 over five-word shingles form, the document with the smallest doc_id.

    Of rows that share that doc_id one stays, and a row without id stays only if no row of its group has one (then one of them).
    Rows without words are in no group; all of them stay. Where ids are null or repeat, rows get numbers of their own for this,
    in a written copy.
    """
    ship_package(spark)
    ids = docs.agg(F.count(F.lit(1)).alias("rows"), F.count("doc_id").alias("known"), F.countDistinct("doc_id").alias("distinct")).first()
    if ids["rows"] == ids["known"] == ids["distinct"]:
        groups = jaccard.similar_groups(docs, size=5, percent=75)
        return _without(docs, groups.where("component_id <> doc_id"))
    row, = free_names(docs, "row_number")
    numbered = stored(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    groups = jaccard.similar_groups(numbered.select(F.col(row).alias("doc_id"), "text"), size=5, percent=75).where("n_shingles > 0")
    place = numbered.select(F.col(row).alias("row"), F.col("doc_id").alias("named"))
    ordered = groups.join(place, groups["doc_id"] == place["row"]).select(
        "component_id", "row", F.struct(F.col("named").isNull().alias("unnamed"), "named", "row").alias("order"))
    # one row per group before the join back, so that a giant group costs a sum and no sort
    first = ordered.groupBy("component_id").agg(F.min("order").alias("best"))
    kept = first.select(F.col("best.row").alias(row))
    others = groups.select(F.col("doc_id").alias(row)).join(kept, row, "left_anti")
    return _without(numbered, others, row).drop(row)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no ten-word window with ``benchmark``."""
    found = winnow.contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), window=10, gram=5)
    return _without(docs, found.where("contaminated"))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind."""
    return pii.redact(docs, pii.personal_data(docs))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bins that hold every token of every document once."""
    ship_package(spark)
    return packing.packed(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("benchmark_decontamination", drop_contaminated),
    ("pii", redact_personal_data),
    ("best_fit_packing", pack_sequences),
]

#: Training a classifier, graph rounds and packing are not SQL; tests/llm checks the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
