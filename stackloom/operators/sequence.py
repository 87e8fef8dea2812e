"""Ordered work on long sequences, cut into time slices.

A window over a whole key puts every row of that key into one task, and one key may hold a third of
all rows. The operators here order rows only inside ``(key, slice)``. What a slice needs from earlier
ones is worked out on a small table with at most a few rows per slice and handed over as extra *seed*
rows at the head of the slice, so the large input is shuffled once, by ``(key, slice)``, and results
do not depend on the slice width.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stackloom.functions.values import floor_div
from stackloom.schema import SECOND_NS

HOUR_NS = 3600 * SECOND_NS


def with_slice(rows: DataFrame, order: str, width: int) -> DataFrame:
    return rows.withColumn("_slice", floor_div(F.col(order), width))


def _at_slice_heads(rows: DataFrame, keys: list[str], order: str, carry: list[str], ties: list[str]) -> DataFrame:
    """Sliced rows plus, ahead of each slice, the key's last row of its previous non-empty slice."""
    place = F.struct(order, *ties)
    last = rows.groupBy(*keys, "_slice").agg(
        F.max(order).alias("_last"), *[F.max_by(c, place).alias(f"_last_{c}") for c in carry])
    following = F.lead("_slice").over(Window.partitionBy(*keys).orderBy("_slice"))
    seeds = (last.withColumn("_slice", following).where("_slice IS NOT NULL")
             .select(*keys, "_slice", F.col("_last").alias(order),
                     *[F.col(f"_last_{c}").alias(c) for c in carry], F.lit(True).alias("_seed")))
    return rows.withColumn("_seed", F.lit(False)).unionByName(seeds, allowMissingColumns=True)


def _orderable(rows: DataFrame, columns: list[str]) -> list[str]:
    """Those of the columns that rows can be ordered by: maps have no order."""
    return [c for c in columns if "map" not in rows.schema[c].dataType.simpleString()]


def previous_values(
    rows: DataFrame, keys: list[str], order: str, columns: dict[str, str], width: int = HOUR_NS, tie: str | None = None
) -> DataFrame:
    """Values of the preceding row of the key: ``columns`` maps a column to the name of its predecessor.

    ``order`` is a numeric column. Where it is not unique within a key, ``tie`` names the column that decides; without it the
    values themselves do, so that a rerun gives the same answer.
    """
    carry = [c for c in columns if c != order]
    ties = [tie] if tie else _orderable(rows, carry)
    seeded = _at_slice_heads(with_slice(rows, order, width), keys, order, carry, ties)
    window = Window.partitionBy(*keys, "_slice").orderBy(F.col("_seed").desc(), order, *ties)
    out = seeded.select("*", *[F.lag(c).over(window).alias(alias) for c, alias in columns.items()])
    return out.where(~F.col("_seed")).drop("_seed", "_slice")


def asof_join(
    facts: DataFrame, dims: DataFrame, on: list[str], fact_time: str, dim_time: str, payload: list[str],
    ttl: int | None = None, width: int = HOUR_NS, tie: str | None = None, waiting: DataFrame | None = None,
) -> DataFrame:
    """Every fact with the latest dimension row of its key at or before its time (NULLs if none).

    With ``ttl`` a dimension row older than that does not count. Of rows of one key and time the one with the greatest ``tie``
    counts; without it the greatest payload (as far as it has an order). ``waiting`` holds the distinct keys and ``_slice`` of the facts,
    where the caller knows them; else the facts are read for them. The facts are shuffled once, by key and
    slice; seed rows bring the dimension row in force at the start of a slice.
    """
    clash = set(facts.columns) & set(payload)
    if clash:
        raise ValueError(f"facts already have columns {sorted(clash)}")
    facts = with_slice(facts, fact_time, width)
    carried = list(dict.fromkeys([dim_time, *payload, *([tie] if tie else [])]))
    dims = with_slice(dims.select(*dict.fromkeys([*on, *carried])), dim_time, width)
    value = F.struct(*[F.col(c) for c in carried])
    ties = [tie] if tie else _orderable(dims, [c for c in carried if c != dim_time])
    dim_rows = dims.select(*on, "_slice", F.col(dim_time).alias("_t"), F.lit(1).alias("_side"), value.alias("_dim"))

    # One row per key and slice: the last dimension row of the slice, and a mark where facts wait for one.
    place = F.struct("_t", *[F.col(f"_dim.{c}").alias(f"_{i}") for i, c in enumerate(ties)])
    last = dim_rows.groupBy(*on, "_slice").agg(F.max_by("_dim", place).alias("_dim"))
    waiting = (facts.select(*on, "_slice").distinct() if waiting is None else waiting).withColumn("_dim", F.lit(None).cast(last.schema["_dim"].dataType))
    steps = (last.withColumn("_side", F.lit(1))
             .unionByName(waiting.withColumn("_side", F.lit(0))))
    earlier = Window.partitionBy(*on).orderBy("_slice", "_side").rowsBetween(Window.unboundedPreceding, -1)
    seeds = (steps.withColumn("_carried", F.last("_dim", ignorenulls=True).over(earlier))
             .where((F.col("_side") == 0) & F.col("_carried").isNotNull())
             .select(*on, "_slice", F.col(f"_carried.{dim_time}").alias("_t"), F.lit(0).alias("_side"),
                     F.col("_carried").alias("_dim")))
    if ttl is not None:
        seeds = seeds.where(F.col("_t") + F.lit(ttl) >= F.col("_slice") * F.lit(width))

    fact_rows = facts.withColumn("_t", F.col(fact_time)).withColumn("_side", F.lit(2))
    rows = (fact_rows.unionByName(dim_rows, allowMissingColumns=True)
            .unionByName(seeds, allowMissingColumns=True))
    upto = (Window.partitionBy(*on, "_slice").orderBy("_t", "_side", *[F.col(f"_dim.{c}") for c in ties])
            .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    found = F.last("_dim", ignorenulls=True).over(upto)
    joined = rows.withColumn("_found", found).where(F.col("_side") == 2)
    if ttl is not None:
        fresh = F.col(fact_time) - F.col(f"_found.{dim_time}") <= F.lit(ttl)
        joined = joined.withColumn("_found", F.when(fresh, F.col("_found")))
    names = [c for c in facts.columns if c != "_slice"]
    return joined.select(*names, *[F.col(f"_found.{c}").alias(c) for c in payload])


def run_length_encode(
    rows: DataFrame, keys: list[str], order: str, value: str, width: int = HOUR_NS, tie: str | None = None
) -> DataFrame:
    """Runs of equal neighbouring values: ``keys, run_start, run_end, <value>, run_length``.

    NULLs next to each other form one run and never join a run of a value. Rows of one key and order come in order of ``tie``,
    or of the value without it.
    """
    ties = [tie] if tie else [value]
    sliced = with_slice(rows.select(*dict.fromkeys([*keys, order, value, *ties])), order, width)
    window = Window.partitionBy(*keys, "_slice").orderBy(order, *ties)
    same = F.lag(order).over(window).isNotNull() & F.col(value).eqNullSafe(F.lag(value).over(window))
    # a run is named by the number of its first row in the slice
    marked = (sliced.withColumn("_start", F.when(~same, F.row_number().over(window)))
              .withColumn("_run", F.max("_start").over(window.rowsBetween(Window.unboundedPreceding, 0))))
    # Parts of runs per slice, still where the one shuffle of the rows has put them.
    inside = Window.partitionBy(*keys, "_slice")
    parts = marked.groupBy(*keys, "_slice", "_run").agg(
        F.min(order).alias("run_start"), F.max(order).alias("run_end"), F.count(F.lit(1)).alias("run_length"), F.first(value).alias(value))
    edge = (F.col("_run") == F.min("_run").over(inside)) | (F.col("_run") == F.max("_run").over(inside))
    parts = parts.withColumn("_edge", edge)
    whole = parts.where("NOT _edge").select(*keys, "run_start", "run_end", value, "run_length")
    # Only the first and the last part of a slice can go on in another slice: two rows per slice.
    line = Window.partitionBy(*keys).orderBy("_slice", "_run")
    goes_on = (F.lag("_slice").over(line) != F.col("_slice")) & F.col(value).eqNullSafe(F.lag(value).over(line))
    edges = (parts.where("_edge").withColumn("_new", F.when(goes_on, 0).otherwise(1))
             .withColumn("_number", F.sum("_new").over(line.rowsBetween(Window.unboundedPreceding, 0))))
    joined = edges.groupBy(*keys, "_number").agg(
        F.min("run_start").alias("run_start"), F.max("run_end").alias("run_end"), F.first(value).alias(value),
        F.sum("run_length").alias("run_length"))
    return whole.unionByName(joined.drop("_number"))


def thread_migrations(samples: DataFrame, keys: list[str], order: str = "ts_ns", width: int = HOUR_NS, tie: str | None = None) -> DataFrame:
    """Rows whose cpu differs from the preceding one of the same thread; rows of one time in order of ``tie``, else of cpu."""
    columns = list(dict.fromkeys([*keys, order, "cpu", *([tie] if tie else [])]))
    steps = previous_values(samples.select(*columns), keys, order, {"cpu": "previous_cpu"}, width, tie)
    return steps.where(F.col("previous_cpu").isNotNull() & (F.col("cpu") != F.col("previous_cpu"))).select(*keys, order, "cpu", "previous_cpu")


def clock_align(events: DataFrame, offsets: DataFrame, on: list[str], mono: str = "mono_ns", width: int = HOUR_NS
                ) -> DataFrame:
    """Monotonic to wall nanoseconds by the latest offset of the host (``mono_ns, offset_ns``)."""
    clock = offsets.select(*on, F.col(mono).alias("_clock"), "offset_ns")
    joined = asof_join(events, clock, on, mono, "_clock", ["offset_ns"], None, width)
    return joined.withColumn("ts_ns", F.col(mono) + F.col("offset_ns"))


def report_batches(samples: DataFrame, by: list[str], ts: str = "ts", interval: str = "5 seconds") -> DataFrame:
    """Rows per tumbling report interval."""
    return (samples.groupBy(*by, F.window(ts, interval).alias("w"))
            .agg(F.count(F.lit(1)).alias("rows"))
            .select(*by, F.col("w.start").alias("batch_start"), "rows"))


def bucket_of(key: list[Column], buckets: int) -> Column:
    """A repeatable bucket number in ``[0, buckets)`` from the values of ``key``."""
    digest = F.md5(F.concat_ws("|", *[k.cast("string") for k in key]))
    return F.pmod(F.conv(F.substring(digest, 1, 8), 16, 10).cast("long"), F.lit(buckets).cast("long"))


def probabilistic_gate(
    samples: DataFrame, threshold: int, interval_ns: int = 60 * SECOND_NS, seed: str = "0"
) -> DataFrame:
    """Keep a host's rows in the intervals for which its number in 0..99 lies below ``threshold``.

    The number follows from host, interval and seed, so a rerun or a retried task keeps the same rows.
    """
    if not 0 <= threshold <= 100:
        raise ValueError("threshold must lie in 0..100")
    if threshold == 100:
        return samples
    interval = floor_div(F.col("ts_ns"), interval_ns)
    return samples.where(bucket_of([F.col("node"), interval, F.lit(seed)], 100) < threshold)


def offcpu_sample(events: DataFrame, probability: float, key: list[str], origin: str = "off_cpu") -> DataFrame:
    """Keep off-CPU events with a probability, repeatably; other origins pass."""
    if not 0 <= probability <= 1:
        raise ValueError("probability must lie in 0..1")
    limit = int(probability * 2**32)
    chosen = bucket_of([F.col(k) for k in key], 2**32) < F.lit(limit)
    return events.where((F.col("origin") != origin) | chosen)
