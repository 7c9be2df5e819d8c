"""Ranks 1..n and leading rows of period counts, in one reproducible order."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tallytide.operators.calendar import PERIODS

# A ranking draws so many rows as a sample, and takes at most so many of them as cut points.
_SAMPLE = 1_024
_RANGES = 64


def _first_seen() -> Column:
    """Number of the first period a key occurs in."""
    first_seen = F
    for position, period in enumerate(PERIODS):
        first_seen = first_seen.when(F.col(f"count_{period}") > 0, position)
    return first_seen.otherwise(len(PERIODS))


def report_order(keys: Sequence[str]) -> list[Column]:
    """Current count descending; ties by the first period a key occurs in, then by keys.

    This is the order of a stable sort over the five period tables joined one after the
    other, each sorted by key. Keys are unique, so no two rows are equal.
    """
    return [
        F.desc("count_current"),
        _first_seen().asc(),
        *(F.asc_nulls_last(key) for key in keys),
    ]


def _ordered(keys: Sequence[str]) -> Column:
    """One value per row that compares in report order, smaller ones first."""
    parts = [-F.col("count_current"), _first_seen()]
    for key in keys:
        parts += [F.col(key).isNull(), F.col(key)]
    return F.struct(*(part.alias(f"_{place}") for place, part in enumerate(parts)))


def in_ranges(counts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``counts`` with ``_range``, the number of a row's range in report order.

    Cut points are taken from a sample of fixed size, the rows with the smallest hashes of their
    keys. They hold all columns of the order, so that any long run of equal counts is cut
    between its keys too.
    """
    value = _ordered(keys)
    sample = counts.select(value.alias("_value"), F.xxhash64(*keys).alias("_hash"))
    drawn = F.array_sort(F.collect_list("_value"))
    # Every step-th row of the sample, at most _RANGES of them.
    step = F.ceil(F.size("_drawn") / _RANGES).cast("int")
    cuts = (
        sample.orderBy("_hash", "_value")
        .limit(_SAMPLE)
        .agg(drawn.alias("_drawn"))
        .select(F.filter("_drawn", lambda _, place: place % step == step - 1).alias("_cuts"))
    )
    below = F.filter("_cuts", lambda cut: cut < value)
    return counts.crossJoin(F.broadcast(cuts)).withColumn("_range", F.size(below)).drop("_cuts")


def with_rank(counts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``counts``, one row per key, with a ``rank`` column in report order.

    A rank is the number of rows in earlier ranges, from a histogram of the ranges, plus the
    place in the own range. Nothing runs when this is called, and no step holds all keys in one
    task. The counts are aggregated once, as all uses of them share their exchange.
    """
    ranged = in_ranges(counts, keys)
    # One row per range.
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        ranged.groupBy("_range")
        .agg(F.count("*").alias("_size"))
        .select("_range", F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_before"))
    )
    inside = Window.partitionBy("_range").orderBy(*report_order(keys))
    return (
        ranged.withColumn("_inside", F.row_number().over(inside))
        .join(F.broadcast(offsets), "_range")
        .withColumn("rank", F.col("_before") + F.col("_inside"))
        .drop("_range", "_inside", "_before")
    )


def ranked_page(
    counts: DataFrame, keys: Sequence[str], number: int = 0, size: int = 100
) -> DataFrame:
    """One page of the ranked ``counts``, in rank order; pages count from 0.

    A top-n with an offset: each task hands on the rows up to the page's end, and no
    other row is ranked.
    """
    rows = counts.orderBy(*report_order(keys)).offset(number * size).limit(size)
    place = F.row_number().over(Window.orderBy(*report_order(keys)))
    return rows.withColumn("rank", (place + number * size).cast("bigint"))


def top_n(counts: DataFrame, keys: Sequence[str], n: int = 10) -> DataFrame:
    """The first ``n`` rows in report order, without a rank of the others.

    Every task hands on its first ``n`` rows. Up to
    ``spark.sql.execution.topKSortFallbackThreshold`` Spark keeps them in memory.
    """
    return counts.orderBy(*report_order(keys)).limit(n)
