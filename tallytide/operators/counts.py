"""Row counts per key: by period in one pass, and by month."""

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tallytide.functions.dates import month_start
from tallytide.functions.growth import growth
from tallytide.operators.calendar import PERIODS, Calendar
from tallytide.operators.combine import union_by_name

COUNTS = tuple(f"count_{period}" for period in PERIODS)


def rows_in_period(
    facts: DataFrame, calendar: Calendar, period: str, date: str = "date_reg"
) -> DataFrame:
    """Rows dated in one period."""
    return facts.where(calendar.contains(period, date))


def period_count(
    facts: DataFrame,
    keys: Sequence[str],
    calendar: Calendar,
    period: str,
    date: str = "date_reg",
    weight: str | None = None,
) -> DataFrame:
    """Registrations per key in one period, for the keys that occur in it."""
    rows = rows_in_period(facts, calendar, period, date)
    counted = F.count("*") if weight is None else F.sum(weight)
    return rows.groupBy(*keys).agg(counted.alias(f"count_{period}"))


def period_counts(
    facts: DataFrame,
    keys: Sequence[str],
    calendar: Calendar,
    date: str = "date_reg",
    weight: str | None = None,
) -> DataFrame:
    """The five period counts per key, zero where a key is absent from a period.

    One scan and one exchange: rows outside all periods are filtered out, and the counts
    are conditional aggregates, so each task first reduces a hot key to a single row.
    ``weight`` names a column holding how many registrations a row stands for; without
    it each row is one.
    """

    def counted(period: str) -> Column:
        inside = calendar.contains(period, date)
        if weight is None:
            return F.count_if(inside)
        return F.sum(F.when(inside, F.col(weight)).otherwise(0))

    return (
        facts.where(calendar.contains_any(date))
        .groupBy(*keys)
        .agg(*(counted(period).alias(f"count_{period}") for period in PERIODS))
    )


def combine_period_counts(counts: Iterable[DataFrame], keys: Sequence[str]) -> DataFrame:
    """Separate per-period count tables side by side, zero where a key is missing.

    A full outer join on keys that match null to null, written as a union and one
    aggregation, so that any number of tables takes a single exchange.
    """
    stacked = union_by_name(counts)
    names = [name for name in stacked.columns if name not in keys]
    return stacked.groupBy(*keys).agg(
        *(F.coalesce(F.sum(name), F.lit(0)).alias(name) for name in names)
    )


def with_growth(counts: DataFrame) -> DataFrame:
    """``counts`` with month-on-month, year-on-year and year-to-date growth."""
    return counts.withColumns(
        {
            "growth_MoM": growth(F.col("count_current"), F.col("count_previous")),
            "growth_YoY": growth(F.col("count_current"), F.col("count_previous_year")),
            "growth_YTD": growth(F.col("count_ytd_current"), F.col("count_ytd_previous")),
        }
    )


def monthly_counts(
    facts: DataFrame,
    keys: Sequence[str],
    date: str = "date_reg",
    weight: str | None = None,
) -> DataFrame:
    """Registrations per month and key over all history; empty months give no row."""
    counted = F.count("*") if weight is None else F.sum(weight)
    return facts.groupBy(month_start(F.col(date)).alias("month"), *keys).agg(
        counted.alias("registration")
    )
