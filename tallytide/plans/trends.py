"""Monthly series, of all keys or of the leading ones."""

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from tallytide.functions.text import joined_label
from tallytide.operators.calendar import Calendar, resolve_calendar
from tallytide.operators.counts import monthly_counts, period_counts
from tallytide.operators.membership import attach_members
from tallytide.operators.ranking import top_n
from tallytide.plans.summary import MAKE_KEYS, MODEL_KEYS


def _leaders(
    facts: DataFrame,
    keys: Sequence[str],
    n: int,
    as_of: Calendar | dt.date | str | None,
    date: str,
    weight: str | None,
) -> DataFrame:
    """Keys of the first ``n`` rows of the summary."""
    calendar = resolve_calendar(facts, as_of, date)
    return top_n(period_counts(facts, keys, calendar, date, weight), keys, n).select(*keys)


def trend(
    facts: DataFrame,
    keys: Sequence[str],
    date: str = "date_reg",
    weight: str | None = None,
) -> DataFrame:
    """Registrations per month of every key."""
    return monthly_counts(facts, keys, date, weight)


def top_make_trend(
    facts: DataFrame,
    n: int = 10,
    as_of: Calendar | dt.date | str | None = None,
    date: str = "date_reg",
    weight: str | None = None,
) -> DataFrame:
    """Registrations per month of the ``n`` makes leading the current month.

    Months and makes are counted before they meet the leaders: a join that has to shuffle gets a
    row per month of a hot make, and not its rows.
    """
    # Each leader is there once. Spark would move a semi join below the counts again.
    leaders = _leaders(facts, MAKE_KEYS, n, as_of, date, weight)
    return attach_members(monthly_counts(facts, MAKE_KEYS, date, weight), leaders, MAKE_KEYS)


def top_model_trend(
    facts: DataFrame,
    n: int = 10,
    as_of: Calendar | dt.date | str | None = None,
    dedup: bool = False,
    date: str = "date_reg",
    weight: str | None = None,
) -> DataFrame:
    """Registrations per month of the models leading the current month.

    The leaders are the first ``n`` rows by make, model and fuel group, and the series is
    by make and model. A model leading with two fuel groups is on the list twice, and its
    counts double; ``dedup`` counts it once. Repeats are kept as a factor per model, so
    rows are never multiplied. As for makes, months are counted before they meet the leaders.
    """
    keys = ("maker", "model")
    repeats = F.lit(1) if dedup else F.count("*")
    leaders = (
        _leaders(facts, MODEL_KEYS, n, as_of, date, weight)
        .groupBy(*keys)
        .agg(repeats.cast("bigint").alias("_repeats"))
    )
    series = attach_members(monthly_counts(facts, keys, date, weight), leaders, keys)
    times = (F.col("registration") * F.col("_repeats")).alias("registration")
    label = joined_label(F.col("maker"), F.col("model")).alias("make_model")
    return series.select("month", *keys, times, label)
