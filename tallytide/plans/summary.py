"""Comparison summaries: five period counts, three growths and a rank per key."""

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame

from tallytide.operators.calendar import Calendar, resolve_calendar
from tallytide.operators.counts import period_counts, with_growth
from tallytide.operators.ranking import ranked_page, with_rank

MAKE_KEYS = ("maker",)
MODEL_KEYS = ("maker", "model", "fuel_grouped")
FUEL_KEYS = ("fuel_grouped",)

# Names and order of the measures.
MEASURES = (
    "count_current",
    "count_previous",
    "growth_MoM",
    "count_previous_year",
    "growth_YoY",
    "count_ytd_current",
    "count_ytd_previous",
    "growth_YTD",
)


def summary(
    facts: DataFrame,
    keys: Sequence[str],
    as_of: Calendar | dt.date | str | None = None,
    date: str = "date_reg",
    weight: str | None = None,
) -> DataFrame:
    """One ranked row per key that occurs in any of the five periods."""
    calendar = resolve_calendar(facts, as_of, date)
    counts = period_counts(facts, keys, calendar, date, weight)
    return with_growth(with_rank(counts, keys)).select("rank", *keys, *MEASURES)


def summary_page(
    facts: DataFrame,
    keys: Sequence[str],
    number: int = 0,
    size: int = 100,
    as_of: Calendar | dt.date | str | None = None,
    date: str = "date_reg",
    weight: str | None = None,
) -> DataFrame:
    """One page of the summary, in rank order, without a rank of the other keys."""
    calendar = resolve_calendar(facts, as_of, date)
    counts = period_counts(facts, keys, calendar, date, weight)
    rows = with_growth(ranked_page(counts, keys, number, size))
    return rows.select("rank", *keys, *MEASURES)
