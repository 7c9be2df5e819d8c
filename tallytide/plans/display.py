"""Display tables: labelled columns, percent text and colour bands."""

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from tallytide.functions.growth import growth_band, percent_text
from tallytide.operators.calendar import PERIODS, Calendar, resolve_calendar
from tallytide.plans.summary import summary, summary_page

# Headings of the columns that do not depend on the date.
HEADINGS = {
    "rank": "Rank",
    "maker": "Make",
    "model": "Model",
    "fuel_grouped": "Fuel Type",
    "growth_MoM": "Growth (MoM)",
    "growth_YoY": "Growth (YoY)",
    "growth_YTD": "Growth (YTD)",
}
GROWTHS = ("growth_MoM", "growth_YoY", "growth_YTD")


def display_labels(calendar: Calendar) -> dict[str, str]:
    """Heading of every summary column; those of the counts name their period."""
    if calendar.month_current is None:
        raise ValueError("a table without dates has no period labels")
    return HEADINGS | {f"count_{p}": getattr(calendar, f"label_{p}") for p in PERIODS}


def display(table: DataFrame, calendar: Calendar) -> DataFrame:
    """A summary under display headings.

    Each growth keeps its number and gets a percent text and a colour beside it.
    """
    labels = display_labels(calendar)
    columns = []
    for name in table.columns:
        label = labels.get(name, name)
        columns.append(F.col(name).alias(label))
        if name in GROWTHS:
            columns.append(percent_text(F.col(name)).alias(f"{label} text"))
            columns.append(growth_band(F.col(name)).alias(f"{label} color"))
    return table.select(*columns)


def display_report(
    facts: DataFrame,
    keys: Sequence[str],
    as_of: Calendar | dt.date | str | None = None,
    date: str = "date_reg",
    weight: str | None = None,
) -> DataFrame:
    """The summary of ``facts`` as a display table."""
    calendar = resolve_calendar(facts, as_of, date)
    return display(summary(facts, keys, calendar, date, weight), calendar)


def display_page(
    facts: DataFrame,
    keys: Sequence[str],
    number: int = 0,
    size: int = 100,
    as_of: Calendar | dt.date | str | None = None,
    date: str = "date_reg",
    weight: str | None = None,
) -> DataFrame:
    """One page of the display table; pages count from 0, and only its rows are ranked."""
    calendar = resolve_calendar(facts, as_of, date)
    return display(summary_page(facts, keys, number, size, calendar, date, weight), calendar)
