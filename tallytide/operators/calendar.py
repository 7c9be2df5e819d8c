"""The reporting calendar: five periods anchored on one month."""

import datetime as dt
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tallytide.functions.dates import (
    month_label,
    month_start,
    shift_months,
    shift_years,
    year_start,
    ytd_label,
)
from tallytide.sources.months import stored_months

# The names of the periods, in the order that ties follow.
PERIODS = ("current", "previous", "previous_year", "ytd_current", "ytd_previous")


def calendar_columns(as_of: Column) -> list[Column]:
    """The whole record of the month of ``as_of``: months, range bounds, year and labels."""
    month = month_start(as_of)
    before, year_before = shift_months(month, -1), shift_months(month, -12)
    start, earlier_end = year_start(month), shift_years(month, -1)
    return [
        month.alias("month_current"),
        before.alias("month_previous"),
        year_before.alias("month_previous_year"),
        F.year(month).cast("bigint").alias("year_current"),
        start.alias("ytd_current_start"),
        month.alias("ytd_current_end"),
        shift_years(start, -1).alias("ytd_previous_start"),
        earlier_end.alias("ytd_previous_end"),
        month_label(month).alias("label_current"),
        month_label(before).alias("label_previous"),
        month_label(year_before).alias("label_previous_year"),
        ytd_label(month).alias("label_ytd_current"),
        ytd_label(earlier_end).alias("label_ytd_previous"),
    ]


@dataclass(frozen=True)
class Calendar:
    """The calendar record as values.

    Period bounds enter a query as literals and so reach the scan as partition or row-group
    filters, which bounds from a joined row cannot do. All dates are None, and no row lies
    in any period, when the data has no dates.
    """

    month_current: dt.date | None
    month_previous: dt.date | None
    month_previous_year: dt.date | None
    year_current: int | None
    ytd_current_start: dt.date | None
    ytd_current_end: dt.date | None
    ytd_previous_start: dt.date | None
    ytd_previous_end: dt.date | None
    label_current: str | None
    label_previous: str | None
    label_previous_year: str | None
    label_ytd_current: str | None
    label_ytd_previous: str | None

    @classmethod
    def at(cls, spark: SparkSession, as_of: dt.date | str | None) -> "Calendar":
        """Calendar of the month of a date or ISO string; without dates if there is none."""
        (row,) = spark.range(1).select(*calendar_columns(F.lit(as_of).cast("date"))).collect()
        return cls(**row.asDict())

    @classmethod
    def latest(cls, facts: DataFrame, date: str = "date_reg") -> "Calendar":
        """Calendar of the latest month, from one job that returns one row."""
        (row,) = reporting_calendar(facts, date).collect()
        return cls(**row.asDict())

    @classmethod
    def stored(cls, spark: SparkSession, path: str, date: str = "date_reg") -> "Calendar":
        """Calendar of the latest month of a table stored by ``date``, from its folders' names.

        No file is opened, while ``latest`` reads the footer of every one. Without a month
        all dates are None.
        """
        known = [month for month in stored_months(spark, path, date) if month is not None]
        return cls.at(spark, max(known, default=None))

    def contains(self, period: str, date: str) -> Column:
        """Whether the column ``date`` lies in the period.

        Bounds are half-open up to the first day after the last month. On dates floored
        to the month this equals comparing months, and it holds for raw dates as well.
        """
        first, last = {
            "current": (self.month_current, self.month_current),
            "previous": (self.month_previous, self.month_previous),
            "previous_year": (self.month_previous_year, self.month_previous_year),
            "ytd_current": (self.ytd_current_start, self.ytd_current_end),
            "ytd_previous": (self.ytd_previous_start, self.ytd_previous_end),
        }[period]
        if first is None:
            return F.lit(False)
        return F.expr(
            f"`{date}` >= DATE'{first}' AND `{date}` < add_months(DATE'{last}', 1)"
        )

    def contains_any(self, date: str) -> Column:
        """Whether the column ``date`` lies in any period.

        The current month and the same month a year ago are inside the year-to-date
        ranges; the previous month is not when the anchor is January.
        """
        outer = ("ytd_current", "ytd_previous", "previous")
        return reduce(or_, (self.contains(period, date) for period in outer))


def as_of_date(facts: DataFrame, date: str = "date_reg") -> DataFrame:
    """One row: the latest month ``as_of``, ``n_rows`` and ``n_null_dates``.

    Null dates are left out of the maximum and counted. On a table partitioned by
    ``date`` the scan reads no data columns.
    """
    return facts.agg(
        month_start(F.max(date)).alias("as_of"),
        F.count("*").alias("n_rows"),
        F.count_if(F.col(date).isNull()).alias("n_null_dates"),
    )


def reporting_calendar(facts: DataFrame, date: str = "date_reg") -> DataFrame:
    """One row with the calendar anchored on the latest month of ``facts``."""
    return as_of_date(facts, date).select(*calendar_columns(F.col("as_of")))


def resolve_calendar(
    facts: DataFrame, as_of: Calendar | dt.date | str | None, date: str = "date_reg"
) -> Calendar:
    """The calendar to report on.

    Without ``as_of`` the latest month counts as the current one, even if it is not over yet.
    """
    if as_of is None:
        return Calendar.latest(facts, date)
    if isinstance(as_of, Calendar):
        return as_of
    return Calendar.at(facts.sparkSession, as_of)
