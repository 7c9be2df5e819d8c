"""Date expressions of the reporting calendar."""

from pyspark.sql import Column, functions as F

# Formats of the period labels.
MONTH_FORMAT = "MMM-yyyy"
YTD_PREFIX = "YTD "


def month_start(date: Column) -> Column:
    """First day of the month, as DATE, also from a timestamp."""
    return F.trunc(date, "month")


def year_start(date: Column) -> Column:
    """1 January of the same year."""
    return F.trunc(date, "year")


def shift_months(date: Column, months: int) -> Column:
    """``date`` moved by whole months, clamped to the end of a shorter month."""
    return F.add_months(date, months)


def shift_years(date: Column, years: int) -> Column:
    """``date`` moved by whole years; 29 February clamps to the 28th."""
    return F.add_months(date, 12 * years)


def month_label(date: Column) -> Column:
    """``Aug-2025``."""
    return F.date_format(date, MONTH_FORMAT)


def ytd_label(date: Column) -> Column:
    """``YTD 2025``."""
    return F.concat(F.lit(YTD_PREFIX), F.date_format(date, "yyyy"))
