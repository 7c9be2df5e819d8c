import datetime as dt
import random
from functools import reduce

import pytest
from conftest import rows_of
from pyspark.sql import functions as F

from tallytide.operators import (
    COUNTS,
    PERIODS,
    Calendar,
    as_of_date,
    combine_period_counts,
    monthly_counts,
    period_count,
    period_counts,
    reporting_calendar,
    rows_in_period,
)

KEYS = ("maker", "model", "fuel_grouped")


def joined_counts(facts, keys, calendar):
    """The five counts through full joins on null-safe keys."""

    def join(left, right):
        other = right.withColumnsRenamed({key: f"r_{key}" for key in keys})
        same = reduce(lambda a, b: a & b, (left[k].eqNullSafe(other[f"r_{k}"]) for k in keys))
        both = left.join(other, same, "full")
        # A key that is null on both sides stays null, so coalescing is enough.
        merged = {key: F.coalesce(F.col(key), F.col(f"r_{key}")) for key in keys}
        return both.withColumns(merged).drop(*(f"r_{key}" for key in keys))

    tables = [period_count(facts, keys, calendar, period) for period in PERIODS]
    return reduce(join, tables).fillna(0, COUNTS)


def random_rows(seed, n=400):
    rng = random.Random(seed)
    months = [f"{year}-{month:02d}" for year in (2023, 2024, 2025) for month in range(1, 13)]
    makers = ["A", "B", "b", "é", "", None]
    return [
        (
            rng.choice([*months, None]),
            rng.choice(makers),
            rng.choice(["x", "y", None]),
            rng.choice(["Petrol", "BEV"]),
        )
        for _ in range(n)
    ]


@pytest.mark.parametrize("as_of", ["2025-12-01", "2025-01-01", "2024-07-01", "2023-03-01"])
@pytest.mark.parametrize("keys", [("maker",), KEYS])
def test_one_pass_equals_joins_and_union(spark, facts, as_of, keys):
    table = facts(*random_rows(as_of))
    calendar = Calendar.at(spark, as_of)
    columns = (*keys, *COUNTS)
    one_pass = sorted(rows_of(period_counts(table, keys, calendar), *columns), key=repr)
    joined = sorted(rows_of(joined_counts(table, keys, calendar), *columns), key=repr)
    parts = [period_count(table, keys, calendar, period) for period in PERIODS]
    combined = sorted(rows_of(combine_period_counts(parts, keys), *columns), key=repr)
    assert one_pass == joined == combined
    for position, period in enumerate(PERIODS):
        total = sum(row[len(keys) + position] for row in one_pass)
        assert total == rows_in_period(table, calendar, period).count()


def test_counts_by_hand(spark, facts):
    table = facts(
        ("2025-03", "A"),
        ("2025-03", "A"),
        ("2025-03", None),
        ("2025-02", "B"),
        ("2024-03", "C"),
        ("2025-01", "D"),
        ("2024-01", "E"),
        ("2024-04", "F"),
        ("2023-03", "G"),
        (None, "A"),
    )
    counts = period_counts(table, ("maker",), Calendar.at(spark, "2025-03-01"))
    assert set(rows_of(counts, "maker", *COUNTS)) == {
        ("A", 2, 0, 0, 2, 0),
        (None, 1, 0, 0, 1, 0),
        ("B", 0, 1, 0, 1, 0),
        ("C", 0, 0, 1, 0, 1),
        ("D", 0, 0, 0, 1, 0),
        ("E", 0, 0, 0, 0, 1),
    }


def test_january_keeps_the_previous_month(spark, facts):
    table = facts(("2025-01", "A"), ("2024-12", "B"), ("2024-02", "C"), ("2024-01", "D"))
    counts = period_counts(table, ("maker",), Calendar.at(spark, "2025-01-01"))
    assert set(rows_of(counts, "maker", *COUNTS)) == {
        ("A", 1, 0, 0, 1, 0),
        ("B", 0, 1, 0, 0, 0),
        ("D", 0, 0, 1, 0, 1),
    }


def test_raw_dates_count_like_month_starts(spark):
    days = [dt.date(2023, 12, 1) + dt.timedelta(n) for n in range(800)]
    raw = spark.createDataFrame([(d, "A") for d in days], "date_reg date, maker string")
    floored = raw.withColumn("date_reg", F.trunc("date_reg", "month"))
    for as_of in ("2025-03-17", "2024-02-29", "2025-01-31"):
        calendar = Calendar.at(spark, as_of)
        assert rows_of(period_counts(raw, ("maker",), calendar), *COUNTS) == rows_of(
            period_counts(floored, ("maker",), calendar), *COUNTS
        )


def test_weighted_counts_equal_plain_ones(spark, facts):
    table = facts(*random_rows(11))
    cube = monthly_counts(table, KEYS)
    for keys in (("maker",), KEYS):
        calendar = Calendar.at(spark, "2025-01-01")
        plain = rows_of(period_counts(table, keys, calendar), *keys, *COUNTS)
        added = period_counts(cube, keys, calendar, "month", "registration")
        assert sorted(plain, key=repr) == sorted(rows_of(added, *keys, *COUNTS), key=repr)


def test_monthly_counts_keep_duplicates_and_leave_gaps(facts):
    table = facts(("2025-01", "A"), ("2025-01", "A"), ("2025-03", "A"), (None, "A"), ("2025-03",))
    series = monthly_counts(table, ("maker",))
    assert set(rows_of(series, "month", "maker", "registration")) == {
        (dt.date(2025, 1, 1), "A", 2),
        (dt.date(2025, 3, 1), "A", 1),
        (None, "A", 1),
        (dt.date(2025, 3, 1), None, 1),
    }


def test_as_of_ignores_and_counts_null_dates(facts):
    table = facts(("2025-01", "A"), (None, "A"), ("2024-03", "A"))
    assert rows_of(as_of_date(table), "as_of", "n_rows", "n_null_dates") == [
        (dt.date(2025, 1, 1), 3, 1)
    ]


def test_calendar_record(facts):
    row = reporting_calendar(facts(("2025-01", "A"), ("2024-06", "B"))).first()
    assert row.asDict() == {
        "month_current": dt.date(2025, 1, 1),
        "month_previous": dt.date(2024, 12, 1),
        "month_previous_year": dt.date(2024, 1, 1),
        "year_current": 2025,
        "ytd_current_start": dt.date(2025, 1, 1),
        "ytd_current_end": dt.date(2025, 1, 1),
        "ytd_previous_start": dt.date(2024, 1, 1),
        "ytd_previous_end": dt.date(2024, 1, 1),
        "label_current": "Jan-2025",
        "label_previous": "Dec-2024",
        "label_previous_year": "Jan-2024",
        "label_ytd_current": "YTD 2025",
        "label_ytd_previous": "YTD 2024",
    }
