import datetime as dt
import random
from decimal import ROUND_HALF_UP, Decimal

import pytest
from pyspark.sql import functions as F

from tallytide import functions as fn

D = dt.date


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def day(text):
    return F.lit(text).cast("date")


@pytest.mark.parametrize(
    ("column", "expected"),
    [
        (lambda: fn.month_start(day("2025-08-17")), D(2025, 8, 1)),
        (lambda: fn.month_start(F.lit("2025-08-17 23:59:59").cast("timestamp_ntz")), D(2025, 8, 1)),
        (lambda: fn.year_start(day("2025-08-17")), D(2025, 1, 1)),
        (lambda: fn.shift_months(day("2025-08-31"), -6), D(2025, 2, 28)),
        (lambda: fn.shift_months(day("2025-01-01"), -1), D(2024, 12, 1)),
        (lambda: fn.shift_months(day("2025-02-28"), -1), D(2025, 1, 28)),
        (lambda: fn.shift_years(day("2024-02-29"), -1), D(2023, 2, 28)),
        (lambda: fn.month_label(day("2025-08-01")), "Aug-2025"),
        (lambda: fn.ytd_label(day("2025-08-01")), "YTD 2025"),
    ],
)
def test_dates(spark, column, expected):
    assert one(spark, column()) == expected


@pytest.mark.parametrize(
    ("code", "group"),
    [
        ("petrol", "Petrol"),
        ("greendiesel", "Diesel"),
        ("diesel", "Diesel"),
        ("electric", "BEV"),
        ("hybrid_petrol", "Hybrid"),
        ("hybrid_diesel", "Hybrid"),
        ("Petrol", "Others"),
        ("hydrogen", "Others"),
        ("", "Others"),
        (None, "Others"),
    ],
)
def test_fuel_groups(spark, code, group):
    assert one(spark, fn.regroup(F.lit(code).cast("string"))) == group


def test_regroup_without_groups(spark):
    assert one(spark, fn.regroup(F.lit("a"), {}, "rest")) == "rest"


@pytest.mark.parametrize(
    ("maker", "expected"),
    [
        ("Perodua", "National"),
        ("Proton", "National"),
        ("proton", "Non-National"),
        ("Toyota", "Non-National"),
        (None, "Non-National"),
    ],
)
def test_maker_class(spark, maker, expected):
    assert one(spark, fn.maker_class(F.lit(maker).cast("string"))) == expected


@pytest.mark.parametrize(
    ("current", "earlier", "expected"),
    [(3, 2, 0.5), (0, 4, -1.0), (5, 0, None), (0, 0, None), (2, 3, 2 / 3 - 1)],
)
def test_growth(spark, current, earlier, expected):
    counts = [F.lit(n).cast("bigint") for n in (current, earlier)]
    assert one(spark, fn.growth(*counts)) == expected


@pytest.mark.parametrize(
    ("fraction", "text"),
    [
        (0.0, "0.0%"),
        (0.5, "50.0%"),
        (-1.0, "-100.0%"),
        (12.34567, "1,234.6%"),
        (1234567.0, "123,456,700.0%"),
        (0.0025, "0.3%"),
        (0.0075, "0.8%"),
        (-0.0025, "-0.3%"),
        (0.0015, "0.1%"),
        (-0.0001, "-0.0%"),
        (None, None),
    ],
)
def test_percent_text(spark, fraction, text):
    assert one(spark, fn.percent_text(F.lit(fraction).cast("double"))) == text


def test_percent_text_rounds_exact_values(spark):
    """Against decimal arithmetic on the exact doubles, with many values near a half."""
    rng = random.Random(4)
    fractions = [n / 400 for n in range(-2000, 2001)]
    fractions += [n / 2000 + rng.choice([-1, 0, 1]) * 1e-17 for n in range(-2000, 2000)]
    fractions += [rng.uniform(-1, 50) for _ in range(3000)]
    fractions += [a / b - 1 for a in range(0, 60) for b in range(1, 60)]
    texts = spark.createDataFrame([(f,) for f in fractions], "f double").select(
        "f", fn.percent_text(F.col("f")).alias("text")
    )
    for fraction, text in texts.collect():
        exact = Decimal(fraction * 100)
        assert text == f"{exact.quantize(Decimal('0.1'), ROUND_HALF_UP):,}%", fraction


@pytest.mark.parametrize(
    ("fraction", "band"),
    [(-0.2, "red"), (0.0, "red"), (1e-9, "green"), (3.0, "green"), (None, None)],
)
def test_growth_band(spark, fraction, band):
    assert one(spark, fn.growth_band(F.lit(fraction).cast("double"))) == band


def test_joined_label_spells_out_nulls(spark):
    null = F.lit(None).cast("string")
    assert one(spark, fn.joined_label(F.lit("Proton"), F.lit("X50"))) == "Proton X50"
    assert one(spark, fn.joined_label(null, F.lit("X50"))) == "NA X50"
    assert one(spark, fn.joined_label(null, null)) == "NA NA"
