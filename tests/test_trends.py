import datetime as dt
import random

import pytest
from conftest import rows_of

from tallytide.operators import attach_members, keep_members
from tallytide.plans import (
    FUEL_KEYS,
    MAKE_KEYS,
    MODEL_KEYS,
    dashboard,
    summary,
    top_make_trend,
    top_model_trend,
    trend,
)

MARCH, FEBRUARY = dt.date(2025, 3, 1), dt.date(2025, 2, 1)


@pytest.fixture
def leading(facts):
    """A x leads with two fuel groups; maker C is behind."""
    return facts(
        *[("2025-03", "A", "x", "Petrol")] * 3,
        *[("2025-03", "A", "x", "BEV")] * 2,
        *[("2025-03", None, "y", "BEV")] * 2,
        ("2025-02", "A", "x", "Petrol"),
        ("2025-02", "C", "z", "Petrol"),
        ("2025-02", None, "y", "Petrol"),
    )


@pytest.mark.parametrize("n", [2, 1001])
def test_make_trend_keeps_null_makers(leading, n):
    series = set(rows_of(top_make_trend(leading, n), "month", "maker", "registration"))
    expected = {(MARCH, "A", 5), (MARCH, None, 2), (FEBRUARY, "A", 1), (FEBRUARY, None, 1)}
    assert series == (expected if n == 2 else expected | {(FEBRUARY, "C", 1)})


@pytest.mark.parametrize("n", [3, 1001])
@pytest.mark.parametrize(("dedup", "factor"), [(False, 2), (True, 1)])
def test_model_trend_repeats_a_model_leading_twice(leading, n, dedup, factor):
    result = top_model_trend(leading, n, dedup=dedup)
    assert result.columns == ["month", "maker", "model", "registration", "make_model"]
    series = set(rows_of(result, "month", "make_model", "registration"))
    # In a long list every key leads: "NA y" with two groups, "C z" with one.
    null_factor = factor if n > 3 else 1
    expected = {
        (MARCH, "A x", 5 * factor),
        (FEBRUARY, "A x", factor),
        (MARCH, "NA y", 2 * null_factor),
        (FEBRUARY, "NA y", null_factor),
    }
    assert series == (expected if n == 3 else expected | {(FEBRUARY, "C z", 1)})


def test_members_join_nulls_and_repeat_rows(facts):
    table = facts(("2025-03", "A", "x"), ("2025-03", None, "x"), ("2025-03", "B", None))
    members = table.select("maker", "model").where("maker IS NULL OR maker = 'B'")
    twice = members.unionAll(members)
    keys = ("maker", "model")
    kept = sorted(rows_of(keep_members(table, twice, keys), *keys), key=repr)
    joined = sorted(rows_of(attach_members(table, twice, keys), *keys), key=repr)
    assert kept == [("B", None), (None, "x")]
    assert joined == [("B", None), ("B", None), (None, "x"), (None, "x")]


def test_trend_of_all_keys_adds_up(leading):
    series = rows_of(trend(leading, FUEL_KEYS), "registration")
    assert sum(n for (n,) in series) == leading.count()


def test_dashboard_equals_the_single_reports(facts):
    rng = random.Random(21)
    table = facts(
        *(
            (
                rng.choice([None, "2024-01", "2024-02", "2024-12", "2025-01", "2025-02"]),
                rng.choice(["A", "B", "C", None]),
                rng.choice(["x", "y", None]),
                rng.choice(["Petrol", "BEV"]),
            )
            for _ in range(500)
        )
    )
    for as_of in (None, "2025-01-01"):
        pages = dashboard(table, as_of, n=5)
        singles = {
            "makes": summary(table, MAKE_KEYS, as_of),
            "models": summary(table, MODEL_KEYS, as_of),
            "fuels": summary(table, FUEL_KEYS, as_of),
            "make_trend": top_make_trend(table, 5, as_of),
            "model_trend": top_model_trend(table, 5, as_of),
            "fuel_trend": trend(table, FUEL_KEYS),
        }
        for name, single in singles.items():
            page = getattr(pages, name)
            assert page.columns == single.columns
            assert sorted(rows_of(page, "*"), key=repr) == sorted(rows_of(single, "*"), key=repr)
    assert dashboard(table).calendar.month_current == dt.date(2025, 2, 1)
