"""Whole reports against a plain Python computation, on rows with many nulls and ties."""

import datetime as dt
import random
from collections import Counter

import pytest
from conftest import rows_of

from tallytide.plans import (
    FUEL_KEYS,
    MAKE_KEYS,
    MEASURES,
    MODEL_KEYS,
    summary,
    top_make_trend,
    top_model_trend,
    trend,
)

COLUMN = {"maker": 1, "model": 2, "fuel_grouped": 3}


def month(year, number):
    """First day of a month, with the number counted on from any year."""
    return dt.date(year + (number - 1) // 12, (number - 1) % 12 + 1, 1)


def periods_of(anchor):
    """The months of each period, in the order in which ties are broken."""
    year, number = anchor.year, anchor.month
    return [
        [anchor],
        [month(year, number - 1)],
        [month(year - 1, number)],
        [month(year, n) for n in range(1, number + 1)],
        [month(year - 1, n) for n in range(1, number + 1)],
    ]


def key_of(row, keys):
    return tuple(row[COLUMN[key]] for key in keys)


def summarised(rows, keys, anchor):
    """Summary rows in rank order."""
    counts = [
        Counter(key_of(row, keys) for row in rows if row[0] in months)
        for months in periods_of(anchor)
    ]
    nulls_last = [sorted(c, key=lambda k: [(v is None, v or "") for v in k]) for c in counts]
    joined = list(dict.fromkeys(key for table in nulls_last for key in table))
    joined.sort(key=lambda key: -counts[0][key])

    def growth(now, before):
        return now / before - 1 if before else None

    result = []
    for rank, key in enumerate(joined, 1):
        now, before, year_ago, ytd, ytd_ago = (c[key] for c in counts)
        measures = (
            now,
            before,
            growth(now, before),
            year_ago,
            growth(now, year_ago),
            ytd,
            ytd_ago,
            growth(ytd, ytd_ago),
        )
        result.append((rank, *key, *measures))
    return result


@pytest.fixture(params=range(4))
def case(request, facts):
    rng = random.Random(request.param)
    months = [None] + [month(2023, n) for n in range(1, rng.choice([20, 25, 30]))]
    makers = [None, "", "A", "B", "b", "Zé", *(f"m{i}" for i in range(rng.choice([0, 30])))]
    rows = [
        (
            rng.choice(months),
            rng.choice(makers),
            rng.choice([None, "x", "y"]),
            rng.choice(["Petrol", "BEV", "Others"]),
        )
        for _ in range(rng.choice([60, 900]))
    ]
    frame = facts(*((d.isoformat()[:7] if d else None, *rest) for d, *rest in rows))
    return rows, frame


@pytest.mark.parametrize("keys", [MAKE_KEYS, MODEL_KEYS, FUEL_KEYS])
def test_summary(case, keys):
    rows, frame = case
    latest = max(row[0] for row in rows if row[0])
    columns = ("rank", *keys, *MEASURES)
    for given, anchor in ((None, latest), ("2024-01-15", month(2024, 1))):
        found = sorted(rows_of(summary(frame, keys, given), *columns))
        assert found == summarised(rows, keys, anchor)


@pytest.mark.parametrize("anchor", [month(2024, 1), month(2023, 9)])
def test_trends(case, anchor):
    rows, frame = case
    makes = [row[1] for row in summarised(rows, MAKE_KEYS, anchor)[:5]]
    expected = Counter((row[0], row[1]) for row in rows if row[1] in makes)
    found = rows_of(top_make_trend(frame, 5, anchor), "month", "maker", "registration")
    assert dict(((m, k), n) for m, k, n in found) == expected

    leaders = Counter(row[1:3] for row in summarised(rows, MODEL_KEYS, anchor)[:10])
    for dedup in (False, True):
        expected = Counter()
        for row in rows:
            repeats = leaders[row[1:3]]
            if repeats:
                expected[row[:3]] += 1 if dedup else repeats
        series = top_model_trend(frame, 10, anchor, dedup)
        found = rows_of(series, "month", "maker", "model", "registration", "make_model")
        assert {row[:3]: row[3] for row in found} == expected
        assert all(row[4] == " ".join(v if v is not None else "NA" for v in row[1:3]) for row in found)

    expected = Counter((row[0], row[3]) for row in rows)
    found = rows_of(trend(frame, FUEL_KEYS), "month", "fuel_grouped", "registration")
    assert {row[:2]: row[2] for row in found} == expected
