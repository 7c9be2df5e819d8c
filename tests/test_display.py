import pytest
from conftest import rows_of

from tallytide.operators import Calendar, filter_columns
from tallytide.plans import MAKE_KEYS, MODEL_KEYS, display_labels, display_report


@pytest.fixture
def table(facts):
    return facts(
        *[("2025-01", "Proton Holdings", "X50", "Petrol")] * 3,
        *[("2024-12", "Proton Holdings", "X50", "Petrol")] * 2,
        ("2025-01", "Tesla", "Model 3", "BEV"),
        *[("2024-01", "Tesla", "Model 3", "BEV")] * 2,
        ("2024-12", None, "Z", "Others"),
    )


def test_headings(table):
    forms = ("", " text", " color")
    growths = [f"Growth ({name}){form}" for name in ("MoM", "YoY", "YTD") for form in forms]
    assert display_report(table, MODEL_KEYS).columns == [
        "Rank", "Make", "Model", "Fuel Type", "Jan-2025", "Dec-2024", *growths[:3],
        "Jan-2024", *growths[3:6], "YTD 2025", "YTD 2024", *growths[6:],
    ]
    labels = display_labels(Calendar.at(table.sparkSession, "2024-02-10"))
    assert labels["count_previous"] == "Jan-2024" and labels["count_ytd_previous"] == "YTD 2023"


def test_texts_and_colors(table):
    shown = display_report(table, MAKE_KEYS).orderBy("Rank")
    columns = ("Make", "Growth (MoM)", "Growth (MoM) text", "Growth (MoM) color")
    assert rows_of(shown, *columns) == [
        ("Proton Holdings", 0.5, "50.0%", "green"),
        ("Tesla", None, None, None),
        (None, -1.0, "-100.0%", "red"),
    ]


@pytest.mark.parametrize(
    ("criteria", "ranks"),
    [
        ({}, [1, 2, 3]),
        ({"Make": "proton"}, [1]),
        ({"Make": "holdings PRO"}, [1]),
        ({"Make": '"holdings pro"'}, []),
        ({"Make": '"proton hold"'}, [1]),
        ({"Make": ""}, [1, 2, 3]),
        ({"Make": "."}, []),
        ({"Jan-2025": (1, 3)}, [1, 2]),
        ({"Jan-2025": (2, None), "Make": "t"}, [1]),
        ({"Jan-2025": (None, 0)}, [3]),
        ({"Growth (MoM)": (-1.0, 0.5)}, [1, 3]),
        ({"Growth (YoY)": (None, 0)}, [2]),
    ],
)
def test_column_filters_keep_ranks(table, criteria, ranks):
    shown = filter_columns(display_report(table, MAKE_KEYS), criteria)
    assert [rank for (rank,) in sorted(rows_of(shown, "Rank"))] == ranks


def test_no_dates_no_labels(facts):
    with pytest.raises(ValueError, match="no period labels"):
        display_report(facts((None, "A")), MAKE_KEYS)
