"""Monthly counts that are kept and brought up to date."""

import datetime as dt
import glob
import random

import pytest
from conftest import plan_of, rows_of
from pyspark.sql import functions as F

from tallytide.operators import Calendar, as_of_date, monthly_counts
from tallytide.plans import MODEL_KEYS, dashboard, kept_counts, kept_dashboard, update_counts
from tallytide.sources import read_curated, write_curated

MONTHS = ("2024-01", "2024-02", "2024-03", None)


def some(facts, seed, months=MONTHS, n=60):
    rng = random.Random(seed)
    return facts(
        *(
            (rng.choice(months), rng.choice("AB"), rng.choice(["x", None]), rng.choice(["BEV", "Petrol"]))
            for _ in range(n)
        )
    )


def same(spark, table, counts):
    expected = monthly_counts(read_curated(spark, table), MODEL_KEYS)
    found = kept_counts(spark, counts)
    assert found.columns == expected.columns
    assert sorted(rows_of(found, "*"), key=repr) == sorted(rows_of(expected, "*"), key=repr)


def test_only_changed_months_are_counted_again(spark, facts, tmp_path):
    table, counts = str(tmp_path / "table"), str(tmp_path / "counts")
    write_curated(some(facts, 1), table)
    assert len(update_counts(spark, table, counts)) == 4
    same(spark, table, counts)
    assert update_counts(spark, table, counts) == []
    before = set(glob.glob(f"{counts}/month=*/*.parquet"))
    write_curated(some(facts, 2, ("2024-02", "2024-04")), table, replace="months")
    # Broken files of other months show that these are not opened.
    for name in glob.glob(f"{table}/date_reg=2024-01-01/*.parquet"):
        kept = open(name, "rb").read()
        open(name, "wb").write(b"broken")
        assert update_counts(spark, table, counts) == [dt.date(2024, 2, 1), dt.date(2024, 4, 1)]
        open(name, "wb").write(kept)
        break
    after = set(glob.glob(f"{counts}/month=*/*.parquet"))
    assert {n for n in before if "2024-02" not in n} <= after
    same(spark, table, counts)
    write_curated(some(facts, 3, ("2024-02", None)), table)
    assert update_counts(spark, table, counts) == [dt.date(2024, 2, 1), None]
    same(spark, table, counts)
    write_curated(facts(), table)
    assert update_counts(spark, table, counts) == [] and kept_counts(spark, counts).count() == 0


def test_a_broken_update_is_made_up_for(spark, facts, tmp_path, monkeypatch):
    from tallytide.sources import months

    table, counts = str(tmp_path / "table"), str(tmp_path / "counts")
    write_curated(some(facts, 1), table)
    update_counts(spark, table, counts)
    write_curated(some(facts, 4, ("2024-02", "2024-03")), table, replace="months")
    move, left = months._Files.move, [2]

    def some_moves(files, source, target):
        left[0] -= 1
        if left[0] < 0:
            raise KeyboardInterrupt
        move(files, source, target)

    monkeypatch.setattr(months._Files, "move", some_moves)
    with pytest.raises(KeyboardInterrupt):
        update_counts(spark, table, counts)
    monkeypatch.setattr(months._Files, "move", move)
    assert update_counts(spark, table, counts) == []
    same(spark, table, counts)


def test_the_dashboard_of_kept_counts_is_that_of_the_facts(spark, facts, tmp_path):
    table, counts = str(tmp_path / "table"), str(tmp_path / "counts")
    write_curated(some(facts, 5), table)
    update_counts(spark, table, counts)
    kept, whole = kept_dashboard(spark, counts, n=2), dashboard(read_curated(spark, table), n=2)
    assert kept.calendar == whole.calendar
    for name in ("makes", "models", "fuels", "make_trend", "model_trend", "fuel_trend"):
        found, expected = getattr(kept, name), getattr(whole, name)
        assert sorted(rows_of(found, "*"), key=repr) == sorted(rows_of(expected, "*"), key=repr)
        assert "date_reg" not in plan_of(found)


def test_the_stored_calendar_is_the_latest_and_opens_no_file(spark, facts, tmp_path):
    table = str(tmp_path / "table")
    write_curated(some(facts, 6), table)
    rows = read_curated(spark, table)
    assert Calendar.stored(spark, table) == Calendar.latest(rows)
    assert Calendar.stored(spark, table).month_current == rows_of(as_of_date(rows), "as_of")[0][0]
    for name in glob.glob(f"{table}/*/*.parquet"):
        open(name, "wb").write(b"broken")
    assert Calendar.stored(spark, table).month_current == dt.date(2024, 3, 1)
    write_curated(facts((None, "A")), table)
    assert Calendar.stored(spark, table).month_current is None
    assert read_curated(spark, table).select(F.max("date_reg")).first()[0] is None
