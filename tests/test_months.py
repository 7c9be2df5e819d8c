"""Replacing months of a stored table, whole and broken off."""

import datetime as dt
import glob
import os

import pytest
from conftest import rows_of
from pyspark.sql import functions as F

from tallytide.sources import finish_replacing, months, read_curated, stored_months, write_curated


def stored(spark, path):
    return sorted(rows_of(read_curated(spark, path), "date_reg", "maker"), key=repr)


def files(path):
    found = sorted(glob.glob(f"{path}/date_reg=*/*.parquet"))
    return {name: os.stat(name).st_mtime_ns for name in found}


def rows(*pairs):
    dated = ((dt.date.fromisoformat(f"{m}-01") if m else None, maker) for m, maker in pairs)
    return sorted(dated, key=repr)


@pytest.fixture
def table(facts, tmp_path):
    path = str(tmp_path / "table")
    write_curated(facts(("2024-01", "A"), ("2024-02", "B"), ("2024-02", "C"), (None, "N")), path)
    return path


def test_other_months_keep_their_files(spark, facts, table):
    before = files(table)
    write_curated(facts(("2024-02", "X"), ("2024-03", "Y")), table, replace="months")
    after = files(table)
    kept = {name: time for name, time in before.items() if "2024-02" not in name}
    assert len(kept) == 2 and kept.items() <= after.items()
    expected = rows(("2024-01", "A"), ("2024-02", "X"), ("2024-03", "Y"), (None, "N"))
    assert stored(spark, table) == expected
    assert not glob.glob(f"{table}/_*")
    write_curated(facts((None, "M")), table, replace="months")
    assert stored(spark, table) == rows(*[(str(m)[:7], x) for m, x in expected if m], (None, "M"))
    write_curated(facts(), table, replace="months")
    assert len(stored(spark, table)) == 4


def test_the_whole_table_can_be_replaced(spark, facts, table):
    write_curated(facts(("2024-02", "X")), table)
    assert stored(spark, table) == rows(("2024-02", "X"))
    write_curated(facts(), table)
    assert stored(spark, table) == [] and stored_months(spark, table) == []
    with pytest.raises(ValueError, match="replace"):
        write_curated(facts(), table, replace="day")


@pytest.mark.parametrize("replace", ["table", "months"])
def test_a_job_that_fails_leaves_the_old_table(spark, facts, table, replace):
    before = files(table)
    bad = facts(("2024-02", "X"), ("2024-03", "Y")).withColumn(
        "maker", F.when(F.col("maker") == "Y", F.raise_error(F.lit("broken"))).otherwise(F.col("maker"))
    )
    with pytest.raises(Exception, match="broken"):
        write_curated(bad, table, replace=replace)
    assert files(table) == before and not glob.glob(f"{table}/_*")


class Broken(Exception):
    pass


@pytest.mark.parametrize("replace", ["table", "months"])
def test_a_break_between_any_two_moves_is_finished_later(spark, facts, tmp_path, monkeypatch, replace):
    old = facts(("2024-01", "A"), ("2024-02", "B"))
    new = facts(("2024-02", "X"), ("2024-03", "Y"))
    kept = [("2024-01", "A")] if replace == "months" else []
    expected = rows(*kept, ("2024-02", "X"), ("2024-03", "Y"))
    move, breaks = months._Files.move, 0
    for allowed in range(20):
        path = str(tmp_path / f"table{allowed}")
        write_curated(old, path)
        left = [allowed]

        def some(files, source, target):
            if not left[0]:
                raise Broken
            left[0] -= 1
            move(files, source, target)

        monkeypatch.setattr(months._Files, "move", some)
        try:
            write_curated(new, path, replace=replace)
        except Broken:
            breaks += 1
        else:
            break
        finally:
            monkeypatch.setattr(months._Files, "move", move)
        if not allowed:
            # The new rows never had their final name: nothing has happened.
            assert stored(spark, path) == rows(("2024-01", "A"), ("2024-02", "B"))
            continue
        finish_replacing(spark, path)
        finish_replacing(spark, path)
        assert stored(spark, path) == expected and not glob.glob(f"{path}/_*")
    assert breaks > 3 and stored(spark, path) == expected


def test_months_are_known_from_the_folders(spark, table):
    assert stored_months(spark, table) == [dt.date(2024, 1, 1), dt.date(2024, 2, 1), None]
    assert stored_months(spark, table + "_none") == []
