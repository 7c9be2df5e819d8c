"""Rows that do not fit, types that do not fit, and headers of many files."""

import datetime as dt
import uuid

import pytest
from conftest import plan_of, rows_of
from pyspark.sql.types import IntegerType, StructField, StructType

from tallytide.__main__ import main
from tallytide.operators import union_by_name
from tallytide.plans import build_curated
from tallytide.sources import EXTRACT_SCHEMA, read_extracts, split_extracts
from tallytide.sources.extracts import headers

D = dt.date
HEADER = "date_reg,maker,model,fuel"


@pytest.fixture
def landed(tmp_path):
    def write(name, *lines):
        path = tmp_path / name
        path.parent.mkdir(exist_ok=True)
        path.write_text("\n".join(lines) + "\n" * bool(lines), encoding="utf-8")
        return str(path)

    return write


def test_every_row_is_accepted_or_rejected(spark, landed):
    paths = [
        landed(
            "a b.csv", HEADER,
            "2024-01-01,A,x,petrol", "05/01/2024,A,x,petrol", "2024-13-45,B,y,diesel",
            "2024-02-01,A,x,petrol,extra,more", 'NA,A,"x, ""y""",NA', "2024-02-01,C", ",,,", '"",D,,',
        ),
        landed("c.csv", "maker,date_reg,model,fuel,state", "A,2024-01-01,x,petrol,Johor", 'B,soon,"q""",,J'),
        landed("empty.csv"),
    ]
    good, bad = split_extracts(spark, paths)
    assert sorted(rows_of(good, "date_reg", "maker", "model", "fuel", "state"), key=repr) == sorted(
        [
            (D(2024, 1, 1), "A", "x", "petrol", None),
            (None, "A", 'x, "y"', None, None),
            (None, None, None, None, None),
            (None, "D", None, None, None),
            (D(2024, 1, 1), "A", "x", "petrol", "Johor"),
        ],
        key=repr,
    )
    found = sorted((f.rpartition("/")[2], text, reason) for f, text, reason in rows_of(bad, "*"))
    assert found == [
        ("a%20b.csv", "05/01/2024,A,x,petrol", "date_reg"),
        ("a%20b.csv", "2024-02-01,A,x,petrol,extra,more", "fields"),
        ("a%20b.csv", "2024-02-01,C", "fields"),
        ("a%20b.csv", "2024-13-45,B,y,diesel", "date_reg"),
        ("c.csv", 'B,soon,"q""",,J', "date_reg"),
    ]
    # Counting needs no column, and one column is not all of them: the split stays the same.
    assert (good.count(), bad.count(), good.select("maker").count()) == (5, 5, 5)
    assert good.count() + bad.count() == read_extracts(spark, paths).count()


def test_rejects_with_line_breaks_and_further_types(spark, landed):
    path = landed("a.csv", HEADER + ",n", '2024-01-05,A,"X', '50",petrol,7', '2024-01-05,"A', 'B",x,petrol,many')
    schema = StructType([*EXTRACT_SCHEMA, StructField("n", IntegerType())])
    good, bad = split_extracts(spark, [path], schema, multiline=True)
    assert rows_of(good, "model", "n") == [("X\n50", 7)]
    assert rows_of(bad, "text", "reason") == [('2024-01-05,"A\nB",x,petrol,many', "n")]


def test_nothing_landed(spark, landed):
    good, bad = split_extracts(spark, [landed("empty.csv")])
    assert good.schema == EXTRACT_SCHEMA and good.count() == bad.count() == 0
    assert read_extracts(spark, [landed("empty.csv")]).count() == 0
    with pytest.raises(ValueError, match="header"):
        split_extracts(spark, [landed("empty.csv")], header_lines=False)


def test_a_build_keeps_rejects_beside_the_table(spark, landed, tmp_path, capsys):
    path = landed("a.csv", HEADER, "2024-01-09,A,x,petrol", "soon,B,y,petrol", "2024-02-09,C")
    target, rejects = str(tmp_path / "t"), str(tmp_path / "r")
    table = build_curated(spark, [path], target, rejects=rejects)
    assert rows_of(table, "date_reg", "maker") == [(D(2024, 1, 1), "A")]
    assert sorted(rows_of(spark.read.parquet(rejects), "reason")) == [("date_reg",), ("fields",)]
    again = landed("b.csv", HEADER, "2024-02-01,D,x,petrol", "2024-02-09,E,x")
    main(["curate", target, again, "--months", "--header", HEADER, "--rejects", rejects])
    assert "1 rejected rows: fields" in capsys.readouterr().out
    assert sorted(rows_of(spark.read.parquet(target), "maker")) == [("A",), ("D",)]


def test_types_are_compared_before_rows_are_read(spark):
    a = spark.createDataFrame([("007", 1)], "code string, n int")
    b = spark.createDataFrame([(7, 2**40)], "code int, n bigint")
    with pytest.raises(TypeError, match="code is string, int"):
        union_by_name([a, b])
    both = union_by_name([a, b], on_conflict="text")
    assert both.dtypes == [("code", "string"), ("n", "bigint")]
    assert sorted(rows_of(both, "*")) == [("007", 1), ("7", 2**40)]
    with pytest.raises(ValueError, match="on_conflict"):
        union_by_name([a, b], on_conflict="guess")


def test_types_that_fit_are_widened_and_others_are_not(spark):
    def one(kind, value="1"):
        return spark.sql(f"SELECT CAST({value} AS {kind}) AS v")

    assert union_by_name([one("tinyint"), one("int"), one("smallint")]).dtypes == [("v", "int")]
    assert union_by_name([one("float"), one("double")]).dtypes == [("v", "double")]
    assert union_by_name([spark.sql("SELECT NULL AS v"), one("date", "NULL")]).dtypes == [("v", "date")]
    for pair in (("bigint", "double"), ("int", "string"), ("boolean", "int"), ("decimal(9,2)", "int")):
        with pytest.raises(TypeError, match="v is"):
            union_by_name([one(kind) for kind in pair])
    dates = union_by_name([one("date", "'2024-01-05'"), one("timestamp_ntz", "'2024-01-06'")], "text")
    assert sorted(rows_of(dates, "v")) == [("2024-01-05",), ("2024-01-06 00:00:00",)]


def jobs(spark, run):
    group = uuid.uuid4().hex
    spark.sparkContext.setJobGroup(group, group)
    result = run()
    found = len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    spark.sparkContext.setJobGroup("", "")
    return found, result


def test_headers_of_many_paths_take_as_many_jobs_as_of_few(spark, landed):
    paths = [
        landed(f"{n}.csv", HEADER if n % 2 else "maker,date_reg,fuel,model", f"x{n},2024-01-01,y,z")
        for n in range(200)
    ]
    found, rows = jobs(spark, lambda: read_extracts(spark, paths))
    # One looks at the files, one lists them, and one more lists each of the two headers' files.
    assert found <= 4
    assert plan_of(rows).count("Scan csv") == 2 * 2
    assert rows.count() == 200 and rows.where("maker LIKE 'x%'").count() == 100


def test_headers_as_they_stand_in_files(spark, landed, tmp_path):
    landed("d/1.csv", '"a ""b""", c ,,NA,"x', 'y",C', "row")
    landed("d/2.csv", '"a ""b""",c,"",NA,"x', 'y",C')
    landed("e f/1.csv", "﻿date_reg,maker\r", "row")
    names = headers(spark, [str(tmp_path / "d"), str(tmp_path / "e f" / "1.csv"), str(tmp_path / "e*")])
    assert names[str(tmp_path / "d")] == ('a "b"', "c1", "_c2", "_c3", "x\ny", "C5")
    assert names[str(tmp_path / "e f" / "1.csv")] == ("date_reg", "maker")
    landed("d/3.csv", "a,b")
    with pytest.raises(ValueError, match="CSV header does not conform"):
        headers(spark, [str(tmp_path / "d")])


def test_a_header_line_is_found_behind_long_rows(spark, landed):
    path = landed("long.csv", HEADER, *(f"2024-01-01,{'m' * 5000},x,petrol" for _ in range(3000)))
    assert read_extracts(spark, [path]).where("length(maker) = 5000").count() == 3000
