import datetime as dt
import glob

import pytest
from conftest import plan_of, rows_of
from pyspark.sql import functions as F

from tallytide.operators import Calendar, as_of_date, period_counts, preview, union_by_name
from tallytide.plans import build_curated, curate, make_model_list, summary
from tallytide.sources import read_curated, read_extracts, write_csv, write_curated

D = dt.date


@pytest.fixture
def landed(tmp_path):
    def write(name, *lines):
        path = tmp_path / name
        path.write_text("\n".join(lines) + "\n", encoding="utf-8")
        return str(path)

    return write


def test_null_tokens_quotes_and_blanks(spark, landed):
    path = landed(
        "a.csv",
        "date_reg,maker,model,fuel",
        "2025-01-15,Proton,X50,petrol",
        "2025-01-16,NA,,diesel",
        '2025-01-17,"NA","",electric',
        '2025-01-18,  Perodua , "A, ""B""" ,NA',
        "NA,Toyota,na,petrol",
        "",
    )
    assert rows_of(read_extracts(spark, [path]), "*") == [
        (D(2025, 1, 15), "Proton", "X50", "petrol"),
        (D(2025, 1, 16), None, None, "diesel"),
        (D(2025, 1, 17), None, None, "electric"),
        (D(2025, 1, 18), "Perodua", 'A, "B"', None),
        (None, "Toyota", "na", "petrol"),
    ]


def test_extracts_differ_in_columns_and_order(spark, landed):
    paths = [
        landed("2024.csv", "date_reg,maker,model,fuel", "2024-01-01,A,x,petrol"),
        landed("2025.csv", "fuel,state,date_reg,maker,model", "diesel,Johor,2025-01-01,B,y"),
        landed("2023.csv", "date_reg,maker,model,fuel", "2023-01-01,C,z,"),
    ]
    result = read_extracts(spark, paths)
    assert dict(result.dtypes)["date_reg"] == "date"
    assert sorted(rows_of(result, "date_reg", "maker", "model", "fuel", "state")) == [
        (D(2023, 1, 1), "C", "z", None, None),
        (D(2024, 1, 1), "A", "x", "petrol", None),
        (D(2025, 1, 1), "B", "y", "diesel", "Johor"),
    ]
    # Equal headers share a scan.
    assert plan_of(result).count("Scan csv") == 2 * 2


def test_malformed_rows_are_kept(spark, landed):
    """A bad date is null and is counted as such; short and long rows fit the header."""
    path = landed(
        "a.csv",
        "\ufeffdate_reg , maker,model,fuel\r",
        "2025-01-15,Citroën,C3,petrol\r",
        "2025-13-01,A,x,petrol",
        "soon,B,y,diesel,extra",
        "2025-02-01,C",
    )
    rows = read_extracts(spark, [path, landed("empty.csv", "date_reg,maker,model,fuel")])
    assert sorted(rows_of(rows, "date_reg", "maker", "model", "fuel"), key=repr) == [
        (None, "A", "x", "petrol"),
        (None, "B", "y", "diesel"),
        (D(2025, 1, 15), "Citroën", "C3", "petrol"),
        (D(2025, 2, 1), "C", None, None),
    ]
    assert rows_of(as_of_date(rows), "as_of", "n_rows", "n_null_dates") == [(D(2025, 2, 1), 4, 2)]


def test_another_header_inside_one_path_is_an_error(spark, tmp_path):
    (tmp_path / "x").mkdir()
    (tmp_path / "x" / "a.csv").write_text("date_reg,maker,model,fuel\n2024-01-01,A,x,petrol\n")
    (tmp_path / "x" / "b.csv").write_text("maker,date_reg,model,fuel\nB,2024-01-01,x,petrol\n")
    with pytest.raises(Exception, match="CSV header does not conform"):
        read_extracts(spark, [str(tmp_path / "x")]).collect()


def test_union_fills_missing_columns_and_keeps_duplicates(spark):
    a = spark.createDataFrame([("A", 1), ("A", 1)], "maker string, n int")
    b = spark.createDataFrame([("B",)], "maker string")
    rows = rows_of(union_by_name([a, b]), "maker", "n")
    assert sorted(rows) == [("A", 1), ("A", 1), ("B", None)]


def test_curated_table_from_extracts(spark, landed, tmp_path):
    paths = [
        landed(
            "2024.csv",
            "date_reg,maker,model,fuel",
            "2024-12-31,A,x,petrol",
            "2024-12-31,A,x,petrol",
            "NA,A,x,hydrogen",
        ),
        landed("2025.csv", "maker,model,fuel,date_reg,state", "B,y,,2025-01-02,Johor"),
    ]
    table = build_curated(spark, paths, str(tmp_path / "curated"))
    assert "state" in table.columns
    columns = ("date_reg", "maker", "model", "fuel", "fuel_grouped", "state")
    assert dict(table.dtypes)["date_reg"] == "date"
    assert sorted(rows_of(table, *columns), key=repr) == [
        (None, "A", "x", "hydrogen", "Others", None),
        (D(2024, 12, 1), "A", "x", "petrol", "Petrol", None),
        (D(2024, 12, 1), "A", "x", "petrol", "Petrol", None),
        (D(2025, 1, 1), "B", "y", None, "Others", "Johor"),
    ]
    assert rows_of(summary(table, ("maker",)).orderBy("rank"), "rank", "maker") == [
        (1, "B"),
        (2, "A"),
    ]
    assert len(rows_of(preview(table, 3), "*")) == 3


def test_csv_form_reads_back(spark, facts, tmp_path):
    table = facts(
        ("2025-01", None, 'a "b", c', "BEV"), ("2025-02", "A", " x", "Petrol"), (None, "A", "NAB")
    )
    write_csv(table, str(tmp_path / "csv"))
    text = "".join(open(path).read() for path in glob.glob(f"{tmp_path}/csv/*.csv"))
    assert '2025-01-01,NA,"a ""b"", c",NA,BEV' in text
    back = read_curated(spark, str(tmp_path / "csv"), "csv")
    assert back.schema == table.schema
    # Blanks around text do not survive, as extracts are trimmed.
    expected = [tuple(v.strip() if isinstance(v, str) else v for v in r) for r in table.collect()]
    assert sorted(rows_of(back, "*"), key=repr) == sorted(expected, key=repr)


def test_period_bounds_prune_the_curated_table(spark, facts, tmp_path):
    months = [f"{y}-{m:02d}" for y in (2022, 2023, 2024) for m in range(1, 13)]
    write_curated(facts(*((month, "A") for month in months)), str(tmp_path / "t"))
    table = read_curated(spark, str(tmp_path / "t"))
    counts = period_counts(table, ("maker",), Calendar.at(spark, "2024-03-01"))
    plan = plan_of(counts)
    assert "ReadSchema: struct<maker:string>" in plan
    filters = next(line for line in plan.splitlines() if "PartitionFilters" in line)
    assert "2024-01-01" in filters and "2024-04-01" in filters and "2023-04-01" in filters
    assert len(counts.inputFiles()) == len(months)
    read = counts.select(F.sum("count_ytd_current") + F.sum("count_ytd_previous")).first()[0]
    assert read == 6


def test_a_hot_month_is_split_over_files(spark, tmp_path):
    small = {
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64k",
        "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1k",
    }
    before = {name: spark.conf.get(name) for name in small}
    for name, value in small.items():
        spark.conf.set(name, value)
    try:
        # Month 1 holds nine tenths of the rows; months 2 to 12 share the rest.
        month = F.when(F.rand(1) < 0.9, 1).otherwise(2 + F.pmod("id", F.lit(11))).cast("int")
        rows = spark.range(0, 100_000, 1, 8).select(
            F.make_date(F.lit(2025), month, F.lit(1)).alias("date_reg"),
            F.concat(F.lit("m"), F.xxhash64("id")).alias("maker"),
            F.lit("x").alias("model"),
        )
        write_curated(rows, str(tmp_path / "hot"))
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
    hot = glob.glob(f"{tmp_path}/hot/date_reg=2025-01-01/*.parquet")
    cold = glob.glob(f"{tmp_path}/hot/date_reg=2025-02-01/*.parquet")
    assert len(hot) > 4 and len(cold) == 1
    assert read_curated(spark, str(tmp_path / "hot")).count() == 100_000


def test_curate_floors_dates_and_keeps_other_columns(spark):
    raw = spark.createDataFrame(
        [(D(2025, 8, 31), "A", "x", "electric", 7)],
        "date_reg date, maker string, model string, fuel string, extra int",
    )
    assert rows_of(curate(raw), "date_reg", "fuel_grouped", "extra") == [(D(2025, 8, 1), "BEV", 7)]


def test_make_model_list_is_distinct_and_sorted(facts):
    table = facts(
        ("2025-01", "b", "x"),
        ("2025-01", None, "x"),
        ("2025-01", "a", None),
        ("2025-02", "b", "x"),
        ("2025-01", "B", "x"),
        ("2025-01", "a", "y"),
    )
    assert rows_of(make_model_list(table), "maker", "model") == [
        ("B", "x"),
        ("a", "y"),
        ("a", None),
        ("b", "x"),
        (None, "x"),
    ]


def test_quoted_line_breaks_are_part_of_a_value(spark, landed, facts, tmp_path):
    path = landed("a.csv", "date_reg,maker,model,fuel", '2024-01-05,Proton,"X', '50",petrol')
    expected = [(D(2024, 1, 5), "Proton", "X\n50", "petrol")]
    assert rows_of(read_extracts(spark, [path], multiline=True), "*") == expected
    table = facts(("2024-01", 'a "b"\nc', "x,\ny", "BEV"), ("2024-02", None, "z", "BEV"))
    write_csv(table, str(tmp_path / "csv"))
    back = read_curated(spark, str(tmp_path / "csv"), "csv", multiline=True)
    assert sorted(rows_of(back, "*"), key=repr) == sorted(rows_of(table, "*"), key=repr)


def test_a_known_header_saves_the_look_at_each_path(spark, landed):
    path = landed("a.csv", "date_reg,maker,model,fuel", "2024-01-05,A,x,petrol")
    header = ("date_reg", "maker", "model", "fuel")
    found = read_extracts(spark, [path], header=header)
    assert rows_of(found, "*") == [(D(2024, 1, 5), "A", "x", "petrol")]


@pytest.mark.parametrize("rows", [(), ("NA,A,x,petrol", "soon,B,y,diesel")])
def test_curated_schema_does_not_depend_on_the_rows(spark, landed, tmp_path, rows):
    path = landed("a.csv", "date_reg,maker,model,fuel,state", *(f"{row},Johor" for row in rows))
    table = build_curated(spark, [path], str(tmp_path / "curated"))
    assert dict(table.dtypes) == {
        "date_reg": "date", "maker": "string", "model": "string", "fuel": "string",
        "state": "string", "fuel_grouped": "string",
    }
    assert table.count() == len(rows) == table.where("date_reg IS NULL").count()
    assert rows_of(read_curated(spark, str(tmp_path / "curated")), "maker") == rows_of(table, "maker")


def test_queries_keep_rows_without_a_date_and_other_years(spark, tmp_path):
    """A small copy of the order tables, with dates that the test data does not have."""
    import compare

    import __spark_entry__ as registered

    source = "/root/testdata/sf0.001"
    for name in ("lineitem", "part"):
        spark.read.parquet(f"{source}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    day = F.col("o_orderdate")
    odd = (
        F.when(F.col("o_orderkey") % 50 == 0, None)
        .when(F.col("o_orderkey") % 50 == 1, F.lit("2007-03-09").cast("timestamp_ntz"))
        .when(F.col("o_orderkey") % 50 == 2, F.lit("1990-03-09").cast("timestamp_ntz"))
        .otherwise(day)
    )
    orders = spark.read.parquet(f"{source}/orders.parquet").withColumn("o_orderdate", odd)
    orders.write.parquet(f"{tmp_path}/orders.parquet")
    connection = compare.duckdb.connect()
    for name in ("lineitem", "part", "orders"):
        connection.execute(
            f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{tmp_path}/{name}.parquet/*.parquet')"
        )
    queries, sql = registered.queries(), registered.oracle_sql()
    names = ("union_years", "curated_build", "top_makes", "count_current", "period_counts_fuel")
    for name in names:
        found = compare.of_spark(queries[name](spark, str(tmp_path)))
        assert found == compare.of_sql(connection, sql[name]), name
