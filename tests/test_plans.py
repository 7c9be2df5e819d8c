"""Shape of the physical plans."""

import contextlib
import re
import uuid

import __spark_entry__ as registered
import pytest
from conftest import plan_of, rows_of

from tallytide.__main__ import main
from tallytide.operators import (
    Calendar,
    as_of_date,
    keep_members,
    monthly_counts,
    period_counts,
    with_rank,
)
from tallytide.plans import (
    MAKE_KEYS,
    MODEL_KEYS,
    dashboard,
    summary,
    summary_page,
    top_make_trend,
    top_model_trend,
)
from tallytide.sources import read_curated, write_curated

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def calendar(spark):
    return Calendar.at(spark, "2001-07-01")


@pytest.fixture(scope="module")
def curated(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("plans") / "curated")
    facts = registered.registrations(spark, SF_DIR).drop("part", "status")
    write_curated(facts.withColumn("date_reg", facts.date_reg.cast("date")), path)
    return read_curated(spark, path)


def test_latest_month_reads_no_data_columns(curated):
    assert "ReadSchema: struct<>" in plan_of(as_of_date(curated))


def test_period_counts_take_one_scan_and_one_exchange(curated):
    counts = period_counts(curated, MODEL_KEYS, Calendar.latest(curated))
    plan = plan_of(counts)
    assert len(re.findall(r"^\(\d+\) Scan", plan, re.M)) == 1
    assert len(re.findall(r"^\(\d+\) Exchange", plan, re.M)) == 1
    assert "ReadSchema: struct<maker:string,model:string,fuel_grouped:string>" in plan


def test_raw_date_bounds_reach_the_files(spark):
    lines = registered.table(spark, SF_DIR, "lineitem")
    calendar = Calendar.at(spark, "2001-07-01")
    plan = plan_of(period_counts(lines, ("l_suppkey",), calendar, "l_shipdate"))
    assert re.search(r"PushedFilters: \[Or\(.*GreaterThanOrEqual\(l_shipdate,2001-01-01", plan)
    assert "ReadSchema: struct<l_suppkey:bigint,l_shipdate:timestamp_ntz>" in plan


def shape(frame) -> list[str]:
    """The operators of a plan, without their numbers and expressions."""
    tree = plan_of(frame).split("\n\n")[0]
    return re.findall(r"[A-Z][A-Za-z]+", re.sub(r"\(\d+\)", "", tree))


@contextlib.contextmanager
def job_count(spark):
    """A list that holds the number of jobs run inside."""
    group, counted = uuid.uuid4().hex, []
    spark.sparkContext.setJobGroup(group, group)
    yield counted
    counted.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(group)))
    spark.sparkContext.setJobGroup("", "")


@pytest.mark.parametrize("report", [top_make_trend, top_model_trend])
def test_trends_have_one_plan_for_short_and_long_lists(spark, curated, report):
    plans, jobs = [], []
    for n in (5, 5000):
        with job_count(spark) as counted:
            plans.append(shape(report(curated, n, as_of="2001-07-01")))
        jobs += counted
    assert plans[0] == plans[1] and jobs[0] == jobs[1]


def test_members_are_joined_as_spark_sees_fit(spark, curated):
    name = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(name)
    keys = ("maker", "model")
    monthly, members = monthly_counts(curated, keys), curated.select(*keys).limit(10)
    assert "BroadcastHashJoin" in plan_of(keep_members(monthly, members, keys))
    spark.conf.set(name, "-1")
    try:
        assert "Broadcast" not in plan_of(keep_members(monthly, members, keys))
    finally:
        spark.conf.set(name, before)


def test_a_summary_is_planned_alike_with_and_without_a_month(curated):
    assert shape(summary(curated, MODEL_KEYS)) == shape(summary(curated, MODEL_KEYS, "2001-07-01"))


def test_summaries_of_a_dashboard_run_no_leader_jobs(spark, curated):
    pages = dashboard(curated, as_of="2001-07-01")
    with job_count(spark) as all_three:
        for page in (pages.makes, pages.models, pages.fuels):
            assert page.columns[0] == "rank"
    with job_count(spark) as one:
        summary(pages.cube, MAKE_KEYS, pages.calendar, "month", "registration")
    assert all_three[0] <= 3 * one[0] + 3
    assert "make_trend" not in vars(pages) and "model_trend" not in vars(pages)


def test_a_rank_is_lazy_and_holds_no_single_task_sort_of_the_keys(spark, curated, calendar):
    with job_count(spark) as counted:
        plan = plan_of(with_rank(period_counts(curated, MODEL_KEYS, calendar), MODEL_KEYS))
    assert counted == [0]
    assert "_intermediate" not in plan and "maker" not in single_task_windows(plan)
    windows = re.findall(r"\(\d+\) Window\n(?:.*\n)*?Arguments: (.*)\n", plan)
    assert len(windows) == 2 and any(", [_range" in w for w in windows)


def single_task_windows(plan: str) -> str:
    """What the windows that no column divides compute."""
    found = re.findall(r"Arguments: (\[.*\]), \[_range#\d+ ASC", plan)
    return " ".join(found)


def test_a_page_is_a_top_n_with_an_offset(spark, curated):
    with job_count(spark) as counted:
        page = summary_page(curated, MODEL_KEYS, 2, 10, "2001-07-01")
    plan = plan_of(page)
    assert re.search(r"TakeOrderedAndProject\n(?:.*\n)*?Arguments: (30|10), .*20", plan) or (
        "Arguments: 30" in plan and "20" in plan
    )
    assert len(re.findall(r"^\(\d+\) Scan", plan, re.M)) == 1 and counted[0] <= 1
    whole = summary(curated, MODEL_KEYS, "2001-07-01").where("rank BETWEEN 21 AND 30")
    assert rows_of(page, "*") == sorted(rows_of(whole, "*"))
    assert summary_page(curated, MODEL_KEYS, 10**6, 10, "2001-07-01").count() == 0


@pytest.mark.parametrize("report", [top_make_trend, top_model_trend])
def test_months_are_counted_below_the_join_with_the_leaders(curated, report):
    tree = plan_of(report(curated, 5000, as_of="2001-07-01")).split("\n\n")[0]
    lines = tree.splitlines()
    join = next(i for i, line in enumerate(lines) if "Join" in line)
    # Both sides of the join are aggregates of the facts, and nothing is aggregated above it.
    assert not any("Aggregate" in line for line in lines[:join])
    assert sum("Scan parquet" in line for line in lines) == 2
    assert sum("HashAggregate" in line for line in lines[join:]) >= 4


def test_no_python_in_any_plan(spark):
    for name in ("summary_by_model", "trend_top_models_january", "display_by_make"):
        plan = plan_of(registered.queries()[name](spark, SF_DIR))
        assert not re.search("EvalPython|InPandas|InArrow|PythonUDF", plan)


def test_jobs_from_extracts_to_reports(spark, tmp_path):
    (tmp_path / "2024.csv").write_text(
        "date_reg,maker,model,fuel\n2024-12-05,Proton,X50,petrol\n2024-12-09,Tesla,3,electric\n"
    )
    (tmp_path / "2025.csv").write_text(
        "date_reg,maker,model,fuel\n2025-01-07,Proton,X50,petrol\n2025-01-08,Proton,X50,petrol\n"
    )
    table, folder = str(tmp_path / "table"), str(tmp_path / "reports")
    main(["curate", table, str(tmp_path / "2024.csv"), str(tmp_path / "2025.csv")])
    main(["report", table, folder])
    makes = spark.read.parquet(f"{folder}/makes_display").orderBy("Rank")
    assert rows_of(makes, "Make", "Jan-2025", "Dec-2024", "Growth (MoM) text") == [
        ("Proton", 2, 1, "100.0%"),
        ("Tesla", 0, 1, "-100.0%"),
    ]
    assert spark.read.parquet(f"{folder}/model_trend").count() == 3
    assert spark.read.parquet(f"{folder}/make_model_list").count() == 2
    main(["report", table, folder, "--as-of", "2024-12-31", "--top", "1"])
    leader = spark.read.parquet(f"{folder}/make_trend")
    assert sorted(rows_of(leader, "maker", "registration")) == [("Proton", 1), ("Proton", 2)]
