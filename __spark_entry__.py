"""The registered queries, and SQL to check each of them against.

Stand-in registrations come from the order tables: a line item is one registration, dated
by its order, with the part's brand and type as make and model and the order priority as
fuel code.
"""

from __future__ import annotations

import os
import sys
import uuid
from collections.abc import Callable
from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import oracles  # noqa: E402
from tallytide import operators as op  # noqa: E402
from tallytide import plans  # noqa: E402
from tallytide.functions import (  # noqa: E402
    joined_label,
    maker_class,
    month_label,
    month_start,
    regroup,
    shift_months,
    shift_years,
    year_start,
    ytd_label,
)
from tallytide.plans import FUEL_KEYS, MAKE_KEYS, MODEL_KEYS  # noqa: E402
from tallytide.shared import shared_folder, written  # noqa: E402
from tallytide.sources import (  # noqa: E402
    read_curated,
    read_extracts,
    split_extracts,
    write_csv,
    write_curated,
)

PRIORITY_GROUPS = {"1-URGENT": "Urgent", "2-HIGH": "Expedited", "3-MEDIUM": "Expedited"}
PART_KEYS = ("part", "maker", "model")
SHIP_KEYS = ("l_suppkey", "l_returnflag")
LAST = "2001-08-01"
FULL_MONTH = "2001-07-01"
JANUARY = "2001-01-01"
FIRST_YEAR = "1995-06-01"

# The columns in use, declared so that no job reads footers to find the types.
SCHEMAS = {
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_returnflag string,"
    " l_shipdate timestamp_ntz",
    "orders": "o_orderkey bigint, o_orderstatus string, o_orderdate timestamp_ntz,"
    " o_orderpriority string",
    "part": "p_partkey bigint, p_brand string, p_type string",
    "events": "ts timestamp_ntz, event_type string",
}

Query = Callable[[SparkSession, str], DataFrame]

# The operators for training data can be left out of an installation.
try:
    import corpus_pipeline
    from tallytide.llm import queries as _llm
except ModuleNotFoundError as missing:
    if missing.name not in ("corpus_pipeline", "tallytide.llm"):
        raise
    LLM_QUERIES, LLM_SQL = {}, {}
else:
    LLM_QUERIES = _llm.QUERIES | {"pipeline": corpus_pipeline.run}
    LLM_SQL = _llm.ORACLE_SQL | (
        {"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {}
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def yearly_orders(spark: SparkSession, sf_dir: str, years=None) -> list[DataFrame]:
    """Orders split by year, the first part without its status.

    Without ``years`` all that occur, which are few, and then the orders without a date.
    """
    orders = table(spark, sf_dir, "orders")
    day, dateless = F.col("o_orderdate"), []
    if years is None:
        found = orders.select(F.year(day).alias("year")).distinct().collect()
        years = sorted(row["year"] for row in found if row["year"] is not None)
        dateless = [orders.where(day.isNull())]
    parts = [orders.where((day >= f"{y}-01-01") & (day < f"{y + 1}-01-01")) for y in years]
    return [part.drop("o_orderstatus") for part in parts[:1]] + parts[1:] + dateless


def extract(spark: SparkSession, sf_dir: str, orders: DataFrame | None = None) -> DataFrame:
    """Registrations as they would be landed, before any curation."""
    lines, parts = (table(spark, sf_dir, name) for name in ("lineitem", "part"))
    orders = table(spark, sf_dir, "orders") if orders is None else orders
    return (
        lines.join(orders, lines.l_orderkey == orders.o_orderkey)
        .join(parts, lines.l_partkey == parts.p_partkey)
        .select(
            F.col("o_orderdate").alias("date_reg"),
            F.col("p_brand").alias("maker"),
            F.col("p_type").alias("model"),
            F.col("o_orderpriority").alias("fuel"),
            F.col("o_orderstatus").alias("status"),
            F.col("p_partkey").alias("part"),
        )
    )


def registrations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registrations with their fuel group.

    The date stays as stored, so that period bounds reach the scan of the orders.
    """
    group = regroup(F.col("fuel"), PRIORITY_GROUPS)
    return extract(spark, sf_dir).withColumn("fuel_grouped", group)


def _on_registrations(build: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: build(registrations(spark, sf_dir))


def _on_months(keys, build: Callable[..., DataFrame]) -> Query:
    """A report on the monthly counts of ``keys``, written once.

    Reports that look up the latest month, or follow their leaders, pass over the facts
    more than once; this way the order tables are still joined only once.
    """

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        months = written(op.monthly_counts(registrations(spark, sf_dir), keys))
        return build(months, date="month", weight="registration")

    return query


def _period_count(period: str) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        facts = registrations(spark, sf_dir)
        return op.period_count(facts, MAKE_KEYS, op.Calendar.latest(facts), period)

    return query


def _period_counts(keys) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        facts = registrations(spark, sf_dir)
        return op.period_counts(facts, keys, op.Calendar.latest(facts))

    return query


def _summary(keys, as_of=None) -> Query:
    if as_of is None:
        return _on_months(keys, partial(plans.summary, keys=keys))
    return _on_registrations(lambda facts: plans.summary(facts, keys, as_of))


def _top(keys, names) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        facts = registrations(spark, sf_dir)
        counts = op.period_counts(facts, keys, op.Calendar.latest(facts))
        return op.top_n(counts, keys).select(*names)

    return query


def _display(keys) -> Query:
    return _on_months(keys, partial(plans.display_report, keys=keys))


def date_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every date function on every order day."""
    day = F.col("o_orderdate")
    derived: dict[str, Column] = {
        "month_start": month_start(day),
        "year_start": year_start(day),
        "year_number": F.year(day).cast("bigint"),
        "month_before": shift_months(day, -1),
        "year_before": shift_months(day, -12),
        "three_years_before": shift_years(day, -3),
        "month_text": month_label(day),
        "ytd_text": ytd_label(day),
    }
    columns = (column.alias(name) for name, column in derived.items())
    return table(spark, sf_dir, "orders").groupBy(day.cast("date").alias("day"), *columns).count()


def rows_of_top_makes(facts: DataFrame) -> DataFrame:
    counts = op.period_counts(facts, MAKE_KEYS, op.Calendar.at(facts.sparkSession, FULL_MONTH))
    leaders = op.top_n(counts, MAKE_KEYS, 10)
    kept = op.keep_members(facts, leaders, MAKE_KEYS)
    return kept.groupBy("maker", "fuel").agg(F.count("*").alias("n"))


def rows_of_top_models(facts: DataFrame) -> DataFrame:
    counts = op.period_counts(facts, MODEL_KEYS, op.Calendar.at(facts.sparkSession, JANUARY))
    leaders = op.top_n(counts, MODEL_KEYS, 10).select("maker", "model")
    joined = op.attach_members(facts, leaders, ("maker", "model"))
    return joined.groupBy("maker", "model", "fuel").agg(F.count("*").alias("n"))


def fuel_regroup(facts: DataFrame) -> DataFrame:
    return facts.groupBy("fuel", "fuel_grouped").agg(F.count("*").alias("n"))


def make_class(facts: DataFrame) -> DataFrame:
    national = maker_class(F.col("maker"), ("Brand#11", "Brand#23"))
    return facts.groupBy("maker", national.alias("class")).agg(F.count("*").alias("n"))


def make_model_label(facts: DataFrame) -> DataFrame:
    label = joined_label(F.col("maker"), F.col("model"))
    return facts.groupBy(label.alias("make_model")).agg(F.count("*").alias("n"))


def month_floor(facts: DataFrame) -> DataFrame:
    curated = plans.curate(facts.drop("fuel_grouped"), PRIORITY_GROUPS)
    return curated.groupBy("date_reg", "fuel_grouped").agg(F.count("*").alias("n"))


def union_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Yearly parts with different columns, stacked by column name."""
    rows = op.union_by_name(yearly_orders(spark, sf_dir))
    year = F.year("o_orderdate").cast("bigint").alias("year")
    return rows.groupBy(year, F.col("o_orderstatus").alias("status")).agg(
        F.count("*").alias("n")
    )


def _on_two_years(build: Callable[..., DataFrame]) -> Query:
    """A report by make on the last two yearly parts only."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        orders = op.union_by_name(yearly_orders(spark, sf_dir, (2000, 2001)))
        months = written(op.monthly_counts(extract(spark, sf_dir, orders), MAKE_KEYS))
        return build(months, date="month", weight="registration")

    return query


def preview(facts: DataFrame) -> DataFrame:
    columns = ("date_reg", "maker", "model", "fuel", "fuel_grouped")
    days = facts.withColumn("date_reg", F.to_date("date_reg")).select(*columns)
    return op.preview(days.orderBy(*columns))


def _landed(spark: SparkSession, sf_dir: str) -> list[str]:
    """Two CSV extracts in the shared folder; only the first has a status column."""
    rows = extract(spark, sf_dir).drop("part").withColumn("date_reg", F.to_date("date_reg"))
    rows = written(rows)
    folder = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    paths = [f"{folder}/to_1999", f"{folder}/from_2000"]
    write_csv(rows.where("date_reg IS NULL OR date_reg < DATE'2000-01-01'"), paths[0])
    later = rows.where("date_reg >= DATE'2000-01-01'")
    write_csv(later.select("fuel", "model", "maker", "date_reg"), paths[1])
    return paths


def curated_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CSV extracts to the curated table and back, counted by its columns."""
    paths = _landed(spark, sf_dir)
    target = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    built = plans.build_curated(spark, paths, target, PRIORITY_GROUPS)
    return built.groupBy("date_reg", "fuel", "fuel_grouped", "status").agg(
        F.count("*").alias("n")
    )


def _refreshed(spark: SparkSession, sf_dir: str, between: Callable[[str], object]) -> str:
    """A curated table after a second build that brings one month alone, with fewer rows.

    Late rows of a month that was not there before come with it. ``between`` is called after the
    first build.
    """
    rows = written(extract(spark, sf_dir).drop("part", "status"))
    folder = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    again = (F.col("date_reg") >= "2001-07-01") & (F.col("date_reg") < "2001-08-01")
    day = F.to_date("date_reg")
    write_csv(rows.withColumn("date_reg", day), f"{folder}/all")
    late = rows.where(again & (F.col("fuel") != "1-URGENT"))
    moved = late.where("fuel = '5-LOW'").withColumn("date_reg", F.add_months(day, 12))
    write_csv(late.withColumn("date_reg", day).unionByName(moved), f"{folder}/late")
    path = f"{folder}/table"
    plans.build_curated(spark, [f"{folder}/all"], path, PRIORITY_GROUPS)
    between(path)
    plans.build_curated(spark, [f"{folder}/late"], path, PRIORITY_GROUPS, replace="months")
    return path


def curated_month_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The curated table after a month came again."""
    table = read_curated(spark, _refreshed(spark, sf_dir, lambda path: None))
    return table.groupBy("date_reg", "fuel", "fuel_grouped").agg(F.count("*").alias("n"))


def kept_counts_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The summary by model from counts kept since before a month came again."""
    counts = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    path = _refreshed(spark, sf_dir, lambda path: plans.update_counts(spark, path, counts))
    plans.update_counts(spark, path, counts)
    return plans.kept_dashboard(spark, counts).models


def stored_calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The calendar of a curated table, from the names of its folders."""
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    rows = extract(spark, sf_dir).select("date_reg", "maker", "model", "fuel")
    write_curated(plans.curate(rows, PRIORITY_GROUPS), path)
    months = spark.createDataFrame([(op.Calendar.stored(spark, path).month_current,)], "day date")
    return op.reporting_calendar(months, "day")


def extract_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extracts of which some rows do not fit: accepted and rejected ones, by make and reason."""
    rows = extract(spark, sf_dir)
    day = F.date_format("date_reg", "yyyy-MM-dd")
    kind = F.col("part") % 7
    line = (
        F.when(kind == 0, F.concat_ws(",", day, "maker", "model", "fuel", "status", "status"))
        .when(kind == 1, F.concat_ws(",", F.date_format("date_reg", "dd/MM/yyyy"), "maker", "model", "fuel"))
        .when(kind == 2, F.concat_ws(",", day, "maker"))
        .when(kind == 3, F.concat_ws(",", F.lit("NA"), "maker", "model", "fuel"))
        .otherwise(F.concat_ws(",", day, "maker", "model", "fuel"))
    )
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    rows.where("date_reg IS NOT NULL").select(line).write.text(path)
    # The files have no header line, so their columns are given and the first row is not one.
    good, bad = split_extracts(
        spark, [path], header=("date_reg", "maker", "model", "fuel"), header_lines=False
    )
    maker = F.element_at(F.split("text", ","), 2)
    return op.union_by_name(
        [
            good.groupBy("maker").agg(
                F.lit("accepted").alias("reason"),
                F.count("*").alias("n"),
                F.count("date_reg").alias("dated"),
                F.countDistinct("model", "fuel").alias("kinds"),
            ),
            bad.groupBy(maker.alias("maker"), "reason").agg(F.count("*").alias("n")),
        ]
    )


def union_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of two halves, one with text for keys and status, as text wherever they differ."""
    orders = table(spark, sf_dir, "orders")
    odd = F.col("o_orderkey") % 2 == 1
    texts = orders.where(odd).withColumn("o_orderkey", F.concat(F.lit("00"), "o_orderkey"))
    numbers = orders.where(~odd).withColumn("o_orderstatus", F.length("o_orderstatus"))
    rows = op.union_by_name([texts, numbers], on_conflict="text")
    return rows.groupBy("o_orderstatus").agg(
        F.count("*").alias("n"), F.min("o_orderkey").alias("first"), F.max("o_orderkey").alias("last")
    )


def curated_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The curated table through its CSV form, summarised by make."""
    target = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    extracts = read_extracts(spark, _landed(spark, sf_dir))
    write_csv(plans.curate(extracts, PRIORITY_GROUPS), target)
    return plans.summary(read_curated(spark, target, "csv"), MAKE_KEYS)


def curated_csv_line_breaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Models with quotes and line breaks through CSV extracts, counted by make and model."""
    target = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    odd = F.concat(F.lit('"'), F.col("model"), F.lit('"\n'), F.col("maker"))
    rows = extract(spark, sf_dir).select("date_reg", "maker", odd.alias("model"), "fuel")
    write_csv(rows.withColumn("date_reg", F.to_date("date_reg")), target)
    read = read_extracts(spark, [target], multiline=True)
    return read.groupBy("maker", "model").agg(
        F.count("*").alias("n"), F.max("date_reg").alias("last")
    )


def display_page(facts: DataFrame) -> DataFrame:
    shown = plans.display_report(facts, PART_KEYS, FULL_MONTH)
    return op.page(shown, 1, rank="Rank")


def display_page_by_offset(facts: DataFrame) -> DataFrame:
    """The same page, of which only the rows up to its end are ordered."""
    return plans.display_page(facts, PART_KEYS, 1, as_of=FULL_MONTH)


def display_filtered(facts: DataFrame) -> DataFrame:
    shown = plans.display_report(facts, MODEL_KEYS, FULL_MONTH)
    return op.filter_columns(
        shown, {"Make": "#2 brand", "Jul-2001": (2, None), "Growth (MoM)": (-0.5, 0.5)}
    )


def dashboard_summaries(facts: DataFrame) -> DataFrame:
    """The three summaries of the one-scan dashboard, stacked."""
    pages = plans.dashboard(facts)
    return op.union_by_name(
        page.withColumn("page", F.lit(name))
        for name, page in (("make", pages.makes), ("model", pages.models), ("fuel", pages.fuels))
    ).select("page", "rank", *MODEL_KEYS, *plans.MEASURES)


def dashboard_trends(facts: DataFrame) -> DataFrame:
    """The three trends of the one-scan dashboard, stacked."""
    pages = plans.dashboard(facts, as_of=JANUARY)
    named = (("make", pages.make_trend), ("model", pages.model_trend), ("fuel", pages.fuel_trend))
    return op.union_by_name(
        page.drop("make_model").withColumn("page", F.lit(name)) for name, page in named
    ).select("page", "month", *MODEL_KEYS, "registration")


def combined_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five counts taken one by one, each from its own months, then put side by side."""
    lines, calendar = table(spark, sf_dir, "lineitem"), op.Calendar.at(spark, JANUARY)
    counts = (op.period_count(lines, SHIP_KEYS, calendar, p, "l_shipdate") for p in op.PERIODS)
    return op.combine_period_counts(counts, SHIP_KEYS)


def summary_by_shipment(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    return plans.summary(lines, SHIP_KEYS, FULL_MONTH, date="l_shipdate")


def summary_of_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plans.summary(table(spark, sf_dir, "events"), ("event_type",), date="ts")


def entry(spark: SparkSession) -> DataFrame:
    """Summary by make of the smallest tables."""
    return plans.summary(registrations(spark, "/root/testdata/sf0.001"), MAKE_KEYS)


def queries() -> dict[str, Query]:
    """Every registered query, by name."""
    return {
        "as_of_date": _on_registrations(op.as_of_date),
        "reporting_calendar": _on_registrations(op.reporting_calendar),
        "date_functions": date_functions,
        **{f"count_{period}": _period_count(period) for period in op.PERIODS},
        "period_counts_make": _period_counts(MAKE_KEYS),
        "period_counts_model": _period_counts(MODEL_KEYS),
        "period_counts_fuel": _period_counts(FUEL_KEYS),
        "count_current_full_month": lambda spark, sf_dir: op.period_count(
            registrations(spark, sf_dir), MAKE_KEYS, op.Calendar.at(spark, FULL_MONTH), "current"
        ),
        "combined_counts": combined_counts,
        "summary_by_make": _summary(MAKE_KEYS),
        "summary_by_model": _summary(MODEL_KEYS),
        "summary_by_fuel": _summary(FUEL_KEYS),
        "summary_by_make_full_month": _summary(MAKE_KEYS, FULL_MONTH),
        "summary_by_model_january": _summary(MODEL_KEYS, JANUARY),
        "summary_by_fuel_first_year": _summary(FUEL_KEYS, FIRST_YEAR),
        "summary_by_part": _summary(PART_KEYS, LAST),
        "summary_by_shipment": summary_by_shipment,
        "summary_of_events": summary_of_events,
        "top_makes": _top(MAKE_KEYS, MAKE_KEYS),
        "top_models": _top(MODEL_KEYS, ("maker", "model")),
        "trend_top_makes": _on_months(MAKE_KEYS, plans.top_make_trend),
        "trend_top_makes_full_month": _on_registrations(
            lambda facts: plans.top_make_trend(facts, as_of=FULL_MONTH)
        ),
        "trend_top_models": _on_months(MODEL_KEYS, plans.top_model_trend),
        "trend_top_models_january": _on_registrations(
            lambda facts: plans.top_model_trend(facts, as_of=JANUARY)
        ),
        "trend_top_models_january_dedup": _on_registrations(
            lambda facts: plans.top_model_trend(facts, as_of=JANUARY, dedup=True)
        ),
        "trend_fuel": _on_registrations(lambda facts: plans.trend(facts, FUEL_KEYS)),
        "rows_of_top_makes": _on_registrations(rows_of_top_makes),
        "rows_of_top_models": _on_registrations(rows_of_top_models),
        "fuel_regroup": _on_registrations(fuel_regroup),
        "make_class": _on_registrations(make_class),
        "make_model_label": _on_registrations(make_model_label),
        "make_model_list": _on_registrations(plans.make_model_list),
        "month_floor": _on_registrations(month_floor),
        "union_years": union_years,
        "summary_by_make_two_years": _on_two_years(partial(plans.summary, keys=MAKE_KEYS)),
        "trend_top_makes_two_years": _on_two_years(plans.top_make_trend),
        "preview": _on_registrations(preview),
        "curated_build": curated_build,
        "curated_month_refresh": curated_month_refresh,
        "kept_counts_refresh": kept_counts_refresh,
        "stored_calendar": stored_calendar,
        "extract_rejects": extract_rejects,
        "union_types": union_types,
        "curated_csv": curated_csv,
        "curated_csv_line_breaks": curated_csv_line_breaks,
        "display_by_make": _display(MAKE_KEYS),
        "display_by_model": _display(MODEL_KEYS),
        "display_by_fuel": _display(FUEL_KEYS),
        "display_page": _on_registrations(display_page),
        "display_page_by_offset": _on_registrations(display_page_by_offset),
        "display_filtered": _on_registrations(display_filtered),
        "dashboard_summaries": _on_registrations(dashboard_summaries),
        "dashboard_trends": _on_registrations(dashboard_trends),
        **LLM_QUERIES,
    }


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL for the queries, by name."""
    return oracles.oracle_sql() | LLM_SQL
