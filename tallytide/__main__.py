"""Batch jobs: ``curate`` builds the curated table and shows first rows and counts, ``report``
writes every report and prints the anchor month.

    python -m tallytide curate TABLE EXTRACT [EXTRACT ...] [--multiline] [--months]
                               [--header NAME,NAME ...] [--rejects FOLDER]
    python -m tallytide report TABLE FOLDER [--as-of DATE] [--top N] [--dedup] [--counts FOLDER]

On a cluster, hand this file to ``spark-submit`` with the package in ``--py-files``.
"""

import argparse
from collections.abc import Sequence

from pyspark.sql import SparkSession

from tallytide.operators import as_of_date, preview
from tallytide.plans import build_curated, dashboard, display, kept_dashboard, update_counts
from tallytide.sources import REJECT_SCHEMA, read_curated


def report(
    spark: SparkSession,
    table: str,
    folder: str,
    as_of: str | None,
    top: int,
    dedup: bool,
    counts: str | None,
) -> None:
    """Write summaries, their display tables, trends and the make and model list."""
    if counts is None:
        pages = dashboard(read_curated(spark, table), as_of, top, dedup)
    else:
        months = update_counts(spark, table, counts)
        print(f"{len(months)} months counted")
        pages = kept_dashboard(spark, counts, as_of, top, dedup)
    for name in ("makes", "models", "fuels"):
        target = f"{folder}/{name}"
        getattr(pages, name).write.mode("overwrite").parquet(target)
        # The display table starts from the written summary, which is not ranked again.
        shown = display(spark.read.parquet(target), pages.calendar)
        shown.write.mode("overwrite").parquet(f"{folder}/{name}_display")
    for name in ("make_trend", "model_trend", "fuel_trend"):
        getattr(pages, name).write.mode("overwrite").parquet(f"{folder}/{name}")
    pages.make_models.write.mode("overwrite").parquet(f"{folder}/make_model_list")
    print(pages.calendar.month_current)


def main(arguments: Sequence[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="tallytide")
    jobs = parser.add_subparsers(dest="job", required=True)
    curate_job = jobs.add_parser("curate", help="CSV extracts to the curated table")
    curate_job.add_argument("table")
    curate_job.add_argument("extracts", nargs="+")
    curate_job.add_argument(
        "--multiline", action="store_true", help="quoted values may hold line breaks"
    )
    curate_job.add_argument(
        "--months", action="store_true", help="replace only the months of these extracts"
    )
    curate_job.add_argument("--header", help="columns of all extracts, with commas between")
    curate_job.add_argument("--rejects", help="folder for rows that cannot be read")
    report_job = jobs.add_parser("report", help="curated table to all reports")
    report_job.add_argument("table")
    report_job.add_argument("folder")
    report_job.add_argument("--as-of", help="ISO date; the latest month if left out")
    report_job.add_argument("--top", type=int, default=10, help="number of leaders in a trend")
    report_job.add_argument("--dedup", action="store_true", help="count a repeated leader once")
    report_job.add_argument("--counts", help="folder of monthly counts to keep and start from")
    options = parser.parse_args(arguments)

    spark = SparkSession.builder.appName("tallytide").getOrCreate()
    if options.job == "curate":
        table = build_curated(
            spark,
            options.extracts,
            options.table,
            multiline=options.multiline,
            header=options.header and options.header.split(","),
            replace="months" if options.months else "table",
            rejects=options.rejects,
        )
        preview(table).show()
        found = as_of_date(table).first()
        print(f"{found['n_rows']} rows, {found['n_null_dates']} without a readable date")
        if options.rejects:
            reasons = spark.read.schema(REJECT_SCHEMA).parquet(options.rejects)
            for row in reasons.groupBy("reason").count().orderBy("reason").collect():
                print(f"{row['count']} rejected rows: {row['reason']}")
    else:
        report(
            spark,
            options.table,
            options.folder,
            options.as_of,
            options.top,
            options.dedup,
            options.counts,
        )


if __name__ == "__main__":
    main()
