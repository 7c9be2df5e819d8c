"""Monthly counts that are kept beside the curated table and brought up to date by month."""

import datetime as dt
from collections.abc import Sequence
from itertools import chain

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import DateType, LongType, StringType, StructField, StructType

from tallytide.operators.calendar import Calendar, resolve_calendar
from tallytide.operators.counts import monthly_counts
from tallytide.plans.dashboard import Dashboard
from tallytide.plans.summary import MODEL_KEYS
from tallytide.sources.curated import CURATED_SCHEMA
from tallytide.sources.months import (
    drop_months,
    finish_replacing,
    month_files,
    replace_months,
    stored_months,
)

# The months' digests stand in the counts themselves: both are replaced in one step.
_FILES = "files"


def _stored(spark: SparkSession, path: str, keys: Sequence[str], schema: StructType) -> DataFrame:
    """The kept table: counts by key, and the digest of the files that they are from."""
    fields = [StructField(key, schema[key].dataType) for key in keys]
    fields += [StructField("registration", LongType()), StructField(_FILES, StringType())]
    return spark.read.schema(StructType([*fields, StructField("month", DateType())])).parquet(path)


def kept_counts(
    spark: SparkSession,
    path: str,
    keys: Sequence[str] = MODEL_KEYS,
    schema: StructType = CURATED_SCHEMA,
) -> DataFrame:
    """Kept registrations per month and key, as ``monthly_counts`` gives them."""
    return _stored(spark, path, keys, schema).select("month", *keys, "registration")


def update_counts(
    spark: SparkSession,
    table: str,
    path: str,
    keys: Sequence[str] = MODEL_KEYS,
    date: str = "date_reg",
    schema: StructType = CURATED_SCHEMA,
) -> list[dt.date | None]:
    """Bring the counts kept in ``path`` up to date with the curated table in ``table``.

    Only months whose files are not those that were counted are read, and only their counts are
    written; months that the table no longer has go. Returns the months that were counted.
    A job that is broken off leaves the counts as they were, and the next one does its work.
    """
    finish_replacing(spark, table)
    finish_replacing(spark, path)
    there = month_files(spark, table, date)
    counted: dict[dt.date | None, str] = {}
    if stored_months(spark, path, "month"):
        # One row per month.
        known = _stored(spark, path, keys, schema).select("month", _FILES).distinct().collect()
        counted = {row["month"]: row[_FILES] for row in known}
    changed = [month for month, digest in there.items() if counted.get(month) != digest]
    if changed or not counted:
        days = [month for month in changed if month is not None]
        wanted = F.col(date).isin(days)
        if None in changed:
            wanted = wanted | F.col(date).isNull()
        rows = spark.read.schema(schema).parquet(table).where(wanted) if there else None
        if rows is not None:
            digests = F.create_map(*(F.lit(x) for x in chain(*((m, there[m]) for m in days)))) if days else None
            digest = F.lit(there.get(None))
            if digests is not None:
                digest = F.coalesce(digests[F.col("month")], digest)
            counts = monthly_counts(rows, keys, date).withColumn(_FILES, digest)
            replace_months(counts.hint("rebalance", F.col("month")), path, "month", others=False)
    drop_months(spark, path, [month for month in counted if month not in there], "month")
    return changed


def kept_dashboard(
    spark: SparkSession,
    path: str,
    as_of: Calendar | dt.date | str | None = None,
    n: int = 10,
    dedup: bool = False,
) -> Dashboard:
    """Every page of the dashboard from the kept counts; no fact is read."""
    if as_of is None:
        as_of = Calendar.stored(spark, path, "month")
    cube = kept_counts(spark, path)
    return Dashboard(cube, resolve_calendar(cube, as_of, "month"), n, dedup)
