"""The curated fact table: one row per registration, stored by month."""

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StringType, StructField, StructType

from tallytide.sources.extracts import EXTRACT_SCHEMA, read_extracts
from tallytide.sources.months import replace_months

CURATED_SCHEMA = StructType([*EXTRACT_SCHEMA, StructField("fuel_grouped", StringType())])


def write_curated(
    table: DataFrame,
    path: str,
    date: str = "date_reg",
    sort_by: Sequence[str] = ("maker", "model"),
    replace: str = "table",
) -> None:
    """Write Parquet partitioned by ``date``, replacing what is there.

    ``replace="months"`` replaces the months that ``table`` has and leaves the files of others as
    they are. The old table can be read until the new rows are complete, and stays if the job
    is broken off (``tallytide.sources.months``).

    Rows are rebalanced by ``date``: small months share a task, and a month holding much
    of the table is split over many. Sorting inside the files makes repeated keys compress
    well.
    """
    if replace not in ("table", "months"):
        raise ValueError(f"replace is {replace!r}, not 'table' or 'months'")
    rows = table.hint("rebalance", F.col(date)).sortWithinPartitions(date, *sort_by)
    replace_months(rows, path, date, others=replace == "table")


def write_csv(table: DataFrame, path: str) -> None:
    """Write CSV files with a header and ``NA`` for null, replacing what is there."""
    table.write.mode("overwrite").options(header=True, nullValue="NA", escape='"').csv(path)


def read_curated(
    spark: SparkSession,
    path: str,
    format: str = "parquet",
    schema: StructType = CURATED_SCHEMA,
    multiline: bool = False,
) -> DataFrame:
    """The curated table from Parquet, or from its CSV form.

    ``schema`` names columns and types, so an empty table reads back as well and no file is
    opened to find them; give one with the extra columns of a table that has any.
    ``multiline`` is for CSV values with line breaks, as in ``read_extracts``.
    """
    if format == "csv":
        return read_extracts(spark, [path], schema, multiline)
    return spark.read.schema(schema).parquet(path)
