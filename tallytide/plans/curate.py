"""From raw extracts to the curated fact table."""

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from tallytide.functions.categories import FUEL_GROUPS, regroup
from tallytide.functions.dates import month_start
from tallytide.operators.combine import distinct_keys, sorted_by_keys
from tallytide.sources.curated import read_curated, write_curated
from tallytide.sources.extracts import read_extracts, split_extracts


def curate(extracts: DataFrame, groups: Mapping[str, str] = FUEL_GROUPS) -> DataFrame:
    """Extract rows with the date floored to its month and the fuel group added."""
    return extracts.withColumns(
        {
            "date_reg": month_start(F.col("date_reg")),
            "fuel_grouped": regroup(F.col("fuel"), groups),
        }
    )


def build_curated(
    spark: SparkSession,
    paths: Sequence[str],
    target: str,
    groups: Mapping[str, str] = FUEL_GROUPS,
    multiline: bool = False,
    header: Sequence[str] | None = None,
    replace: str = "table",
    rejects: str | None = None,
) -> DataFrame:
    """Read landed extracts, curate them, write the table to ``target`` and return it.

    ``replace="months"`` writes only the months of these extracts, in place of those stored.
    ``rejects`` is a folder for the rows that do not fit their header or its types, with their file,
    text and reason; they are then left out of the table. Without it all rows are kept, and
    what cannot be read in them is null.
    """
    if rejects is None:
        rows = read_extracts(spark, paths, multiline=multiline, header=header)
    else:
        rows, rejected = split_extracts(spark, paths, multiline=multiline, header=header)
        rejected.write.mode("overwrite").parquet(rejects)
    curated = curate(rows, groups)
    write_curated(curated, target, replace=replace)
    return read_curated(spark, target, schema=curated.schema)


def make_model_list(facts: DataFrame) -> DataFrame:
    """Every make and model that occurs, sorted."""
    keys = ("maker", "model")
    return sorted_by_keys(distinct_keys(facts, keys), keys)
