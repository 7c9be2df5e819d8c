"""Small helpers shared by the operators."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tallytide.shared import new_folder, shared_folder, written

__all__ = [
    "importable",
    "map_batches",
    "new_folder",
    "numbered",
    "shared_folder",
    "small_batches",
    "table",
    "texts_of",
    "written",
]

# Rows given to a batch function at a time.
ROWS = 1_000

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def importable(spark: SparkSession) -> None:
    """Let Python workers find this package when the session was started elsewhere.

    On a cluster the package is shipped with ``--py-files``; the entry does no harm there.
    """
    environment = spark.sparkContext.environment
    paths = environment.get("PYTHONPATH", "").split(os.pathsep)
    if ROOT not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([ROOT, *filter(None, paths)])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts_of(column: pa.Array) -> list[str]:
    """Values of a string column; null counts as the empty text."""
    return [value or "" for value in column.to_pylist()]


def map_batches(
    frame: DataFrame,
    columns: Callable[[pa.RecordBatch], list],
    schema: str,
    between: str = ",",
    rows: int = ROWS,
) -> DataFrame:
    """``frame`` through a function from a record batch to the list of result columns.

    ``between`` parts the columns of the schema, where commas stand inside types. The function
    gets ``rows`` rows at a time.
    """
    importable(frame.sparkSession)
    names = [part.split()[0] for part in schema.split(between)]
    schema = schema.replace(between, ",")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # What the function holds at a time does not depend on Spark's batch size.
            for at in range(0, batch.num_rows, rows):
                yield pa.RecordBatch.from_arrays(columns(batch.slice(at, rows)), names=names)

    return frame.mapInArrow(run, schema)


@contextmanager
def small_batches(spark: SparkSession, rows: int = ROWS, size: str = "8m") -> Iterator[None]:
    """Python workers get at most so many rows and bytes at a time in jobs that run meanwhile.

    Spark's own 10,000 rows of text are held several times over by the executor and the worker.
    """
    limits = {"maxRecordsPerBatch": str(rows), "maxBytesPerBatch": size}
    limits = {f"spark.sql.execution.arrow.{name}": limit for name, limit in limits.items()}
    before = {name: spark.conf.get(name, None) for name in limits}
    try:
        for name, limit in limits.items():
            spark.conf.set(name, limit)
        yield
    finally:
        for name, limit in before.items():
            spark.conf.unset(name) if limit is None else spark.conf.set(name, limit)


def all_of(conditions):
    return reduce(lambda a, b: a & b, conditions)


def numbered(frame: DataFrame, order: list, name: str) -> DataFrame:
    """``frame`` with its 0-based position in a total ``order``, without a single task.

    Rows are sorted by range and written once; a position is the number of rows in earlier
    ranges plus the place in the own one. Meant for narrow tables.
    """
    from pyspark.sql import Window, functions as F

    placed = written(frame.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33).alias("_part")
    # One row per sorted range.
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        placed.groupBy(part)
        .agg(F.count("*").alias("_size"))
        .select("_part", F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_before"))
    )
    place = F.col("_at").bitwiseAND((1 << 33) - 1)
    return (
        placed.select("*", part)
        .join(F.broadcast(offsets), "_part")
        .withColumn(name, F.col("_before") + place)
        .drop("_part", "_at", "_before")
    )
