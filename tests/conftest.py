import datetime as dt
import os
import sys

import pytest
from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [ROOT, os.path.join(ROOT, "tests")]


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[8]")
        .appName("tallytide-tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


FACT_SCHEMA = "date_reg date, maker string, model string, fuel string, fuel_grouped string"


@pytest.fixture
def facts(spark):
    """Build facts from short rows: month, maker, model, fuel group."""

    def build(*rows):
        full = []
        for row in rows:
            month, maker, model, group = (*row, *(None,) * (4 - len(row)))
            date = dt.date.fromisoformat(f"{month}-01") if month else None
            full.append((date, maker, model, None, group))
        return spark.createDataFrame(full, FACT_SCHEMA)

    return build


def rows_of(frame, *columns):
    """Values of the given columns as a list of tuples."""
    return [tuple(row) for row in frame.select(*columns).collect()]


def plan_of(frame) -> str:
    """The formatted plan text."""
    import contextlib
    import io

    text = io.StringIO()
    with contextlib.redirect_stdout(text):
        frame.explain("formatted")
    return text.getvalue()
