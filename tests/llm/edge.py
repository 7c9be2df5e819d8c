"""Small tables with what real ones may hold."""

from pyspark.sql import DataFrame, SparkSession

SCHEMA = (
    "doc_id bigint, text string, lang string, source string, n_chars bigint,"
    " value string, part int, score double, n bigint, rep string"
)
PASSAGE = " ".join(f"word{i} goes{i}" for i in range(40))


def documents(spark: SparkSession, *rows) -> DataFrame:
    """Rows (doc_id, text, lang, source) with further columns named like internal ones."""
    full = [(*row, *(None,) * (4 - len(row)), 1, "x", 3, 0.5, 7, "r") for row in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(3)


ODD_ROWS = (
    (1, PASSAGE, "en", "a"),
    (2, PASSAGE, "en", "a"),
    (3, PASSAGE.replace("word39", "other"), "en", "b"),
    (4, None, None, None),
    (5, "", "en", ""),
    (6, " \n\t ", "de", "b"),
    (7, "one", "de", "b"),
    (8, "ONE", "fr", "b"),
    (9, "é日本 😀 " * 9, None, "c"),
    (9, "é日本 😀 " * 9, None, "c"),
    (10, "long text of words " * 20_000, "en", "a"),
    (None, "a row without an id", "en", None),
    (None, None, None, None),
)


def odd(spark: SparkSession) -> DataFrame:
    return documents(spark, *ODD_ROWS)


def none(spark: SparkSession) -> DataFrame:
    return documents(spark).where("false")
