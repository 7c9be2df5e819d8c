"""Documents to a training corpus: each stage's result is written and read by the next.

Language ID drops documents in no known language, near-dedup keeps one document of each group,
decontamination drops documents that hold a benchmark item, mixing puts the others in the order
of its schedule, and the last stage writes token ids in that order.

The mixing stage returns the columns of documents, so its order is that of its rows: its files
are numbered in order, and the last stage reads the number of each row's file and its place
there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tallytide.llm import decontaminate, language, mixing, near_dup, token_files
from tallytide.llm.common import new_folder, table


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the languages that labelled documents teach."""
    return language.in_known_language(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that shares 80 percent of its shingles of five words.

    Rows that repeat a doc_id stay or go together; rows without an id stay.
    """
    groups = near_dup.near_duplicates(docs, words=5, percent=80)
    dropped = groups.where("NOT kept").select("doc_id").distinct()
    return docs.join(dropped, "doc_id", "left_anti").select(docs.columns)


def decontaminate_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in the order of the schedule, sources weighted by the root of their size."""
    places = (
        mixing.mixed(docs, mixing.tempered_weights(docs))
        .groupBy("doc_id")
        .agg(F.min("position").alias("_position"))
    )
    return (
        docs.join(places, "doc_id", "left")
        .orderBy(F.asc_nulls_last("_position"), "doc_id")
        .select(docs.columns)
    )


def write_token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of all documents in the order of ``docs``, read back as one row per document.

    The order is that of the files; a table that is not read from files goes by doc_id.
    """
    order = None
    if docs.inputFiles():
        number = F.regexp_extract("_metadata.file_name", r"part-(\d+)", 1).cast("bigint")
        docs = docs.select("doc_id", "text", number.alias("_file"), F.col("_metadata.row_index").alias("_row"))
        order = [F.col("_file"), F.col("_row")]
    path = new_folder(spark)
    token_files.write_tokens(docs, path, order=order)
    return token_files.read_tokens(spark, path)


STAGES = [
    ("language ID", identify_language),
    ("near-dedup", drop_near_duplicates),
    ("decontamination", decontaminate_documents),
    ("mixing", mix_sources),
    ("token ids", write_token_ids),
]

# Profiles, hash order and tokens are beyond SQL; a brute-force version is tested instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other, from ``documents``; the last one's rows."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        path = new_folder(spark)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
