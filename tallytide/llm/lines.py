"""Line dedup by site-relative frequency.

A line's frequency on a host is the number of the host's pages that contain it, in parts of
all its pages. Lines above a ratio are boilerplate and are dropped from the pages of that host
alone, if they are on ``LEAST_REPEATS`` pages at least, on hosts of every size. ``least_pages`` can
keep hosts with fewer pages out of it.

A page counts once for a line it repeats. Lines are compared as they are after trimming
blanks; empty ones are dropped. Pages without a host form one group, as do pages whose host is
the empty text. Null texts have no lines.

A host has at most ``lines per page / ratio`` boilerplate lines, however many pages it has, so
these are gathered per host and joined to its pages; the pages' lines are not joined one by one.
The gathered lines are written first: Spark then knows their size, and either sends them to
all tasks or shuffles both sides, which splits the pages of a large host.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tallytide.llm.common import written

RATIO = 0.3
LEAST_PAGES = 1
# On a host of two or three pages, a line of a single page is above the ratio as well.
LEAST_REPEATS = 2


def text_lines(html: Column) -> Column:
    """The text between tags, one line for each piece."""
    return F.regexp_replace(html, "<[^>]*>", "\n")


def host_of(url: Column) -> Column:
    """The lower-cased host of an address; empty if there is none."""
    return F.lower(F.regexp_extract(url, "^[A-Za-z]+://([^/:?#]+)", 1))


def without_boilerplate(
    pages: DataFrame,
    id: str,
    host: Column,
    text: Column,
    ratio: float = RATIO,
    least_pages: int = LEAST_PAGES,
) -> DataFrame:
    """(page_id, host, n_lines, n_dropped, text) of every row; ``text`` has the kept lines."""
    lines = F.filter(F.transform(F.split(text, "\n"), lambda line: F.trim(line)), lambda line: line != "")
    rows = pages.select(
        F.col(id).alias("page_id"),
        F.coalesce(host, F.lit("")).alias("host"),
        F.coalesce(lines, F.array().cast("array<string>")).alias("lines"),
    )
    totals = rows.groupBy("host").agg(F.count("*").alias("pages")).where(f"pages >= {least_pages}")
    # Shares are compared as whole numbers.
    boilerplate = written(
        rows.select("host", F.explode(F.array_distinct("lines")).alias("line"))
        .groupBy("host", "line")
        .agg(F.count("*").alias("n"))
        .join(totals, "host")
        .where(F.col("n") >= LEAST_REPEATS)
        .where(F.col("n") * 1000 > F.col("pages") * round(ratio * 1000))
        .groupBy("host")
        .agg(F.collect_list("line").alias("drop"))
    )
    kept = F.when(F.col("drop").isNull(), F.col("lines")).otherwise(
        F.filter("lines", lambda line: ~F.array_contains("drop", line))
    )
    return (
        rows.join(boilerplate, "host", "left")
        .withColumn("kept", kept)
        .select(
            "page_id",
            "host",
            F.size("lines").cast("bigint").alias("n_lines"),
            (F.size("lines") - F.size("kept")).cast("bigint").alias("n_dropped"),
            F.array_join("kept", "\n").alias("text"),
        )
    )
