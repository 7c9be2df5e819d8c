import random

import pytest
from conftest import rows_of
from pyspark.sql import functions as F

from tallytide.operators import COUNTS, PERIODS, page, top_n, with_rank
from tallytide.operators.ranking import in_ranges
from tallytide.plans import MAKE_KEYS, MEASURES, MODEL_KEYS, summary

FIRST_SEEN = {period: n for n, period in enumerate(PERIODS)}


def counts_frame(spark, rows):
    columns = ["maker string", *(f"{name} bigint" for name in COUNTS)]
    return spark.createDataFrame(rows, ", ".join(columns))


def expected_ranks(rows):
    """Rank of each maker by a stable sort over the tables in join order."""
    joined = []
    for period in range(len(PERIODS)):
        present = [row for row in rows if row[1 + period] > 0 and row not in joined]
        joined += sorted(present, key=lambda row: (row[0] is None, row[0] or ""))
    joined.sort(key=lambda row: -row[1])
    return {row[0]: rank for rank, row in enumerate(joined, 1)}


def tied_rows(n, seed=3):
    """Unique makers, most of them tied at a current count of zero."""
    rng = random.Random(seed)
    rows = [(None, 0, 0, 0, 0, 1)]
    for i in range(n):
        counts = [rng.choice([0, 0, 0, 0, 1, 2]) for _ in PERIODS]
        if not any(counts):
            counts[4] = 1
        rows.append((f"m{i:05d}", *counts))
    rng.shuffle(rows)
    return rows


def test_rank_follows_the_join_order(spark):
    rows = tied_rows(600)
    ranked = with_rank(counts_frame(spark, rows), ("maker",))
    assert dict(rows_of(ranked, "maker", "rank")) == expected_ranks(rows)


def test_range_rank_splits_a_run_of_equal_counts(spark):
    """All keys tie, and still no range holds more than a small share of them."""
    tied = spark.range(40_000).select(
        F.concat(F.lit("m"), F.lpad("id", 6, "0")).alias("maker"),
        *(F.lit(int(name == "count_ytd_previous")).cast("bigint").alias(name) for name in COUNTS),
    )
    sizes = [n for (n,) in rows_of(in_ranges(tied, ("maker",)).groupBy("_range").count(), "count")]
    assert len(sizes) == 65 and max(sizes) < 2_000
    ranked = with_rank(tied, ("maker",))
    wrong = ranked.where(F.col("rank") != F.substring("maker", 2, 6).cast("bigint") + 1)
    assert wrong.count() == 0 and ranked.count() == 40_000


def test_top_n_is_the_start_of_the_rank(spark):
    rows = tied_rows(300, seed=5)
    frame = counts_frame(spark, rows)
    ranks = expected_ranks(rows)
    leaders = {maker for (maker,) in rows_of(top_n(frame, ("maker",), 25), "maker")}
    assert leaders == {maker for maker, rank in ranks.items() if rank <= 25}


def test_summary_columns_and_values(facts):
    table = facts(
        ("2025-03", "A"),
        ("2025-03", "A"),
        ("2025-03", "B"),
        ("2025-02", "A"),
        ("2024-03", "B"),
        ("2024-03", "B"),
        ("2024-02", "C"),
    )
    result = summary(table, MAKE_KEYS)
    assert result.columns == ["rank", "maker", *MEASURES]
    assert sorted(rows_of(result, "*")) == [
        (1, "A", 2, 1, 1.0, 0, None, 3, 0, None),
        (2, "B", 1, 0, None, 2, -0.5, 1, 2, -0.5),
        (3, "C", 0, 0, None, 0, None, 0, 1, -1.0),
    ]


def test_null_and_text_keys_group_apart(facts):
    table = facts(("2025-03", None), ("2025-03", "NA"), ("2025-03", ""), ("2025-03", None))
    result = summary(table, MAKE_KEYS).orderBy("rank")
    assert rows_of(result, "maker", "count_current") == [(None, 2), ("", 1), ("NA", 1)]


def test_given_and_found_as_of_agree(facts):
    rng = random.Random(9)
    table = facts(
        *(
            (f"202{rng.choice('45')}-0{rng.randint(1, 6)}", rng.choice("ABCD"), rng.choice("xy"))
            for _ in range(200)
        ),
        ("2025-06", "A", "x"),
    )
    found = sorted(rows_of(summary(table, MODEL_KEYS), "*"))
    given = sorted(rows_of(summary(table, MODEL_KEYS, "2025-06-20"), "*"))
    assert found == given
    assert [row[0] for row in found] == list(range(1, len(found) + 1))


def test_as_of_beyond_the_data_and_without_dates(facts):
    assert summary(facts(("2025-03", "A")), MAKE_KEYS, "2030-01-01").count() == 0
    assert summary(facts((None, "A")), MAKE_KEYS).count() == 0


def test_pages_follow_each_other(spark):
    ranked = with_rank(counts_frame(spark, tied_rows(250)), ("maker",))
    pages = [[rank for (rank,) in rows_of(page(ranked, n), "rank")] for n in range(4)]
    assert pages == [
        list(range(1, 101)),
        list(range(101, 201)),
        list(range(201, 252)),
        [],
    ]
