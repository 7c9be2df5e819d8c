"""Reading parts of a finished table: preview, page and column filters."""

import re
from collections.abc import Mapping
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, functions as F


def preview(table: DataFrame, n: int = 6) -> DataFrame:
    """``n`` rows; which ones is undefined unless ``table`` is sorted."""
    return table.limit(n)


def page(table: DataFrame, number: int = 0, size: int = 100, rank: str = "rank") -> DataFrame:
    """One page of a ranked table, in rank order; pages count from 0."""
    first = number * size + 1
    return table.where(F.col(rank).between(first, first + size - 1)).orderBy(rank)


def filter_columns(
    table: DataFrame, criteria: Mapping[str, str | tuple[float | None, float | None]]
) -> DataFrame:
    """Rows meeting every criterion; ranks keep their values.

    A string looks for each of its words, or its quoted phrases, anywhere in a text
    column, ignoring case. A pair is a closed range of a number column, with ``None`` for
    an open end.
    """

    def meets(name: str, criterion) -> list[Column]:
        column = F.col(f"`{name}`")
        if isinstance(criterion, str):
            words = (word.strip('"') for word in re.findall(r'"[^"]*"|\S+', criterion))
            return [F.lower(column).contains(word.lower()) for word in words]
        low, high = criterion
        bounds = [column >= low] if low is not None else []
        return bounds + ([column <= high] if high is not None else [])

    conditions = [c for name, criterion in criteria.items() for c in meets(name, criterion)]
    return table.where(reduce(and_, conditions)) if conditions else table
