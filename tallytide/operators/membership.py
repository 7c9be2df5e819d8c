"""Joins of a large table to a list of keys. Null keys match each other.

The list stays a table. Spark knows the size of a limited one and picks the join from it.
"""

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame


def _joined(table: DataFrame, members: DataFrame, keys: Sequence[str], how: str) -> DataFrame:
    renamed = members.withColumnsRenamed({key: f"_member_{key}" for key in keys})
    same = (table[key].eqNullSafe(renamed[f"_member_{key}"]) for key in keys)
    joined = table.join(renamed, reduce(and_, same), how)
    return joined.drop(*(f"_member_{key}" for key in keys))


def keep_members(table: DataFrame, members: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of ``table`` whose keys are among ``members``; repeated members change nothing."""
    return _joined(table, members.select(*keys), keys, "left_semi")


def attach_members(table: DataFrame, members: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Inner join of ``table`` to ``members``; a repeated member repeats the matching rows."""
    return _joined(table, members, keys, "inner")
