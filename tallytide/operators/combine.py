"""Union of tables, and distinct or sorted keys."""

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import DataFrame, functions as F


# Number types by size: a smaller one fits a larger one of its row without loss.
_SIZES = (("tinyint", "smallint", "int", "bigint"), ("float", "double"))


def _common(types: Sequence[str]) -> str | None:
    """The type that holds values of all ``types`` without changing any; None if there is none."""
    known = set(types) - {"void"}
    if len(known) <= 1:
        return next(iter(known), "void")
    for sizes in _SIZES:
        if known <= set(sizes):
            return max(known, key=sizes.index)
    return None


def union_by_name(tables: Iterable[DataFrame], on_conflict: str = "error") -> DataFrame:
    """All rows of all tables, matched by column name; a missing column is null.

    Columns of one name must have one type, or number types of which one holds the others' values.
    Otherwise a ``TypeError`` names the column and its types, when called and before any row is
    read; no value is ever changed silently. ``on_conflict="text"`` makes such a column text
    in all tables, with every value as it is shown.
    """
    tables = list(tables)
    if on_conflict not in ("error", "text"):
        raise ValueError(f"on_conflict is {on_conflict!r}, not 'error' or 'text'")
    types: dict[str, list[str]] = {}
    for table in tables:
        for name, kind in table.dtypes:
            types.setdefault(name, []).append(kind)
    common = {name: _common(kinds) for name, kinds in types.items()}
    torn = {name: kinds for name, kinds in types.items() if common[name] is None}
    if torn and on_conflict == "error":
        columns = "; ".join(f"{name} is {', '.join(dict.fromkeys(kinds))}" for name, kinds in torn.items())
        raise TypeError(f"tables differ in types: {columns}")
    texts = {name: F.col(f"`{name}`").cast("string") for name in torn}
    aligned = (
        table.withColumns({name: text for name, text in texts.items() if name in table.columns})
        for table in tables
    )
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), aligned)


def distinct_keys(table: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The key combinations that occur."""
    return table.select(*keys).distinct()


def sorted_by_keys(table: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows in ascending key order, nulls last."""
    return table.orderBy(*(F.asc_nulls_last(key) for key in keys))
