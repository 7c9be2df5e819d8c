"""Folders of a table stored by month, and replacing some or all of them as a whole.

New months are written beside the table, in a folder that readers of the table pass over. Only when
all of them are complete does the folder get a name that says so, in one rename, and then its
months are moved into their places. A job that is broken off before has changed nothing; one that is
broken off in the middle of the moves is finished by the next ``finish_replacing``, which every
write begins with. A table has one writer at a time.
"""

import datetime as dt
import hashlib
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

from tallytide.shared import files_of

# Fixed value: Spark's name of the partition of rows without a value.
NO_VALUE = "__HIVE_DEFAULT_PARTITION__"
_READY = "_ready"


class _Files:
    """What is done with files and folders below one path, in Spark's file system."""

    def __init__(self, spark: SparkSession, path: str):
        self._files, _ = files_of(spark, path)
        self.path = path
        self._class = spark.sparkContext._jvm.org.apache.hadoop.fs.Path

    def names(self, folder: str = "") -> list[str]:
        """Names of what lies in a folder; none if it does not exist."""
        place = self._class(f"{self.path}/{folder}".rstrip("/"))
        if not self._files.exists(place):
            return []
        return sorted(entry.getPath().getName() for entry in self._files.listStatus(place))

    def move(self, source: str, target: str) -> None:
        new = self._class(f"{self.path}/{target}")
        if "/" in target:
            self._files.mkdirs(new.getParent())
        if not self._files.rename(self._class(f"{self.path}/{source}"), new):
            raise OSError(f"{source} cannot be renamed to {target} in {self.path}")

    def delete(self, name: str) -> None:
        self._files.delete(self._class(f"{self.path}/{name}"), True)


def _visible(names: list[str]) -> list[str]:
    return [name for name in names if not name.startswith(("_", "."))]


def stored_months(
    spark: SparkSession, path: str, date: str = "date_reg"
) -> list[dt.date | None]:
    """Months that a table stored by ``date`` has, from the names of its folders alone.

    Rows without a date are the month None, which comes last. No file is opened.
    """
    names = [name.partition("=") for name in _Files(spark, path).names()]
    values = [value for column, _, value in names if column == date]
    known = sorted(dt.date.fromisoformat(value) for value in values if value != NO_VALUE)
    return known + [None] * (NO_VALUE in values)


def month_files(
    spark: SparkSession, path: str, date: str = "date_reg"
) -> dict[dt.date | None, str]:
    """A digest of the names of each stored month's files.

    Every write gives its files new names, so the digest tells whether a month was written again.
    """
    files = _Files(spark, path)
    found = {}
    for month in stored_months(spark, path, date):
        folder = f"{date}={NO_VALUE if month is None else month.isoformat()}"
        names = "\n".join(_visible(files.names(folder)))
        found[month] = hashlib.sha256(names.encode()).hexdigest()
    return found


def drop_months(
    spark: SparkSession, path: str, months: Iterable[dt.date | None], date: str = "date_reg"
) -> None:
    """Delete months of a stored table."""
    files = _Files(spark, path)
    for month in months:
        files.delete(f"{date}={NO_VALUE if month is None else month.isoformat()}")


def finish_replacing(spark: SparkSession, path: str) -> None:
    """Finish what broken off jobs have left: complete months go to their places, others go.

    Doing it again changes nothing, and neither does another break and another call.
    """
    files = _Files(spark, path)
    names = files.names()
    for name in names:
        if name.startswith("_incoming-"):
            files.delete(name)
    for name in names:
        if not name.startswith(f"{_READY}-"):
            continue
        _, kind, number = name.split("-")
        replaced = f"_replaced-{number}"
        coming, stored = _visible(files.names(name)), _visible(files.names())
        if kind == "table":
            # Months that do not come again go first; then it is like a replacement of months.
            for old in stored:
                if old not in coming:
                    files.move(old, f"{replaced}/{old}")
            files.move(name, name := f"{_READY}-months-{number}")
        for new in coming:
            if new in stored:
                files.move(new, f"{replaced}/{new}")
            files.move(f"{name}/{new}", new)
        files.delete(name)
    for name in files.names():
        if name.startswith("_replaced-"):
            files.delete(name)


def replace_months(table: DataFrame, path: str, date: str, others: bool = True) -> None:
    """Write ``table`` by ``date`` in place of the months it has; with ``others``, of all months.

    Months that ``table`` does not have keep their files untouched unless ``others`` is set.
    """
    spark = table.sparkSession
    finish_replacing(spark, path)
    number = uuid.uuid4().hex
    files, incoming = _Files(spark, path), f"_incoming-{number}"
    try:
        table.write.partitionBy(date).parquet(f"{path}/{incoming}")
    except Exception:
        files.delete(incoming)
        raise
    files.move(incoming, f"{_READY}-{'table' if others else 'months'}-{number}")
    finish_replacing(spark, path)
