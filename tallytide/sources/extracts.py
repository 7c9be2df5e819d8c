"""Raw CSV extracts."""

import csv
from collections.abc import Iterator, Sequence
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import DateType, StringType, StructField, StructType

from tallytide.operators.combine import union_by_name
from tallytide.shared import files_of

# Columns of an extract.
EXTRACT_SCHEMA = StructType(
    [
        StructField("date_reg", DateType()),
        StructField("maker", StringType()),
        StructField("model", StringType()),
        StructField("fuel", StringType()),
    ]
)

# Rows that do not fit, as they stand in their file.
REJECT_SCHEMA = StructType([StructField(name, StringType()) for name in ("file", "text", "reason")])
_UNFIT = "_unfit"

# Empty and NA, quoted or not, are null; text is trimmed; a doubled quote is a quote.
CSV_OPTIONS = {
    "header": True,
    "nullValue": "NA",
    "emptyValue": "NA",
    "escape": '"',
    "ignoreLeadingWhiteSpace": True,
    "ignoreTrailingWhiteSpace": True,
}


def first_lines(spark: SparkSession, paths: Sequence[str], lines: int = 20) -> dict[str, list[str]]:
    """The first lines of every file of ``paths``, by file, from one job.

    Each file is a task that stops reading after its first lines. The driver gets these lines only.
    """

    def head(batches: Iterator) -> Iterator:
        # A file is one task here: the first rows of the task are those of its file.
        for batch in batches:
            if batch.num_rows:
                yield batch.slice(0, lines)
                return

    # Settings of a session of its own, which keep files apart and whole.
    session = spark.newSession()
    for name in ("spark.sql.files.openCostInBytes", "spark.sql.files.maxPartitionBytes"):
        session.conf.set(name, str(1 << 50))
    session.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(lines))
    found: dict[str, list[str]] = {}
    text = session.read.text(list(paths)).select(F.col("_metadata.file_path").alias("file"), "value")
    for row in text.mapInArrow(head, "file string, value string").collect():
        found.setdefault(unquote(row["file"]), []).append(row["value"])
    return found


def _names(lines: list[str]) -> tuple[str, ...]:
    """Columns that the header in a file's first lines names, as Spark names them."""
    (first,) = list(csv.reader([line + "\n" for line in lines]))[:1] or ((),)
    names: list[str] = []
    values = [value.removeprefix("\ufeff").strip() for value in first]
    lowered = [value.lower() for value in values]
    for place, value in enumerate(values):
        if value in ("", "NA"):
            names.append(f"_c{place}")
        elif lowered.count(value.lower()) > 1:
            names.append(f"{value}{place}")
        else:
            names.append(value)
    return tuple(names)


def headers(spark: SparkSession, paths: Sequence[str]) -> dict[str, tuple[str, ...]]:
    """The header of every path, for all of them from one job.

    A path may be a file, a folder or a pattern; files without a line have no header, and a path
    without any other is left out. Files of one path with different headers are an error.
    """
    if not paths:
        return {}
    by_file = {file: _names(lines) for file, lines in first_lines(spark, paths).items()}
    names = sorted(by_file)
    found: dict[str, tuple[str, ...]] = {}
    roots = {}
    for path in paths:
        files, pattern = files_of(spark, path)
        for entry in files.globStatus(pattern) or ():
            roots[unquote(entry.getPath().toUri().getPath())] = path
    for file in names:
        # The longest of the file's folders that is a given path, or the file itself.
        place = _without_scheme(file)
        while place not in roots and "/" in place:
            place = place.rpartition("/")[0]
        path = roots[place]
        if found.setdefault(path, by_file[file]) != by_file[file]:
            raise ValueError(
                f"CSV header does not conform to that of other files of {path}: {file} has"
                f" {', '.join(by_file[file])}, others have {', '.join(found[path])}"
            )
    return {path: found[path] for path in paths if path in found}


def _without_scheme(file: str) -> str:
    """The path of a file's address, without scheme and host."""
    scheme, colon, rest = file.partition(":")
    if not colon or "/" in scheme:
        return file
    return "/" + rest[2:].partition("/")[2] if rest.startswith("//") else rest


def _by_header(
    spark: SparkSession, paths: Sequence[str], header: Sequence[str] | None
) -> dict[tuple[str, ...], list[str]]:
    known = dict.fromkeys(paths, tuple(header)) if header else headers(spark, paths)
    groups: dict[tuple[str, ...], list[str]] = {}
    for path, names in known.items():
        groups.setdefault(names, []).append(path)
    return groups


def _fields(names: Sequence[str], schema: StructType) -> list[StructField]:
    types = {field.name: field.dataType for field in schema}
    return [StructField(name, types.get(name, StringType())) for name in names]


def read_extracts(
    spark: SparkSession,
    paths: Sequence[str],
    schema: StructType = EXTRACT_SCHEMA,
    multiline: bool = False,
    header: Sequence[str] | None = None,
) -> DataFrame:
    """All rows of the extracts, matched by column name.

    Columns of ``schema`` get the declared type and others are text; no data is read to
    guess types. Extracts may differ in columns and column order, but the files of one
    path must agree: a file with another header raises an error rather than shifting
    values. Extracts with the same header are read in one scan. What a row has too little, or what
    is not of its type, is null, and what it has too much is lost; ``split_extracts`` keeps
    such rows apart.

    ``multiline`` lets a quoted value hold line breaks; each file is then read by one task.
    One job reads the headers of all paths; ``header`` names the columns of all paths and saves it.
    """
    scans = [
        spark.read.options(**CSV_OPTIONS, enforceSchema=False, multiLine=multiline)
        .schema(StructType(_fields(names, schema)))
        .csv(group)
        for names, group in _by_header(spark, paths, header).items()
    ]
    return union_by_name(scans or [spark.createDataFrame([], schema)])


def split_extracts(
    spark: SparkSession,
    paths: Sequence[str],
    schema: StructType = EXTRACT_SCHEMA,
    multiline: bool = False,
    header: Sequence[str] | None = None,
    header_lines: bool = True,
) -> tuple[DataFrame, DataFrame]:
    """The rows of the extracts that fit, as ``read_extracts`` gives them, and the rejected ones.

    A row is rejected if it has more or fewer fields than its header, or a value that is not of its
    column's type. Rejected rows have their file, their text as it stands there, and the reason:
    ``fields``, or the name of the first column with such a value. Every row is in one of
    the two tables; a missing value is no reason. With ``header_lines=False`` files begin with a row,
    and ``header`` must name the columns.
    """
    if header is None and not header_lines:
        raise ValueError("files without header lines need a header")
    good, bad = [], []
    options = CSV_OPTIONS | {"columnNameOfCorruptRecord": _UNFIT, "multiLine": multiline}
    options["header"] = header_lines
    for names, group in _by_header(spark, paths, header).items():
        fields = _fields(names, schema)
        rows = (
            # With pruned columns fields would not be counted.
            spark.read.options(**options, enforceSchema=False, columnPruning=False)
            .schema(StructType([*fields, StructField(_UNFIT, StringType())]))
            .csv(group)
        )
        # Spark parses only columns that are asked for, so what is counted could fit while a column
        # nobody asked for does not. This is always true and asks for all that have a type.
        typed = {names[0], *(field.name for field in fields if field.dataType != StringType())}
        rows = rows.where(F.hash(*(F.col(f"`{name}`") for name in typed)) >= F.lit(-(1 << 31)))
        good.append(rows.where(F.col(_UNFIT).isNull()).drop(_UNFIT))
        texts = ", ".join(f"c{place} string" for place in range(len(names)))
        text = F.regexp_replace(_UNFIT, "[\r\n]+$", "")
        kept = {name: str(value) for name, value in options.items() if name != "header"}
        parsed = F.from_csv("text", f"{texts}, {_UNFIT} string", kept)
        reason = F.when(F.col(f"values.{_UNFIT}").isNotNull(), "fields")
        for place, field in enumerate(fields):
            if field.dataType != StringType():
                lost = F.col(f"values.c{place}").isNotNull() & F.col(f"read.{field.name}").isNull()
                reason = reason.when(lost, field.name)
        bad.append(
            rows.where(F.col(_UNFIT).isNotNull())
            .select(
                F.col("_metadata.file_path").alias("file"),
                text.alias("text"),
                F.struct(*(F.col(f"`{name}`") for name in names)).alias("read"),
            )
            .withColumn("values", parsed)
            .select("file", "text", reason.otherwise("fields").alias("reason"))
        )
    if not good:
        return spark.createDataFrame([], schema), spark.createDataFrame([], REJECT_SCHEMA)
    return union_by_name(good), union_by_name(bad)
