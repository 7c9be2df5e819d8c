"""Removal of long strings that occur before, by refining buckets of positions.

A string of ``LENGTH`` bytes that also starts earlier (in a document with a smaller id, or earlier
in the same one) is removed wherever it starts again. The positions at which such strings start are
put in buckets of equal beginnings, and the buckets are refined until all of a bucket's
strings are equal; the first position of each bucket stays.

* The first buckets are those of a string's least ``GRAM``-gram by hash. Neighbouring strings
  mostly have the same one, so one row stands for a run of positions, about one in 27 bytes, and all
  strings that are equal are in the same bucket.
* A bucket of one row is done. In the others, rows are sorted by the identifier of all their
  bytes up to the end of the run's last string: runs equal to an earlier one are repeats at all
  their positions, and are not looked at again.
* What is left are first runs of buckets with several kinds. Their positions are refined one by
  one, by the identifier of the bucket of the first half of the string, and that of the bucket at the
  later offset where its second half begins; the identifiers of a document are computed once and
  used as first and as later ones.
* Rows are sorted by range, in an order in which no two are equal: a frequent string is cut
  between tasks like any other rows, none is counted against all others, and nothing is gathered
  by bucket. Where a range begins, what its first row continues is not known: in the first sort
  such rows go on to the second, where the ends of all ranges are compared, one row per range.

Bytes are hashed by random 64-bit numbers and a polynomial; two identifiers of 64 bits decide.
Null and empty texts have no bytes. Rows that repeat an id are documents of their own, in the order
of a hash of their texts; of equal rows of one id, the first stays. Rows without an id come before all
others. Matches never cross documents. Further columns are ignored.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F

from tallytide.llm.common import importable, map_batches, written

LENGTH = 100
GRAM = 50
# Bytes hashed at a time. Longer texts are taken in pieces.
PIECE = 1 << 20
# Rows looked at together in a sorted range.
CHUNK = 1 << 17

_BASE = 0x9E3779B97F4A7C15
_VALUES = np.random.default_rng(20).integers(0, 1 << 64, 256, dtype=np.uint64)


def _powers(base: int, n: int) -> np.ndarray:
    found = np.ones(n, np.uint64)
    known = 1
    while known < n:
        more = min(known, n - known)
        found[known : known + more] = found[:more] * np.uint64(pow(base, known, 1 << 64))
        known += more
    return found


# The bits of a hash that give way to a place in a piece.
_PLACE = np.uint64((1 << 21) - 1)
_MOST = int(_PLACE)
_UP = _powers(_BASE, _MOST)
_DOWN = _powers(pow(_BASE, -1, 1 << 64), _MOST)


def _mixed(values: np.ndarray) -> np.ndarray:
    values = values ^ (values >> np.uint64(31))
    values = values * np.uint64(0xBF58476D1CE4E5B9)
    return values ^ (values >> np.uint64(29))


class Hashes:
    """Identifiers of all substrings of up to ``PIECE`` bytes and a little more."""

    def __init__(self, data: np.ndarray):
        self._sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_VALUES[data] * _DOWN[: len(data)], out=self._sums[1:])

    def of(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mixed((self._sums[end] - self._sums[begin]) * _UP[begin])

    def grams(self, size: int) -> np.ndarray:
        """Those of all substrings of one size, by position."""
        n = len(self._sums) - size
        return _mixed((self._sums[size:] - self._sums[:n]) * _UP[:n]) if n > 0 else self._sums[:0]


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of every ``width`` values that follow each other."""
    known = 1
    n = len(values) - width + 1
    while 2 * known <= width:
        values = np.minimum(values[:-known], values[known:])
        known *= 2
    return np.minimum(values[:n], values[width - known : width - known + n])


def _pieces(texts: list[bytes], length: int):
    """Texts of at least ``length`` bytes, joined to about ``PIECE`` bytes or cut into pieces of that.

    Gives (numbers of the texts, offsets of the pieces in their texts, sizes, bytes). Pieces of a
    text overlap by less than ``length``, so each string of that length is in exactly one.
    """
    held: tuple[list, list, list, list] = ([], [], [], [])
    total = 0
    for number, text in enumerate(texts):
        for offset in range(0, len(text) - length + 1, PIECE):
            piece = text[offset : offset + PIECE + length - 1]
            if total + len(piece) > PIECE + length:
                yield held
                held, total = ([], [], [], []), 0
            for values, value in zip(held, (number, offset, len(piece), piece)):
                values.append(value)
            total += len(piece)
    if total:
        yield held


def _bytes_of(column: pa.Array) -> list[bytes]:
    return [value or b"" for value in column.cast(pa.binary()).to_pylist()]


def _runs(length: int, gram: int):
    """Runs of positions with one least gram: its identifier, that of their bytes, first and last.

    ``own`` says whether strings of one run may be equal: only if their least grams lie in
    different places. Text of one repeated letter is still one run.
    """

    def run(batch: pa.RecordBatch) -> list:
        rows, buckets, wholes, firsts, lasts, owns = [], [], [], [], [], []
        for numbers, offsets, sizes, pieces in _pieces(_bytes_of(batch.column("text")), length):
            data = np.frombuffer(b"".join(pieces), np.uint8)
            hashes = Hashes(data)
            grams = hashes.grams(gram)
            # The least gram of each string, the leftmost one if there are several.
            placed = (grams & ~_PLACE) | np.arange(len(grams), dtype=np.uint64)
            leftmost = _least(placed, length - gram + 1) & _PLACE
            begins = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            piece = np.repeat(np.arange(len(sizes)), np.subtract(sizes, length - 1))
            ends = np.cumsum(np.subtract(sizes, length - 1))
            at = np.arange(ends[-1]) + (begins - (ends - np.subtract(sizes, length - 1)))[piece]
            gram_at = leftmost[at]
            value = grams[gram_at]
            new = np.flatnonzero((value[1:] != value[:-1]) | (piece[1:] != piece[:-1])) + 1
            new = np.concatenate([[0], new])
            end = np.concatenate([new[1:] - 1, [len(at) - 1]])
            first, last = at[new], at[end]
            in_text = (np.asarray(offsets) - begins)[piece[new]]
            rows.append(np.asarray(numbers)[piece[new]])
            buckets.append(value[new])
            wholes.append(hashes.of(first, last + length))
            firsts.append(first + in_text)
            lasts.append(last + in_text)
            owns.append(gram_at[new] != gram_at[end])
        none = [np.zeros(0, np.uint64)]
        rows = np.concatenate(rows or none).astype(np.int64)
        return [
            pa.array(np.concatenate(buckets or none).view(np.int64)),
            pa.array(np.concatenate(wholes or none).view(np.int64)),
            batch.column("doc_id").take(pa.array(rows)),
            batch.column("part").take(pa.array(rows)),
            pa.array(np.concatenate(firsts or none).astype(np.int32)),
            pa.array(np.concatenate(lasts or none).astype(np.int32)),
            pa.array(np.concatenate(owns or none).astype(bool)),
        ]

    return run


def _chunks(batches):
    """Record batches of about ``CHUNK`` rows."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= CHUNK:
            yield pa.Table.from_batches(held).combine_chunks()
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held).combine_chunks()


def _numbers(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).to_numpy()


def _as_batches(table: pa.Table, mask: np.ndarray, **more: pa.Scalar):
    """The marked rows' places, with further constant columns."""
    found = table.select(["doc_id", "part", "first", "last"]).filter(pa.array(mask))
    for name, value in more.items():
        found = found.append_column(name, pa.repeat(value, found.num_rows))
    return found.to_batches()


def _sort_runs(batches):
    """Sorted runs as repeats, and as those whose positions are to be refined.

    In the first and the last bucket of a range all kinds are refined, elsewhere those of buckets with
    several, and runs that may repeat themselves.
    """
    repeat, refine = pa.scalar(True), pa.scalar(False)
    bucket = whole = None
    # Kinds in the bucket that goes on, and its first one while it is the only one.
    seen, pending = 2, []
    for table in _chunks(batches):
        buckets, wholes, own = (_numbers(table, name) for name in ("bucket", "whole", "own"))
        other, kind = np.zeros((2, len(buckets)), bool)
        other[1:], kind[1:] = buckets[1:] != buckets[:-1], wholes[1:] != wholes[:-1]
        if bucket is None:
            kind[0] = True
        else:
            other[0], kind[0] = buckets[0] != bucket, wholes[0] != whole
        kind |= other
        group = np.cumsum(other)
        kinds = np.bincount(group, weights=kind)
        # Group 0 goes on from before.
        kinds[0] += seen
        if kinds[0] > 1:
            yield from pending
        marked = kind & ((kinds[group] > 1) | own)
        yield from _as_batches(table, ~kind, repeat=repeat)
        yield from _as_batches(table, marked, repeat=refine)
        if kinds[-1] > 1:
            pending = []
        elif group[-1] > 0 or not seen:
            at = int(np.flatnonzero(kind)[-1])
            pending = [] if own[at] else _as_batches(table.slice(at, 1), np.ones(1, bool), repeat=refine)
        seen = kinds[-1]
        bucket, whole = buckets[-1], wholes[-1]
    yield from pending


def _intervals(places: pa.ListScalar) -> tuple[np.ndarray, np.ndarray]:
    """Begins and ends (exclusive) of a list of first and last places."""
    if not places.is_valid:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first, last = (places.values.field(name).to_numpy().astype(np.int64) for name in ("first", "last"))
    return first, last + 1


def _covered(begins: np.ndarray, ends: np.ndarray, offset: int, size: int) -> np.ndarray:
    """Which of ``size`` places from ``offset`` on lie in an interval."""
    inside = (ends > offset) & (begins < offset + size)
    change = np.zeros(size + 1, np.int32)
    np.add.at(change, np.maximum(begins[inside] - offset, 0), 1)
    np.add.at(change, np.minimum(ends[inside] - offset, size), -1)
    return np.cumsum(change[:-1]) > 0


def _positions(length: int):
    """Positions of the runs to be refined, with the identifiers of both halves of their strings."""
    half = length // 2

    def run(batch: pa.RecordBatch) -> list:
        rows, keys, laters, firsts = [], [], [], []
        runs = [_intervals(one) for one in batch.column("runs")]
        for numbers, offsets, sizes, pieces in _pieces(_bytes_of(batch.column("text")), length):
            hashes = Hashes(np.frombuffer(b"".join(pieces), np.uint8))
            begin = 0
            for number, offset, size in zip(numbers, offsets, sizes):
                local = np.flatnonzero(_covered(*runs[number], offset, size - length + 1))
                at = local + begin
                rows.append(np.full(len(at), number))
                keys.append(hashes.of(at, at + half))
                laters.append(hashes.of(at + half, at + length))
                firsts.append(local + offset)
                begin += size
        none = [np.zeros(0, np.uint64)]
        rows = np.concatenate(rows or none).astype(np.int64)
        return [
            pa.array(np.concatenate(keys or none).view(np.int64)),
            pa.array(np.concatenate(laters or none).view(np.int64)),
            batch.column("doc_id").take(pa.array(rows)),
            batch.column("part").take(pa.array(rows)),
            pa.array(np.concatenate(firsts or none).astype(np.int32)),
        ]

    return run


def _sort_positions(batches):
    """Sorted positions as repeats, and the first row and last key of the range."""
    number = TaskContext.get().partitionId()
    begin = last = None
    types = (("range", pa.int32()), ("key", pa.int64()), ("later", pa.int64()), ("end_key", pa.int64()), ("end_later", pa.int64()))
    none = {name: pa.scalar(None, kind) for name, kind in types}
    for table in _chunks(batches):
        keys, laters = _numbers(table, "key"), _numbers(table, "later")
        same = np.zeros(len(keys), bool)
        same[1:] = (keys[1:] == keys[:-1]) & (laters[1:] == laters[:-1])
        if last is None:
            begin = (table.slice(0, 1), keys[0], laters[0])
        else:
            same[0] = (keys[0], laters[0]) == last
        last = (keys[-1], laters[-1])
        table = table.append_column("last", table.column("first"))
        yield from _as_batches(table, same, **none)
    if begin is not None:
        row, key, later = begin
        values = zip(none, (number, key, later, *last), (kind for _, kind in types))
        ends = {name: pa.scalar(int(value), kind) for name, value, kind in values}
        yield from _as_batches(row.append_column("last", row.column("first")), np.ones(1, bool), **ends)


def _same_row(left: str, right: str) -> Column:
    return F.col(f"{left}.doc_id").eqNullSafe(F.col(f"{right}.doc_id")) & (
        F.col(f"{left}.part") == F.col(f"{right}.part")
    )


def _by_document(places: DataFrame, name: str) -> DataFrame:
    """Lists of (first, last), as many as a document has runs or positions at most."""
    return places.groupBy("doc_id", "part").agg(F.collect_list(F.struct("first", "last")).alias(name))


def _documents(docs: DataFrame) -> DataFrame:
    """(doc_id, part, text, copies): one row per id and text; ``part`` is 0 if the id is unique."""
    docs = docs.select(F.col("doc_id").cast("bigint"), F.coalesce("text", F.lit("")).alias("text"))
    counts = docs.groupBy("doc_id").agg(F.count("*").alias("n"))
    again = written(counts.where("n > 1 OR doc_id IS NULL").select("doc_id"))
    same = F.col("d.doc_id").eqNullSafe(F.col("a.doc_id"))
    single = docs.alias("d").join(again.alias("a"), same, "left_anti")
    several = (
        docs.alias("d")
        .join(again.alias("a"), same, "left_semi")
        .groupBy("doc_id", F.xxhash64("text").alias("part"), "text")
        .agg(F.count("*").alias("copies"))
    )
    one = F.lit(1).cast("bigint")
    return single.select("doc_id", F.lit(0).cast("bigint").alias("part"), "text", one.alias("copies")).unionAll(
        written(several.select("doc_id", "part", "text", "copies"))
    )


def repeated_positions(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(doc_id, part, first, last): positions of strings that also start earlier.

    ``docs`` has one row (doc_id, part, text) per document; documents stand in that order.
    """
    importable(docs.sparkSession)
    order = [F.asc_nulls_first("doc_id"), "part", "first"]
    runs = map_batches(
        docs.select("doc_id", "part", "text"),
        _runs(length, gram),
        "bucket bigint, whole bigint, doc_id bigint, part bigint, first int, last int, own boolean",
    )
    place = "doc_id bigint, part bigint, first int, last int"
    sorted_runs = written(runs.orderBy("bucket", "whole", *order).mapInArrow(_sort_runs, f"{place}, repeat boolean"))
    refined = _by_document(sorted_runs.where("NOT repeat"), "runs")
    texts = docs.alias("d").join(refined.alias("r"), _same_row("d", "r"))
    positions = map_batches(
        texts.select("d.doc_id", "d.part", "d.text", "r.runs"),
        _positions(length),
        "key bigint, later bigint, doc_id bigint, part bigint, first int",
    )
    ends = "range int, key bigint, later bigint, end_key bigint, end_later bigint"
    found = written(positions.orderBy("key", "later", *order).mapInArrow(_sort_positions, f"{place}, {ends}"))
    # One row per range; its first row is a repeat if the range before ends with the same key.
    previous = Window.orderBy("range")
    edges = (
        found.where("range IS NOT NULL")
        .withColumns({name: F.lag(name).over(previous) for name in ("end_key", "end_later")})
        .where("key = end_key AND later = end_later")
    )
    columns = ("doc_id", "part", "first", "last")
    parts = (sorted_runs.where("repeat"), found.where("range IS NULL"), edges)
    return reduce(DataFrame.unionAll, (part.select(*columns) for part in parts))


def _cut(length: int):
    """Texts without the repeated strings, and what was cut out."""

    def run(batch: pa.RecordBatch) -> list:
        sizes, kept, spans = [], [], []
        for text, places in zip(_bytes_of(batch.column("text")), batch.column("places")):
            begins, ends = _intervals(places)
            gone = _covered(begins, ends + length - 1, 0, len(text))
            edge = np.flatnonzero(np.diff(gone, prepend=False, append=False)).tolist() if len(text) else []
            sizes.append(len(text))
            kept.append(np.frombuffer(text, np.uint8)[~gone].tobytes())
            spans.append([{"begin": a, "end": b} for a, b in zip(edge[::2], edge[1::2])])
        span = pa.struct([("begin", pa.int64()), ("end", pa.int64())])
        return [
            batch.column("doc_id"),
            batch.column("copies"),
            pa.array(sizes, pa.int64()),
            pa.array(kept, pa.binary()),
            pa.array(spans, pa.list_(span)),
        ]

    return run


def without_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): its bytes without those of repeated strings of
    ``length`` bytes, and the spans of bytes that were cut out.

    ``gram`` is the size of the first buckets' beginnings, below ``length``.
    """
    rows = _documents(docs)
    places = _by_document(repeated_positions(rows, length, gram), "places")
    joined = rows.alias("d").join(places.alias("p"), _same_row("d", "p"), "left")
    cut = map_batches(
        joined.select("d.doc_id", "d.copies", "d.text", "p.places"),
        _cut(length),
        "doc_id bigint|copies bigint|n_bytes bigint|kept binary|spans array<struct<begin:bigint,end:bigint>>",
        between="|",
    )
    # Further copies of a row go as a whole, unless they are too short.
    again = (F.col("copy") > 1) & (F.col("n_bytes") >= length)
    whole = F.array(F.struct(F.lit(0).cast("bigint").alias("begin"), F.col("n_bytes").alias("end")))
    return cut.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("bigint"), "copies"))).select(
        "doc_id",
        "n_bytes",
        F.when(again, F.lit(b"")).otherwise(F.col("kept")).alias("kept"),
        F.when(again, whole).otherwise(F.col("spans")).alias("spans"),
    )


def digests(result: DataFrame) -> DataFrame:
    """Sizes and hashes of what ``without_repeats`` gives."""
    return result.select(
        "doc_id",
        "n_bytes",
        (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"),
        F.size("spans").cast("bigint").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )
