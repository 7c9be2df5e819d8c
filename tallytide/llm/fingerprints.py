"""Winnowing fingerprints of documents.

Every run of ``gram`` code points is hashed; of every ``window`` successive hashes the smallest
is selected, the rightmost one of equals. So any passage of ``gram + window - 1`` code points
that two texts share puts at least one common hash into both fingerprints. The hash of a run
comes from those of its halves, so a whole text is hashed in a few array operations.

Both are smaller for a short text, so that two thirds of it, rounded up, are always such a
passage: windows from 93 code points downwards, runs below 17. Runs of texts that short match
only those of equal length. Null is the empty text, whose fingerprint is empty.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tallytide.llm.common import importable

GRAM = 12
WINDOW = 52

_BASE = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def gram_hashes(points: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """32-bit hash of every run of ``gram`` code points; of the whole text if it is shorter."""
    gram = min(gram, len(points))
    if gram == 0:
        return np.empty(0, np.uint32)
    power, size = points.astype(np.uint64) + np.uint64(1), 1
    total, done = None, 0
    n = len(points)
    with np.errstate(over="ignore"):
        while True:
            # ``power`` holds the hashes of all runs of ``size``; the bits of ``gram`` pick runs.
            if gram & size:
                if total is None:
                    total, done = power, size
                else:
                    shift = np.uint64(pow(_BASE, size, 1 << 64))
                    count = n - done - size + 1
                    total = total[:count] * shift + power[done : done + count]
                    done += size
            if done == gram:
                break
            shift = np.uint64(pow(_BASE, size, 1 << 64))
            power = power[:-size] * shift + power[size:]
            size *= 2
        total = (total ^ (total >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return (total >> np.uint64(32)).astype(np.uint32)


def widths(n: int) -> tuple[int, int]:
    """(gram, window) of a text of ``n`` code points."""
    unchanged = max(1, n - n // 3)
    gram = min(GRAM, unchanged)
    return gram, min(WINDOW, unchanged - gram + 1)


def winnow(
    text: str, gram: int | None = None, window: int | None = None
) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, positions) of the selected runs, in the order of the text."""
    points = code_points(text)
    own = widths(len(points))
    gram, window = gram or own[0], window or own[1]
    hashes = gram_hashes(points, gram)
    n = len(hashes)
    if n == 0:
        return hashes, np.empty(0, np.int64)
    # Hash above, distance to the end below: the minimum is the rightmost smallest hash.
    from_end = np.arange(n - 1, -1, -1, dtype=np.uint64)
    least = (hashes.astype(np.uint64) << np.uint64(32)) | from_end
    width, size = min(window, n), 1
    while size * 2 <= width:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    if size < width:
        least = np.minimum(least[: n - width + 1], least[width - size :])
    chosen = least[np.concatenate([[True], least[1:] != least[:-1]])]
    positions = n - 1 - (chosen & np.uint64(0xFFFFFFFF)).astype(np.int64)
    return (chosen >> np.uint64(32)).astype(np.uint32), positions


def as_text(hashes: np.ndarray, positions: np.ndarray) -> str:
    """``hash:position`` pairs, hash in hexadecimal, comma-joined."""
    return ",".join(map("%08x:%d".__mod__, zip(hashes.tolist(), positions.tolist())))


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of common hashes among all hashes of two fingerprints; 1 if both are empty."""
    if not len(a) and not len(b):
        return 1.0
    a, b = np.unique(a), np.unique(b)
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def fingerprints(
    docs: DataFrame, id: str = "doc_id", text: str = "text", gram: int | None = None,
    window: int | None = None,
) -> DataFrame:
    """(doc_id, fingerprint) of every row."""
    from tallytide.llm.common import map_batches, texts_of

    def columns(batch: pa.RecordBatch) -> list:
        marks = [as_text(*winnow(t, gram, window)) for t in texts_of(batch.column(1))]
        return [batch.column(0), pa.array(marks, pa.string())]

    return map_batches(
        docs.select(F.col(id).cast("bigint").alias("doc_id"), F.col(text).alias("text")),
        columns,
        "doc_id bigint, fingerprint string",
    )


def edited(text: str, following: str) -> str:
    """``text`` with its last third replaced by as much of the start of the next text."""
    size = len(text) // 3
    return text[: len(text) - size] + following[:size]


def compared_with_next(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of each document and of its edited text, and how alike they are.

    The next document is the one with the next smaller id; after the last comes the first.
    Rows of equal id follow each other in the order of their texts; rows without an id come
    last. Ids are cut into ranges; the first row of a range is added to the range before it,
    so that every row meets its next one in one sorted pass. Texts are shuffled once.
    """
    spark = docs.sparkSession
    importable(spark)
    rows = docs.select(
        F.col(id).cast("bigint").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")
    )
    # Rows without an id sort below all others.
    rows = rows.withColumn("key", F.coalesce("doc_id", F.lit(-(2**63))))
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = rows.agg(
        F.percentile_approx("key", [i / ranges for i in range(1, ranges)], 100 * ranges).alias("cuts")
    ).first()["cuts"]
    cuts = sorted(set(cuts or []))
    # Range 0 holds the largest ids.
    above = F.filter(F.array(*map(F.lit, cuts)), lambda cut: cut >= F.col("key"))
    rows = rows.withColumn("part", F.size(above) if cuts else F.lit(0))
    # The first row of every range: its largest key, and of equal keys the smallest text.
    keys = rows.groupBy("part").agg(F.max("key").alias("key"))
    first = [(r["part"], r["key"]) for r in keys.orderBy("part").collect()]
    heads = spark.createDataFrame(
        [(first[i - 1][0], p, k) for i, (p, k) in enumerate(first)] or [(None, None, None)],
        "before int, part int, key bigint",
    )
    copies = (
        rows.join(F.broadcast(heads), ["part", "key"])
        .groupBy("before")
        .agg(F.min("text").alias("text"))
        .select(
            F.lit(None).cast("bigint").alias("doc_id"), "text",
            F.lit(-(2**63)).alias("key"), F.col("before").alias("part"), F.lit(True).alias("copy"),
        )
    )
    ordered = (
        rows.withColumn("copy", F.lit(False))
        .unionByName(copies)
        .repartitionByRange(max(1, len(first)), "part")
        .sortWithinPartitions("part", F.desc("key"), "copy", "text")
        .select("doc_id", "text", "copy")
    )

    def pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, marks = None, None
        for batch in batches:
            out = []
            for doc, value, copy in zip(*(c.to_pylist() for c in batch.columns)):
                hashes, positions = winnow(value)
                if waiting is not None:
                    other = edited(waiting[1], value)
                    changed = winnow(other)
                    out.append(
                        (
                            waiting[0],
                            len(waiting[1]),
                            hashlib.sha256(other.encode("utf-8", "surrogatepass")).hexdigest(),
                            as_text(*marks),
                            as_text(*changed),
                            likeness(marks[0], changed[0]),
                            likeness(marks[0], hashes),
                        )
                    )
                waiting, marks = (None, None) if copy else ((doc, value), (hashes, positions))
            if out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(column, kind) for column, kind in zip(zip(*out), kinds)], names=names
                )

    names = (
        "doc_id n_chars edited_sha256 fingerprint edited_fingerprint near_edited near_next"
    ).split()
    kinds = [pa.int64(), pa.int64(), *[pa.string()] * 3, *[pa.float64()] * 2]
    types = ("bigint", "bigint", *["string"] * 3, *["double"] * 2)
    return ordered.mapInArrow(pair, ", ".join(map(" ".join, zip(names, types))))
