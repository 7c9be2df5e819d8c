"""Language of documents by rank-order profiles.

A profile lists the most frequent 1- to 3-grams of letters in order of frequency; what is no
letter counts as a word boundary. A document goes to the language whose profile is least out
of place: the sum, over the document's own list, of how far each n-gram is from its rank there,
or the length of the list for one that is missing. The score is one minus the mean distance
in parts of that length.

Profiles are learnt from labelled documents with the text alone, from about ``SAMPLE`` of each
language, picked by a hash of the id. Null texts and texts without a letter are ``und`` with
score 0; so is everything if nothing is labelled. Ties go to the first language by name.

A text is in none of the learnt languages if it scores too low for its language and number of
letters: below ``SLACK`` of the lowest score among the labelled documents of that language and
size that were rightly told. The fewer these are, the closer the bound is to ``LEAST_SCORE``,
which it is where there are none.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Mapping
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from tallytide.llm.common import importable, map_batches, texts_of

SAMPLE = 2_000
PROFILE = 300
UNDECIDED = "und"

# Documents below this score are in none of the learnt languages, whatever their size.
LEAST_SCORE = 0.1
SLACK = 0.9
# As many labelled documents take a bound half of the way up from ``LEAST_SCORE``.
HALFWAY = 8

_BOUNDARY = 1
_BITS = np.uint64(21)


@cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(n-grams, their counts) of a text; none if it has no letter."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[points]
    if not letter.any():
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    points = np.concatenate([[_BOUNDARY], np.where(letter, points, _BOUNDARY), [_BOUNDARY]])
    # One boundary between words.
    keep = (points[1:] != _BOUNDARY) | (points[:-1] != _BOUNDARY)
    points = np.concatenate([points[:1], points[1:][keep]]).astype(np.uint64)
    two = (points[:-1] << _BITS) | points[1:]
    three = (two[:-1] << _BITS) | points[2:]
    inner = points[1:-1] != _BOUNDARY
    one = points[points != _BOUNDARY]
    return np.unique(np.concatenate([one, two, three[inner]]), return_counts=True)


def size_of(text: str) -> int:
    """The number of binary digits of a text's number of letters."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return int(_letters()[points].sum()).bit_length()


def profile(values: np.ndarray, counts: np.ndarray, size: int = PROFILE) -> np.ndarray:
    """The most frequent n-grams, ties by value."""
    if len(values) > size:
        # Those as frequent as the last one, before the order is made.
        least = np.partition(counts, len(counts) - size)[len(counts) - size]
        kept = counts >= least
        values, counts = values[kept], counts[kept]
    return values[np.lexsort((values, -counts))][:size]


class Profiles:
    """The rank of every n-gram in every language."""

    def __init__(self, profiles: Mapping[str, list[int]], size: int):
        self.names, self.size = sorted(profiles), size
        everything = np.array(sorted({g for p in profiles.values() for g in p}), np.uint64)
        self.known = everything
        # The last row is for n-grams of no language.
        self.ranks = np.full((len(everything) + 1, len(self.names)), -1, np.int64)
        for column, name in enumerate(self.names):
            places = np.searchsorted(everything, np.array(profiles[name], np.uint64))
            self.ranks[places, column] = np.arange(len(places))

    def best(self, text: str) -> tuple[str, float]:
        own = profile(*grams(text), self.size)
        if not len(own) or not self.names:
            return UNDECIDED, 0.0
        at = np.searchsorted(self.known, own)
        at[at == len(self.known)] = 0
        at = np.where(self.known[at] == own, at, len(self.known))
        ranks = self.ranks[at]
        away = np.abs(ranks - np.arange(len(own))[:, None])
        away = np.where(ranks < 0, self.size, away).sum(0)
        column = int(away.argmin())
        return self.names[column], 1 - float(away[column]) / (len(own) * self.size)


def learn(
    docs: DataFrame, text: str, lang: str, id: str, sample: int = SAMPLE, size: int = PROFILE
) -> dict[str, list[int]]:
    """The profile of each language among the labelled documents."""
    importable(docs.sparkSession)
    rows = docs.select(
        F.col(lang).cast("string").alias("lang"),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
        F.coalesce(F.pmod(F.xxhash64(id), F.lit(1 << 20)), F.lit(0)).alias("draw"),
    ).where("lang IS NOT NULL")
    share = rows.groupBy("lang").agg((F.lit(sample * (1 << 20)) / F.count("*")).alias("upto"))
    drawn = rows.join(F.broadcast(share), "lang").where("draw < upto").select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: dict[str, Counter] = {}
            for name, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                values, counts = grams(value)
                found.setdefault(name, Counter()).update(
                    dict(zip(values.view(np.int64).tolist(), counts.tolist()))
                )
            for name, counter in found.items():
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([name] * len(counter), pa.string()),
                        pa.array(list(counter), pa.int64()),
                        pa.array(list(counter.values()), pa.int64()),
                    ],
                    names=["lang", "gram", "n"],
                )

    counted = (
        drawn.mapInArrow(count, "lang string, gram bigint, n bigint")
        .groupBy("lang", "gram")
        .agg(F.sum("n").alias("n"))
    )
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    profiles: dict[str, list[int]] = {}
    for row in counted.withColumn("rank", place).where(f"rank <= {size}").orderBy("lang", "rank").collect():
        profiles.setdefault(row["lang"], []).append(row["gram"])
    return profiles


def least_scores(
    docs: DataFrame, profiles: Mapping[str, list[int]], text: str, lang: str, least: float
) -> dict[tuple[str, int], float]:
    """The bound of each language and size that labelled documents have."""
    importable(docs.sparkSession)
    rows = docs.select(
        F.col(lang).cast("string").alias("lang"), F.coalesce(F.col(text), F.lit("")).alias("text")
    ).where("lang IS NOT NULL")

    def lowest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Profiles(profiles, PROFILE)
        for batch in batches:
            found: dict[tuple[str, int], list[float]] = {}
            for name, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                best, score = known.best(value)
                if best == name and score >= least:
                    found.setdefault((name, size_of(value)), []).append(score)
            if found:
                columns = zip(*((*key, len(scores), min(scores)) for key, scores in found.items()))
                kinds = (pa.string(), pa.int64(), pa.int64(), pa.float64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(columns, kinds)],
                    names=["lang", "size", "n", "least"],
                )

    bounds = rows.mapInArrow(lowest, "lang string, size bigint, n bigint, least double")
    bounds = bounds.groupBy("lang", "size").agg(F.sum("n").alias("n"), F.min("least").alias("least"))
    return {
        (r["lang"], r["size"]): least
        + max(0.0, SLACK * r["least"] - least) * r["n"] / (r["n"] + HALFWAY)
        for r in bounds.collect()
    }


def predict(
    docs: DataFrame, profiles: Mapping[str, list[int]], text: str, columns: dict[str, Column],
    size: int = PROFILE,
) -> DataFrame:
    """``columns`` of every row, by name, with ``lang_pred`` and ``score``."""
    kept = docs.select(*(c.alias(n) for n, c in columns.items()), F.col(text).alias("_text"))
    types = dict(kept.dtypes)
    schema, width = ", ".join(f"{n} {types[n]}" for n in columns), len(columns)

    def decide(batch: pa.RecordBatch) -> list:
        known = Profiles(profiles, size)
        found = [known.best(t) for t in texts_of(batch.column(width))]
        return [
            *batch.columns[:width],
            pa.array([name for name, _ in found], pa.string()),
            pa.array([score for _, score in found], pa.float64()),
        ]

    return map_batches(kept, decide, f"{schema}, lang_pred string, score double")


def held_out(id: str) -> Column:
    """Whether a document is kept for testing: a fourth of all, by the crc32 of its id."""
    return F.coalesce(F.pmod(F.crc32(F.col(id).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def languages(
    docs: DataFrame, id: str = "doc_id", text: str = "text", lang: str = "lang"
) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row; held out rows teach nothing."""
    profiles = learn(docs.where(~held_out(id)), text, lang, id)
    columns = {"doc_id": F.col(id).cast("bigint"), "held_out": held_out(id)}
    return predict(docs, profiles, text, columns)


def in_known_language(
    docs: DataFrame, id: str = "doc_id", text: str = "text", lang: str = "lang",
    least: float = LEAST_SCORE,
) -> DataFrame:
    """The rows of ``docs`` whose text is in one of the languages labelled there."""
    taught = docs.where(~held_out(id))
    profiles = learn(taught, text, lang, id)
    bounds = least_scores(taught, profiles, text, lang, least)
    place = docs.columns.index(text)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Profiles(profiles, PROFILE)
        for batch in batches:
            kept = []
            for value in texts_of(batch.column(place)):
                name, score = known.best(value)
                kept.append(score >= least and score >= bounds.get((name, size_of(value)), least))
            yield batch.filter(pa.array(kept, pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)
