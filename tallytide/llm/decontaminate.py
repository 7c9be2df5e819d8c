"""Benchmark decontamination by spaced-seed hashing.

A seed hashes the words of a text at the marked places of a fixed mask and ignores the others.
Seeds of documents and of benchmark items are joined; a hit says where an item would lie in the
document. There, words are compared place by place: the document holds the item if some
``WINDOW`` successive words of it (the whole item, if it is shorter) agree in ``AGREE`` percent.
The masks hit every such window with as many substitutions as that allows, wherever they are.

Words are lower-cased runs of letters, digits and underscores; in scripts without spaces, every
letter is a word. Items of fewer than ``LEAST_WORDS`` words must be there word for word: their
only seed is that of all their words. Items of one or two words are no passages and are not looked
for; ``too_short`` lists them. Nulls have no words. Rows that repeat a doc_id are one document with
several texts; rows without a doc_id are documents of their own, equal texts alike. A document is
kept if it holds no item, whether items have ids or not; items without an id count as one.

Documents' seeds first pass a bitmap of fixed size over the benchmark's seeds, so that only
few of them are shuffled; the join on whole seeds follows, whatever the size of the benchmark.
With a hit goes the neighbourhood that the comparison needs, so no text is shuffled. A document's
neighbourhoods are followed by one row per item and compared as they come: what is held at a time
is one document and one item, however often a passage repeats.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from tallytide.llm.common import importable, map_batches, texts_of, written

MASKS = ("11111", "110111", "11001011")
WINDOW = 20
AGREE = 80
LEAST_WORDS = 8
# Shorter items are not looked for.
LEAST_EXACT = 3

# Bits of the bitmap: 512 KB, for any benchmark.
_BITS = 1 << 22

_WORD = re.compile(r"\w+")
# Thai, Lao, Burmese, Khmer, kana, Han.
_UNSPACED = (
    "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff"
    "\uf900-\ufaff\uff66-\uff9f\U00020000-\U0003ffff"
)
_ANY_UNSPACED = re.compile(f"[{_UNSPACED}]")
_WORD_OR_LETTER = re.compile(rf"(?!\W)[{_UNSPACED}]|[^\W{_UNSPACED}]+")
_UNIT = np.uint64(0x9E3779B97F4A7C15)


def word_hashes(text: str | None) -> np.ndarray:
    text = (text or "").lower()
    unspaced = not text.isascii() and _ANY_UNSPACED.search(text)
    words = (_WORD_OR_LETTER if unspaced else _WORD).findall(text)
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def seeds(words: np.ndarray, mask: str) -> np.ndarray:
    """The seed at every place where the mask fits."""
    n = len(words) - len(mask) + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    total = np.full(n, len(mask) * 31 + int(mask, 2), np.uint64)
    with np.errstate(over="ignore"):
        for i, bit in enumerate(mask):
            if bit == "1":
                total = (total ^ words[i : i + n]) * _UNIT
                total ^= total >> np.uint64(29)
    return total


def best_share(
    begins: np.ndarray, item: np.ndarray, places: np.ndarray, words: np.ndarray
) -> tuple[int, int]:
    """(agreeing words, words) of the item's window that agrees best, from any of ``begins`` on.

    ``words`` are those at ``places`` of the document; elsewhere nothing agrees.
    """
    width, best = min(WINDOW, len(item)), 0
    step = max(1, (1 << 20) // len(item))
    for first in range(0, len(begins), step):
        want = begins[first : first + step, None] + np.arange(len(item))
        at = np.searchsorted(places, want)
        at[at == len(places)] = 0
        same = (places[at] == want) & (words[at] == item)
        sums = np.zeros((len(same), len(item) + 1), np.int32)
        np.cumsum(same, axis=1, out=sums[:, 1:])
        best = max(best, int((sums[:, width:] - sums[:, :-width]).max()))
    return best, width


def item_masks(n_words: int) -> tuple[str, ...]:
    """The masks that find items of so many words."""
    if n_words >= LEAST_WORDS:
        return MASKS
    return ("1" * n_words,) if n_words >= LEAST_EXACT else ()


def _item_columns(batch: pa.RecordBatch) -> list:
    rows = [word_hashes(text) for text in texts_of(batch.column(1))]
    made = [
        [(int(h), at) for mask in item_masks(len(w)) for at, h in enumerate(seeds(w, mask).view(np.int64))]
        for w in rows
    ]
    kind = pa.list_(pa.struct([("seed", pa.int64()), ("at", pa.int32())]))
    return [
        batch.column(0),
        pa.array([w.view(np.int64).tolist() for w in rows], pa.list_(pa.int64())),
        pa.array([[{"seed": s, "at": a} for s, a in seeds_] for seeds_ in made], kind),
    ]


def _bitmap(items: DataFrame) -> bytes:
    """One bit for every seed of the benchmark, by its lowest bits."""
    low = F.col("s.seed").bitwiseAND(_BITS - 1)
    parts = (
        items.select(F.explode("seeds").alias("s"))
        .select(low.alias("low"))
        .groupBy(F.bitmap_bucket_number(F.col("low") + 1).alias("bucket"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position(F.col("low") + 1)).alias("bits"))
        .collect()
    )  # at most 128 rows of 4 KB
    bits = bytearray(_BITS // 8)
    size = 4096
    for row in parts:
        at = (row["bucket"] - 1) * size
        bits[at : at + size] = row["bits"]
    return bytes(bits)


def _marks(docs: DataFrame, bitmap: bytes, masks: tuple[str, ...]) -> DataFrame:
    """Documents with a seed in the bitmap: the seeds, and the words around them."""
    importable(docs.sparkSession)
    schema = (
        "doc_id bigint, part bigint, hits array<struct<seed:bigint,at:int>>, places array<int>,"
        " words array<bigint>"
    )
    shared = docs.sparkSession.sparkContext.broadcast(bitmap)
    hit_kind = pa.list_(pa.struct([("seed", pa.int64()), ("at", pa.int32())]))
    reach = WINDOW

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.unpackbits(np.frombuffer(shared.value, np.uint8), bitorder="little").view(bool)
        for batch in batches:
            rows = []
            for doc_id, part, text in zip(*(c.to_pylist() for c in batch.columns)):
                words = word_hashes(text)
                hits, near = [], np.zeros(len(words), bool)
                for mask in masks:
                    made = seeds(words, mask)
                    at = np.flatnonzero(known[made & np.uint64(_BITS - 1)])
                    hits += zip(made[at].view(np.int64).tolist(), at.tolist())
                if not hits:
                    continue
                for at in {at for _, at in hits}:
                    near[max(0, at - reach) : at + reach + 8] = True
                places = np.flatnonzero(near)
                rows.append(
                    (
                        doc_id,
                        part,
                        [{"seed": s, "at": a} for s, a in hits],
                        places.astype(np.int32),
                        words[places].view(np.int64),
                    )
                )
            if rows:
                kinds = [pa.int64(), pa.int64(), hit_kind, pa.list_(pa.int32()), pa.list_(pa.int64())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(zip(*rows), kinds)],
                    names=["doc_id", "part", "hits", "places", "words"],
                )

    return docs.mapInArrow(run, schema)


def _part(id: Column, text: Column) -> Column:
    """What tells rows without an id from each other."""
    return F.when(id.isNull(), F.xxhash64(text)).otherwise(F.lit(0)).cast("bigint")


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each document's words, and after them the items to be compared with them."""
    key = places = words = None
    for batch in batches:
        rows = []
        for at in range(batch.num_rows):
            mark, kind, doc_id, part, own, values, item, begins = (c[at] for c in batch.columns)
            values = values.values.to_numpy()
            if kind.as_py() == 0:
                key = (doc_id.as_py(), part.as_py())
                places, words = own.values.to_numpy(), values
                continue
            same, width = best_share(begins.values.to_numpy(), values, places, words)
            agree = 100 if len(values) < LEAST_WORDS else AGREE
            if same * 100 >= agree * width:
                rows.append((*key, item.as_py(), same, width))
        if rows:
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, pa.int64()) for c in zip(*rows)],
                names=["doc_id", "part", "item_id", "agreeing", "words"],
            )


def _found(
    docs: DataFrame, benchmark: DataFrame, id: str, text: str, item: str, item_text: str
) -> DataFrame:
    """(doc_id, part, item_id, agreeing, words) of every item a document holds."""
    items = written(
        map_batches(
            benchmark.select(F.col(item).cast("bigint").alias("item"), F.col(item_text).alias("text")),
            _item_columns,
            "item bigint; words array<bigint>; seeds array<struct<seed:bigint,at:int>>",
            ";",
        ).withColumn("number", F.monotonically_increasing_id())
    )
    # At most one row per number of words below LEAST_WORDS, and one for all others.
    sizes = items.select(F.least(F.size("words"), F.lit(LEAST_WORDS)).alias("n")).distinct().collect()
    masks = tuple(dict.fromkeys(mask for row in sizes for mask in item_masks(row["n"])))
    rows = docs.select(
        F.col(id).cast("bigint").alias("doc_id"),
        _part(F.col(id), F.col(text)).alias("part"),
        F.col(text).alias("text"),
    )
    marks = written(
        _marks(rows, _bitmap(items), masks).withColumn("mark", F.monotonically_increasing_id())
    )
    seeds_of = items.select("number", F.explode("seeds").alias("s")).select(
        "number", F.col("s.seed").alias("seed"), F.col("s.at").alias("item_at")
    )
    hits = marks.select("mark", F.explode("hits").alias("h")).select(
        "mark", F.col("h.seed").alias("seed"), F.col("h.at").alias("at")
    )
    # Where an item would begin in the document: as many places as the document has, at most.
    pairs = written(
        hits.join(seeds_of, "seed")
        .select("mark", "number", (F.col("at") - F.col("item_at")).alias("begin"))
        .distinct()
        .groupBy("mark", "number")
        .agg(F.collect_list("begin").alias("begins"))
    )
    held = marks.join(pairs.select("mark").distinct(), "mark", "left_semi")
    none = F.lit(None)
    documents = held.select(
        "mark", F.lit(0).alias("kind"), "doc_id", "part", "places", "words",
        none.cast("bigint").alias("item"), none.cast("array<int>").alias("begins"),
    )
    compared = pairs.join(items.select("number", "item", "words"), "number").select(
        "mark", F.lit(1).alias("kind"), none.cast("bigint").alias("doc_id"),
        none.cast("bigint").alias("part"), none.cast("array<int>").alias("places"), "words",
        "item", "begins",
    )
    return (
        documents.unionAll(compared)
        .repartition("mark")
        .sortWithinPartitions("mark", "kind")
        .mapInArrow(_compared, "doc_id bigint, part bigint, item_id bigint, agreeing bigint, words bigint")
    )


def overlaps(
    docs: DataFrame,
    benchmark: DataFrame,
    id: str = "doc_id",
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """(doc_id, item_id, agreeing, words): the best window of every item a document holds."""
    return (
        _found(docs, benchmark, id, text, item, item_text)
        .groupBy("doc_id", "item_id")
        .agg(F.max("agreeing").alias("agreeing"), F.max("words").alias("words"))
    )


def _same_document(id: str, text: str, found: str) -> Column:
    """Whether a row ``d`` is the document of a row of ``found``."""
    own = F.col(f"d.`{id}`")
    same = own.cast("bigint").eqNullSafe(F.col(f"{found}.doc_id"))
    return same & (_part(own, F.col(f"d.`{text}`")) == F.col(f"{found}.part"))


def without_leaks(
    docs: DataFrame, benchmark: DataFrame, id: str = "doc_id", text: str = "text",
    item: str = "item_id", item_text: str = "text",
) -> DataFrame:
    """The rows of ``docs`` that hold no item, with all their columns."""
    leaks = _found(docs, benchmark, id, text, item, item_text).select("doc_id", "part").distinct()
    return docs.alias("d").join(leaks.alias("_l"), _same_document(id, text, "_l"), "left_anti")


def too_short(benchmark: DataFrame, item: str = "item_id", item_text: str = "text") -> DataFrame:
    """(item_id, n_words) of the items that are not looked for."""
    rows = benchmark.select(F.col(item).cast("bigint").alias("item_id"), F.col(item_text).alias("text"))

    def columns(batch: pa.RecordBatch) -> list:
        counts = [len(word_hashes(text)) for text in texts_of(batch.column(1))]
        return [batch.column(0), pa.array(counts, pa.int64())]

    return map_batches(rows, columns, "item_id bigint, n_words bigint").where(f"n_words < {LEAST_EXACT}")


def decontaminated(
    docs: DataFrame, benchmark: DataFrame, id: str = "doc_id", text: str = "text",
    item: str = "item_id", item_text: str = "text",
) -> DataFrame:
    """(doc_id, kept, n_items, items) of every row: ``items`` are those found, in order."""
    found = (
        _found(docs, benchmark, id, text, item, item_text)
        .select("doc_id", "part", "item_id")
        .distinct()
        .groupBy("doc_id", "part")
        .agg(F.count("*").alias("n"), F.sort_array(F.collect_list("item_id")).alias("items"))
    )
    rows = docs.select(F.col(id).cast("bigint").alias("doc_id"), _part(F.col(id), F.col(text)).alias("part"))
    same = F.col("r.doc_id").eqNullSafe(F.col("f.doc_id")) & (F.col("r.part") == F.col("f.part"))
    return (
        rows.alias("r")
        .join(found.alias("f"), same, "left")
        .select(
            "r.doc_id",
            F.col("n").isNull().alias("kept"),
            F.coalesce("n", F.lit(0)).cast("bigint").alias("n_items"),
            F.coalesce(
                F.concat_ws(",", F.transform("items", lambda x: x.cast("string"))), F.lit("")
            ).alias("items"),
        )
    )
