"""Mixing sources to target weights by Pfair scheduling.

Sources are cut into blocks of documents. With weight w of a total D, the j-th block of a
source is released at slot floor((j-1) D / w) and due by slot ceil(j D / w); the earliest
deadline among released blocks goes first. At every slot each source then has had its share
within less than one block. The schedule repeats after D slots, so it is computed for one
period of at most ``LONGEST_PERIOD`` slots and applied by arithmetic to any number of blocks.

When a source has no more blocks, a new schedule begins at that slot with the weights of the
others. Every document gets exactly one place. Documents within a source are ordered by a hash
of their id. Documents of sources without a weight, null among them, form one source of the
smallest weight. Rows that repeat an id get places of their own.

The number of sources has no limit. The largest ``SINGLES`` are scheduled one by one, the others
in classes of about equal size, each a source of the schedule with the weight of its members.
Members of a class have equal weights, and the Pfair schedule of equal weights is a round of all
members after the other: block j of each before block j + 1 of any. So it is a sort by j, and no
task or driver holds the members. Of any number of sources, the schedule has at most ``SINGLES``
and eight classes per doubling of the size.
"""

from __future__ import annotations

import heapq
from collections.abc import Mapping
from functools import reduce
from math import gcd

from pyspark.sql import DataFrame, functions as F

from tallytide.llm.common import numbered, written

BLOCK = 64
LONGEST_PERIOD = 10_000
SINGLES = 200

# Classes of sizes for each doubling.
STEPS = 8

_OTHERS = "\0others"
_CLASS = "\0size:"


def period(weights: Mapping[str, int]) -> list[str]:
    """The source of each slot of one period, as long as the sum of the weights."""
    total = sum(weights.values())
    if total > LONGEST_PERIOD:
        raise ValueError(f"weights add up to more than {LONGEST_PERIOD}")
    released: list[tuple[int, str, int]] = []
    waiting = [(0, name, 1) for name in weights]
    heapq.heapify(waiting)
    slots = []
    for slot in range(total):
        while waiting and waiting[0][0] <= slot:
            _, name, j = heapq.heappop(waiting)
            heapq.heappush(released, (-(-j * total // weights[name]), name, j))
        _, name, j = heapq.heappop(released)
        slots.append(name)
        if j < weights[name]:
            heapq.heappush(waiting, (j * total // weights[name], name, j + 1))
    return slots


def phases(weights: Mapping[str, int], blocks: Mapping[str, int]) -> list[tuple]:
    """(source, first block, end block, first slot, period, slots of the source in a period)."""
    left = {name: n for name, n in blocks.items() if n > 0}
    done = dict.fromkeys(left, 0)
    begin, found = 0, []
    while left:
        common = reduce(gcd, (weights[name] for name in left))
        now = {name: weights[name] // common for name in left}
        order, total = period(now), sum(now.values())
        slots: dict[str, list[int]] = {name: [] for name in left}
        for slot, name in enumerate(order):
            slots[name].append(slot)
        last = lambda name: (left[name] - 1) // now[name] * total + slots[name][(left[name] - 1) % now[name]]
        end = min(map(last, left)) + 1
        for name in list(left):
            used = end // total * now[name] + sum(slot < end % total for slot in slots[name])
            if used:
                found.append((name, done[name], done[name] + used, begin, total, slots[name]))
            done[name] += used
            left[name] -= used
            if not left[name]:
                del left[name]
        begin += end
    return found


def _sizes(rows: DataFrame) -> DataFrame:
    """(source, n, class) of the sources of ``rows``; a class has sources of about one size."""
    step = F.floor(F.log2("n") * STEPS).cast("string")
    sizes = rows.where("source IS NOT NULL").groupBy("source").agg(F.count("*").alias("n"))
    return written(sizes.withColumn("class", F.concat(F.lit(_CLASS), step)))


def tempered_weights(
    docs: DataFrame,
    source: str = "source",
    power: float = 0.5,
    total: int = 1_000,
    singles: int = SINGLES,
) -> dict[str, int]:
    """Weights in proportion to a power of the sources' sizes, 1 at least.

    The ``singles`` largest sources have their own, classes of the others the sum of their
    members. The weights add up to about ``total``, or to ten times their number if that is more.
    One row per weight comes to the driver.
    """
    sizes = _sizes(docs.select(F.col(source).cast("string").alias("source")))
    largest = sizes.orderBy(F.desc("n"), "source").limit(singles).select("source", F.col("source").alias("own"))
    shares = (
        sizes.join(largest, "source", "left")
        .groupBy(F.coalesce("own", "class").alias("name"))
        .agg(F.sum(F.pow("n", F.lit(power))).alias("share"))
        .collect()
    )
    scale = sum(row["share"] for row in shares)
    total = max(total, 10 * len(shares))
    return {row["name"]: max(1, round(total * row["share"] / scale)) for row in shares}


def _in_rounds(rows: DataFrame, classes: list[str], block: int) -> DataFrame:
    """``rows``, those of sources in ``classes`` with the number of their block in their source.

    The sources are smaller than each single one, so that none is hot in the joins.
    """
    small = F.col("_name").eqNullSafe(_OTHERS) & F.col("source").isNotNull()
    members = _sizes(rows.where(small)).where(F.col("class").isin(classes)).select("source", "class")
    known = rows.where(small).join(members, "source", "left")
    own = numbered(known.where("class IS NOT NULL"), ["source", "_draw", "doc_id"], "_n")
    first = own.groupBy("source").agg(F.min("_n").alias("_least"))
    rounds = own.join(first, "source").select(
        "doc_id", "source", F.col("class").alias("_name"), "_draw",
        F.expr(f"(_n - _least) div {block}").alias("_round"), F.col("source").alias("_turn"),
    )
    others = rows.where(~small).union(known.where("class IS NULL").select(rows.columns))
    return others.union(rounds.select(rows.columns))


def mixed(
    docs: DataFrame,
    weights: Mapping[str, int],
    id: str = "doc_id",
    source: str = "source",
    block: int = BLOCK,
) -> DataFrame:
    """(doc_id, source, slot, position) of every row; ``position`` puts them in their order.

    ``weights`` are positive whole numbers of sources, and of classes as in ``tempered_weights``.
    """
    if any(w < 1 for w in weights.values()):
        raise ValueError("weights must be positive")
    spark = docs.sparkSession
    name = F.col(source).cast("string")
    classes = [name for name in weights if name.startswith(_CLASS)]
    listed = name.isin([name for name in weights if name not in classes]) if weights else F.lit(False)
    rows = docs.select(
        F.col(id).cast("bigint").alias("doc_id"),
        name.alias("source"),
        F.when(listed, name).otherwise(_OTHERS).alias("_name"),
        F.xxhash64(F.col(id)).alias("_draw"),
        F.lit(0).cast("bigint").alias("_round"),
        F.lit(None).cast("string").alias("_turn"),
    )
    if classes:
        rows = _in_rounds(rows, classes, block)
    placed = numbered(rows, ["_name", "_round", "_turn", "_draw", "doc_id"], "_n")
    # One row per weight.
    starts = placed.groupBy("_name").agg(F.min("_n").alias("_first"), F.count("*").alias("n")).collect()
    own = {**weights, _OTHERS: min(weights.values(), default=1)}
    blocks = {row["_name"]: -(-row["n"] // block) for row in starts}
    first = {row["_name"]: row["_first"] for row in starts}
    table = spark.createDataFrame(
        [(p[0], first[p[0]], *p[1:]) for p in phases(own, blocks)],
        "_name string, _first bigint, _from bigint, _to bigint, _begin bigint, _period int,"
        " _slots array<int>",
    )
    # At most a row per pair of weights, with slots of one period per phase.
    placed = placed.join(F.broadcast(table.select("_name", "_first").distinct()), "_name").select(
        "doc_id", "source", "_name", (F.col("_n") - F.col("_first")).alias("_k")
    )
    scheduled = placed.withColumn("_block", F.expr(f"_k div {block}")).join(
        F.broadcast(table.drop("_first")).withColumnRenamed("_name", "_of"),
        F.expr("_name = _of AND _block >= _from AND _block < _to"),
    )
    slot = F.expr(
        "_begin + (_block - _from) div size(_slots) * _period"
        " + element_at(_slots, cast((_block - _from) % size(_slots) as int) + 1)"
    )
    return scheduled.withColumn("slot", slot).select(
        "doc_id", "source", "slot", (F.col("slot") * block + F.col("_k") % block).alias("position")
    )

