"""Near duplicates by Jaccard similarity of word shingles.

Bottom-k sketches from one hash function, inverted lists of retained values, a filter on the
union sketch, and an exact check on full sets.

* A document's set holds 64-bit hashes of its distinct shingles, sorted; the bottom-k sketch
  is its first ``SKETCH`` values. The same function orders every set, so the sketch of a union
  comes from two sketches.
* Equal sets form one class, numbered (``rep``); one row represents it, and only these go on.
* A document that has a partner shares most retained values with it. The inverted lists of the
  retained values tell which values occur in two sketches; documents with too few of these
  have no partner. For sets within the sketch this is exact, also when a partner's set is
  larger than that; beyond it a pair at the threshold is lost with a chance below ``CHANCE``.
* For the rest, full sets are ordered by rarity, and each document retains its rarest values:
  one more than a partner may lack, so partners meet in the list of one of these values.
* In a short list all pairs are candidates. In a long one every member is compared with a hub,
  the member with the fewest values of its own. Members in its component need no more
  comparisons with each other. A link of any other shows in values that the hub lacks: the
  rarest of them make lists of the hub's members, again with all pairs or a hub. No long list
  emits all its pairs, and no link between components is lost.
* The union sketch drops candidates far below the threshold (exact for small sets, otherwise
  with the same chance of losing a pair); intersections of full sets decide.

Nulls and texts without words give the empty set, which is linked with nothing. Rows that
repeat a doc_id count as one document with several texts: what one of them is linked with, all
are, and all have one component. Rows without an id are kept apart.
"""

from __future__ import annotations

from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from tallytide.llm.common import map_batches, texts_of, written

SKETCH = 64
SHORT_LIST = 32

# How likely a full sketch may hide a pair whose similarity is the threshold itself.
CHANCE = 1e-10

_UNIT = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct hashes of the word shingles; of the whole sequence if it is shorter.

    Words are cut at ASCII white space, and A-Z are lower-cased.
    """
    parts = (text or "").encode().lower().split()
    if not parts:
        return np.empty(0, np.int64)
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, parts), np.uint64, len(parts))
    width = min(words, len(parts))
    mixed = np.full(len(parts) - width + 1, width, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(width):
            mixed = (mixed ^ hashes[i : len(hashes) - width + 1 + i]) * _UNIT
            mixed ^= mixed >> np.uint64(29)
        mixed = mixed * _MIX
        mixed ^= mixed >> np.uint64(32)
    return np.unique(mixed.view(np.int64))


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(a) for a in arrays])]).astype(np.int32)
    values = np.concatenate(arrays) if arrays else np.empty(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, pa.int64()))


def _digest(values: np.ndarray) -> str:
    return xxhash.xxh3_128_hexdigest(values.tobytes())


def _sketches(words: int):
    def columns(batch: pa.RecordBatch) -> list:
        sets = [shingle_set(text, words) for text in texts_of(batch.column(1))]
        return [
            batch.column(0),
            pa.array([len(s) for s in sets], pa.int64()),
            pa.array([_digest(s) for s in sets]),
            _lists([s[:SKETCH] for s in sets]),
        ]

    return columns


def _full_sets(words: int):
    """Sets of rows (rep, set_hash, text); none for another text of the same document."""

    def columns(batch: pa.RecordBatch) -> list:
        sets = [shingle_set(text, words) for text in texts_of(batch.column(2))]
        wanted = batch.column(1).to_pylist()
        sets = [s if _digest(s) == own else s[:0] for s, own in zip(sets, wanted)]
        return [batch.column(0), pa.array([len(s) for s in sets], pa.int64()), _lists(sets)]

    return columns


def _least(percent: int, n: str = "n") -> Column:
    """Values of a set of n that a partner has at least."""
    return F.expr(f"({percent} * {n} + 99) div 100")


def _fewest_common(percent: int, size: int) -> int:
    """Values of a full sketch of a union that are in both sets, at least.

    They are as many as in a binomial draw of ``size`` at the threshold, which falls short of
    the result with a chance below ``CHANCE``.
    """
    share, below, count = percent / 100, 0.0, 0
    while (below := below + comb(size, count) * share**count * (1 - share) ** (size - count)) < CHANCE:
        count += 1
    return count


def _sizes_fit(percent: int, a: str, b: str) -> Column:
    """Whether sizes, and values found elsewhere at all, allow the similarity."""
    return F.expr(
        f"100 * least({a}.n, {b}.n) >= {percent} * greatest({a}.n, {b}.n)"
        f" AND {100 + percent} * least({a}.shared, {b}.shared) >= {percent} * ({a}.n + {b}.n)"
    )


def _likely(a: Column, b: Column, size: int, percent: int) -> Column:
    """Whether the sketch of the union allows the similarity; exact if it is the whole union.

    The union is made and sorted only if the sketches have enough values in common at all.
    """
    both, fewest = F.array_intersect(a, b), _fewest_common(percent, size)
    union = F.size(a) + F.size(b) - F.size(both)
    lowest = F.slice(F.sort_array(F.array_union(a, b)), 1, size)
    return F.when(
        union < size, F.size(both) >= F.lit(percent / 100 - 1e-9) * union
    ).otherwise((F.size(both) >= fewest) & (F.size(F.array_intersect(lowest, both)) >= fewest))


def _candidate_sets(
    docs: DataFrame, reps: DataFrame, repeated_ids: DataFrame, words: int, percent: int
) -> DataFrame:
    """Full sets of the classes that may have a partner, one row each."""
    values = reps.select("rep", "n", F.explode("sketch").alias("value"))
    repeated = values.groupBy("value").count().where("count > 1").select("value")
    # A small set's partner may have this many values, and lack some of them in its sketch.
    largest = f"100 * n div {percent}"
    lacking = F.greatest(F.lit(0), F.expr(f"{largest} - {SKETCH}"))
    enough = F.when(
        F.col("n") <= SKETCH, F.least(_least(percent), _least(percent, f"({largest})") - lacking)
    ).otherwise(_fewest_common(percent, SKETCH))
    found = (
        values.join(repeated, "value", "left_semi")
        .groupBy("rep", "n")
        .count()
        .where(F.col("count") >= enough)
    )
    places = found.select("rep").join(reps.select("rep", "doc_id", "set_hash"), "rep")
    chosen = docs.join(places, "doc_id")
    if not repeated_ids.isEmpty():
        once = chosen.join(repeated_ids, "doc_id", "left_anti")
        again = chosen.join(repeated_ids, "doc_id", "left_semi")
        chosen = once.unionByName(again.dropDuplicates(["rep", "text"]))
    rows = chosen.select("rep", "set_hash", "text")
    sets = map_batches(rows, _full_sets(words), "rep bigint, n bigint, values array<bigint>")
    return written(sets.where("n > 0"))


def _retained(sets: DataFrame, percent: int) -> DataFrame:
    """The rarest values of each set, as many as guarantee that partners share one."""
    values = sets.select("rep", "n", F.explode("values").alias("value"))
    repeated = values.groupBy("value").agg(F.count("*").alias("df")).where("df > 1")
    return written(
        values.join(repeated, "value")
        .groupBy("rep", "n")
        .agg(F.sort_array(F.collect_list(F.struct("df", "value"))).alias("order"))
        .withColumn("shared", F.size("order").cast("bigint"))
        .where(F.col("shared") >= _least(percent))
        .withColumn("order", F.slice("order", 1, (F.col("shared") - _least(percent) + 1).cast("int")))
        .select("rep", "n", "shared", F.col("order.value").alias("retained"))
    )


def _similar(pairs: DataFrame, sets: DataFrame, percent: int, all_distances: bool) -> DataFrame:
    """Pairs with the sizes of their intersection and union.

    Without ``all_distances`` only linked pairs, filtered by the union sketch first.
    """

    def attach(frame: DataFrame, values: Column) -> DataFrame:
        for side in ("a", "b"):
            own = sets.select(F.col("rep").alias(side), values.alias(f"set_{side}"))
            frame = frame.join(own, side)
        return frame

    if not all_distances:
        pairs = (
            attach(pairs, F.slice("values", 1, SKETCH))
            .where(_likely(F.col("set_a"), F.col("set_b"), SKETCH, percent))
            .select("a", "b")
        )
    checked = (
        attach(pairs, F.col("values"))
        .withColumn("both", F.size(F.array_intersect("set_a", "set_b")).cast("bigint"))
        .withColumn("either", F.size("set_a") + F.size("set_b") - F.col("both"))
        .select("a", "b", "both", "either")
    )
    linked = F.expr(f"100 * both >= {percent} * either")
    return checked if all_distances else checked.where(linked)


def _pairs(entries: DataFrame, keys: list[str], percent: int, apart: str = "true") -> DataFrame:
    """Rows of ``entries`` that have the same ``keys``, where sizes and ``apart`` allow a link."""
    same = " AND ".join(f"x.{key} = y.{key}" for key in keys)
    return (
        entries.alias("x")
        .join(entries.alias("y"), F.expr(f"{same} AND x.rep < y.rep AND {apart}"))
        .where(_sizes_fit(percent, "x", "y"))
    )


def _beside_hubs(groups: DataFrame, sets: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Lists of a part's members in which those meet that may be linked past its hub.

    ``groups`` has members with the size of their intersection with the hub (``both``) and their
    component (``root``). If x and y are linked, and not both in the hub's component, one of them
    is not linked to the hub. So they have more in common than the hub holds of one of them, and
    meet in the list of a value that the hub lacks; a part's rarest such values do, as in
    ``_retained``. Only if one is smaller than the hub, all they need may be in the hub: these
    are a list of their own, whose hub is to be the smallest of them.

    The second table has what each member has besides the hub (``more``) and lacks of it
    (``less``).
    """
    whole = 100 + percent
    bounds = groups.groupBy("part").agg(
        F.min("n").alias("least"),
        F.min("root").alias("low"),
        F.max("root").alias("high"),
        F.max(F.expr("if(rep = hub, root, NULL)")).alias("settled"),
        F.max(F.expr("if(rep = hub, n, NULL)")).alias("hub_n"),
    )
    # The largest partner that the values in the hub suffice for, and the fewest others for any.
    placed = (
        groups.join(bounds.where("low < high"), "part")
        .withColumn("open", F.col("root") != F.col("settled"))
        .withColumn("reach", F.expr(f"{whole} * both div {percent} - n"))
        .withColumn("partner", F.greatest(F.col("least"), _least(percent)))
        .withColumn("need", F.expr(f"({percent} * (n + partner) + {whole - 1}) div {whole} - both"))
        .withColumn("need", F.greatest(F.lit(1), F.col("need")))
        .drop("low", "high", "settled", "partner")
    )
    hubs = sets.select(F.col("rep").alias("hub"), F.col("values").alias("in_hub"))
    placed = written(
        placed.join(sets.select("rep", "values"), "rep")
        .join(hubs, "hub")
        .withColumn("more", F.array_except("values", "in_hub"))
        .withColumn("less", F.array_except("in_hub", "values"))
        .drop("values", "in_hub")
    )
    others = placed.select("part", "rep", "root", F.explode("more").alias("value"))
    # Values in members of one component only are of no use.
    useful = (
        others.groupBy("part", "value")
        .agg(F.count("*").alias("df"), F.min("root").alias("low"), F.max("root").alias("high"))
        .where("low < high")
        .select("part", "value", "df")
    )
    members = placed.drop("more", "less")
    rarest = (
        others.drop("root")
        .join(useful, ["part", "value"])
        .groupBy("part", "rep")
        .agg(F.sort_array(F.collect_list(F.struct("df", "value"))).alias("order"))
        .join(members, ["part", "rep"])
        .withColumn("length", F.greatest(F.lit(0), F.size("order") - F.col("need") + 1))
        .withColumn("order", F.slice("order", 1, F.col("length").cast("int")))
        .select("part", "rep", "n", "shared", "root", F.explode("order.value").alias("value"))
        .withColumn("rank", F.col("n") - F.col("shared"))
    )
    reached = (
        members.where("open AND reach >= least")
        .groupBy("part")
        .agg(F.max("reach").alias("most"), F.min("n").alias("fewest"))
    )
    inside = (
        members.join(reached, "part")
        .where("open AND reach >= least OR n <= most AND reach >= fewest")
        .select(F.concat("part", F.lit("<")).alias("part"), "rep", "n", "shared", "root")
        .withColumn("value", F.lit(0).cast("bigint"))
        .withColumn("rank", F.col("n"))
    )
    return rarest.unionByName(inside), placed


def _linked_beside_hub(pairs: DataFrame, placed: DataFrame, percent: int) -> DataFrame:
    """Links among pairs (part, a, b), from what the members of a part have apart from its hub."""
    for side in ("a", "b"):
        own = placed.select(
            "part",
            F.col("rep").alias(side),
            *([F.col("hub_n")] if side == "a" else []),
            *(F.col(name).alias(f"{name}_{side}") for name in ("n", "both", "more", "less")),
        )
        pairs = pairs.join(own, ["part", side])
    common = (
        F.col("both_a") + F.col("both_b") - F.col("hub_n")
        + F.size(F.array_intersect("more_a", "more_b"))
        + F.size(F.array_intersect("less_a", "less_b"))
    )
    return pairs.where((100 + percent) * common >= percent * (F.col("n_a") + F.col("n_b"))).select("a", "b")


def _links_in_long_lists(
    members: DataFrame, links: DataFrame, sets: DataFrame, percent: int
) -> DataFrame:
    """``links``, and links that connect all that is linked within a list of ``members``.

    Every round compares members with the hub of their list. Lists that have the same hub are
    one part; what may still be linked in a part goes on in shorter lists, without the hub.
    Lists with few pairs for their length are compared pair by pair, and with more in each round.
    """
    few = SHORT_LIST // 2
    while not members.isEmpty():
        hubs = members.groupBy("part", "value").agg(F.min(F.struct("rank", "rep")).alias("hub"))
        groups = written(
            members.join(hubs, ["part", "value"])
            .withColumn("hub", F.col("hub.rep"))
            .select(F.concat_ws("/", "part", "hub").alias("part"), "hub", "rep", "n", "shared")
            .distinct()
        )
        to_hub = groups.where("hub != rep").select(F.col("hub").alias("a"), F.col("rep").alias("b"))
        measured = written(_similar(to_hub.distinct(), sets, percent, True))
        near = measured.where(f"100 * both >= {percent} * either").select("a", "b")
        labels = components(links.union(near))
        links = labels.toDF("b", "a").select("a", "b")
        groups = written(
            groups.join(measured.toDF("hub", "rep", "both", "either"), ["hub", "rep"], "left")
            .join(labels.toDF("rep", "root"), "rep", "left")
            .withColumn("both", F.coalesce("both", "n"))
            .withColumn("root", F.coalesce("root", "rep"))
            .drop("either")
        )
        entries, placed = _beside_hubs(groups, sets, percent)
        entries = written(entries)
        lists = written(
            entries.groupBy("part", "value", "root")
            .agg(F.count("*").alias("same"))
            .groupBy("part", "value")
            .agg(F.sum("same").alias("length"), F.sum(F.expr("same * same")).alias("inside"))
            .withColumn("pairs", F.expr("(length * length - inside) div 2"))
            .where("pairs > 0")
        )
        short = lists.where(f"pairs <= {few} * length").select("part", "value")
        found = (
            _pairs(entries.join(short, ["part", "value"]), ["part", "value"], percent, "x.root != y.root")
            .select(
                F.regexp_replace("x.part", "<$", "").alias("part"),
                F.col("x.rep").alias("a"),
                F.col("y.rep").alias("b"),
            )
            .distinct()
        )
        links = written(links.union(_linked_beside_hub(found, placed, percent)))
        long = lists.where(f"pairs > {few} * length").select("part", "value")
        members = written(entries.join(long, ["part", "value"]).drop("root"))
        few *= 4
    return links


def _links(sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) that connect every component."""
    retained = _retained(sets, percent)
    entries = retained.select("rep", "n", "shared", F.explode("retained").alias("value"))
    lists = written(
        entries.groupBy("value").agg(F.count("*").alias("length")).where("length > 1")
    )
    short = lists.where(f"length <= {SHORT_LIST}").select("value")
    near = written(entries.join(short, "value"))
    pairs = _pairs(near, ["value"], percent).select(F.col("x.rep").alias("a"), F.col("y.rep").alias("b"))
    links = written(_similar(pairs.distinct(), sets, percent, False).select("a", "b"))
    long = lists.where(f"length > {SHORT_LIST}").select("value")
    members = (
        entries.join(long, "value")
        .withColumn("part", F.lit(""))
        .withColumn("rank", F.col("n") - F.col("shared"))
    )
    return _links_in_long_lists(written(members), links, sets, percent)


def components(links: DataFrame) -> DataFrame:
    """(node, root): the smallest node of every component with a link (a, b).

    Each round every node points to its smallest neighbour, pointers jump to their roots, and
    the trees shrink to single nodes; the number of trees at least halves. Only minima are
    aggregated, so no task holds the neighbours of a node.
    """
    edges, labels = written(links.where("a != b").distinct()), None
    while not edges.isEmpty():
        both = edges.union(edges.select("b", "a")).toDF("node", "other")
        parent = written(
            both.groupBy("node").agg(F.min("other").alias("root"))
            .withColumn("root", F.least("node", "root"))
        )
        while True:
            above = parent.select(F.col("node").alias("root"), F.col("root").alias("above"))
            jumped = written(parent.join(above, "root").select("node", "root", "above"))
            moved = not jumped.where("root != above").isEmpty()
            parent = jumped.select("node", F.col("above").alias("root"))
            if not moved:
                break
        if labels is None:
            labels = parent
        else:
            higher = parent.select(F.col("node").alias("root"), F.col("root").alias("higher"))
            labels = written(
                labels.join(higher, "root", "left")
                .select("node", F.coalesce("higher", "root").alias("root"))
            )
        for side in ("a", "b"):
            renamed = parent.select(F.col("node").alias(side), F.col("root").alias(f"_{side}"))
            edges = edges.join(renamed, side)
        edges = written(
            edges.select(F.col("_a").alias("a"), F.col("_b").alias("b")).where("a != b").distinct()
        )
    return links.select(F.col("a").alias("node"), F.col("b").alias("root")).where("false") if (
        labels is None
    ) else labels


def near_duplicates(
    docs: DataFrame,
    id: str = "doc_id",
    text: str = "text",
    words: int = 3,
    percent: int = 85,
) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row of ``docs``.

    Documents are linked if ``100 * |A and B| >= percent * |A or B|``; a component is what links
    reach, named by its smallest id.
    """
    docs = docs.select(F.col(id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    schema = "doc_id bigint, n bigint, set_hash string, sketch array<bigint>"
    base = written(map_batches(docs, _sketches(words), schema))
    known = base.where("n > 0 AND doc_id IS NOT NULL")
    classes = written(
        known.groupBy("set_hash")
        .agg(F.min("doc_id").alias("least"))
        .withColumn("rep", F.monotonically_increasing_id())
    )
    reps = written(
        known.join(classes, "set_hash")
        .where("doc_id = least")
        .dropDuplicates(["set_hash"])
        .select("rep", "doc_id", "set_hash", "n", "sketch")
    )
    repeated_ids = written(
        base.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").select("doc_id")
    )
    sets = _candidate_sets(docs, reps, repeated_ids, words, percent)

    # What the texts of one document are linked with is one component.
    texts = known.join(repeated_ids, "doc_id").select("doc_id", "set_hash")
    own = written(texts.join(classes, "set_hash").select("doc_id", "rep").distinct())
    first = own.groupBy("doc_id").agg(F.min("rep").alias("a"))
    one = own.join(first, "doc_id").select("a", F.col("rep").alias("b")).where("a < b").distinct()
    labels = written(components(_links(sets, percent).union(one)))
    linked = classes.join(labels.withColumnRenamed("node", "rep"), "rep")
    smallest = linked.groupBy("root").agg(F.min("least").alias("component"))
    named = written(
        classes.join(linked.join(smallest, "root").select("rep", "component"), "rep", "left")
        .select("set_hash", "rep", F.coalesce("component", "least").alias("root"))
    )
    # A text without words has the component of its document's other texts.
    of_document = first.join(named.withColumnRenamed("rep", "a"), "a").select(
        "doc_id", F.col("root").alias("of_document")
    )
    component = F.coalesce("of_document", F.when(F.col("n") > 0, F.col("root")), "doc_id")
    return (
        base.join(named.select("set_hash", "root"), "set_hash", "left")
        .join(of_document, "doc_id", "left")
        .select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
    )
