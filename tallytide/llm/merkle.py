"""Merkle manifest of a dataset, kept as a postorder append log.

Every row is a leaf: the hash of its columns, each with its length before it. Leaves of one
group (a language) stand in the order of their ids; two neighbours become the hash of both, a
last one without neighbour the hash of itself, until one is left: the group's root. The groups'
roots, in the order of their names, make the dataset's root in the same way.

* A node is written as soon as it is complete, which is postorder. The position of a node
  follows from its level and its place alone (``position``): before leaf i there are i leaves and
  all subtrees completed among them, ``2 i - popcount(i)`` nodes, and above the last leaf of a
  node there are as many finished nodes as its level says.
* Builders are aligned: a task gets runs of ``2 ** HEIGHT`` leaves that begin at a multiple of
  that, so a run is a whole subtree and a contiguous part of the log. The roots of the runs are the
  leaves of the next round, of which there are ``log(leaves) / HEIGHT``.
* A proof is read from the log by position, inside each run; what lies above a run is the same for
  all its leaves and is handed down once per run. Nothing is made per leaf and level.

Digests are hashed as lowercase hexadecimal text and stored as 32 bytes. Null groups are a group
of their own, before the others. Rows of one id stand in the order of their leaf; a row
without id comes first and is never tampered with. Null columns are hashed as ``-``. An empty
table has no root and gives no rows. Further columns of the input are not looked at.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tallytide.llm.common import map_batches, numbered, written

# A run of the log has 2 ** HEIGHT leaves.
HEIGHT = 10
# Runs given to a batch function at a time.
RUNS = 16
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
_SIZE = 32
_SEGMENT = (
    "tree string|round int|grp string|block bigint|n bigint|ids array<bigint>|changed binary"
    "|nodes binary|root binary"
)


def digest(*hexes: str) -> str:
    return hashlib.sha256("".join(hexes).encode()).hexdigest()


def position(level: int, place: int, n: int) -> int:
    """0-based place in the log of the node at ``level`` above ``n`` leaves, ``place`` from the left."""
    last = min((place + 1) << level, n) - 1
    return 2 * last - last.bit_count() + level


def levels_above(n: int) -> int:
    """Levels above ``n`` leaves."""
    return (n - 1).bit_length()


def append_log(leaves: list[str], levels: int) -> list[str]:
    """All nodes over ``leaves`` in the order in which they are completed."""
    log: list[str] = []
    open_nodes: list[str] = []  # those without a finished parent, by level: at most one each
    for i, leaf in enumerate(leaves):
        log.append(leaf)
        node, level = leaf, 0
        while i >> level & 1:
            node, level = digest(open_nodes.pop(), node), level + 1
            log.append(node)
        if i + 1 < len(leaves):
            open_nodes.append(node)
            continue
        # After the last leaf the right edge closes, with or without a left neighbour.
        for upper in range(level, levels):
            node = digest(open_nodes.pop(), node) if i >> upper & 1 else digest(node)
            log.append(node)
    return log


def siblings(log: list[str], place: int, n: int, levels: int) -> list[str]:
    """The other nodes of the runs above leaf ``place``, bottom to top, read from the log."""
    found = []
    for level in range(levels):
        other = (place >> level) ^ 1
        if other << level < n:
            found.append(log[position(level, other, n)])
    return found


def fold(leaf: str, proof: list[str], trees: list[tuple[int, int]]) -> str:
    """The root that ``leaf`` and its proof give; ``trees``: place and number of leaves, upwards."""
    rest = iter(proof)
    node = leaf
    for place, n in trees:
        for level in range(levels_above(n)):
            at = place >> level
            if (at ^ 1) << level >= n:
                node = digest(node)
            elif at & 1:
                node = digest(next(rest), node)
            else:
                node = digest(node, next(rest))
    return node


def _hexes(blob: bytes) -> list[str]:
    text = blob.hex()
    return [text[i : i + 2 * _SIZE] for i in range(0, len(text), 2 * _SIZE)]


def leaf_hash(columns: dict[str, Column]) -> Column:
    """The digest of one row's columns, in hexadecimal."""

    def field(column: Column) -> Column:
        text = column.cast("string")
        return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))

    return F.sha2(F.concat(*(field(columns[name]) for name in COLUMNS)), 256)


def _build_segments(height: int):
    def run(batch: pa.RecordBatch) -> list:
        rows = batch.to_pylist()
        nodes, roots = [], []
        for row in rows:
            leaves = [leaf["digest"].hex() for leaf in row["leaves"]]
            log = append_log(leaves, min(height, levels_above(row["n"])))
            nodes.append(bytes.fromhex("".join(log)))
            roots.append(bytes.fromhex(log[-1]))
        ids = [[leaf["id"] for leaf in row["leaves"]] for row in rows]
        changed = [b"".join(leaf["changed"] or b"" for leaf in row["leaves"]) for row in rows]
        return [
            *(batch.column(name) for name in ("tree", "round", "grp", "block", "n")),
            pa.array(ids, pa.list_(pa.int64())),
            *(pa.array(blobs, pa.binary()) for blobs in (changed, nodes, roots)),
        ]

    return run


def segments(leaves: DataFrame, tree: str, height: int) -> list[DataFrame]:
    """Runs of the log, one table per round, from rows (grp, place, n, id, digest, changed).

    ``n`` is the number of leaves of the group. A run is gathered in one row, of at most
    ``2 ** height`` leaves. The last round has one run per group, whose root is the group's.
    """
    rounds = []
    most = leaves.agg(F.max("n")).first()[0] or 0
    while not rounds or most > 1:
        leaf = F.struct("place", "id", "digest", "changed")
        runs = (
            leaves.groupBy("grp", F.shiftright("place", height).alias("block"), "n")
            .agg(F.sort_array(F.collect_list(leaf)).alias("leaves"))
            .select(F.lit(tree).alias("tree"), F.lit(len(rounds)).alias("round"), "grp", "block", "n", "leaves")
        )
        rounds.append(written(map_batches(runs, _build_segments(height), _SEGMENT, between="|", rows=RUNS)))
        leaves = rounds[-1].select(
            "grp",
            F.col("block").alias("place"),
            F.shiftright(F.col("n") + ((1 << height) - 1), height).alias("n"),
            F.lit(None).cast("bigint").alias("id"),
            F.col("root").alias("digest"),
            F.lit(None).cast("binary").alias("changed"),
        )
        most = -(-most >> height)
    return rounds


def _hand_down(height: int):
    """Each leaf of a run with the digests above it, from those above the run."""

    def run(batch: pa.RecordBatch) -> list:
        groups, places, paths = [], [], []
        for row in batch.to_pylist():
            log, first = _hexes(row["nodes"]), row["block"] << height
            n, levels = min(1 << height, row["n"] - first), min(height, levels_above(row["n"]))
            for place in range(n):
                groups.append(row["grp"])
                places.append(first + place)
                paths.append(bytes.fromhex("".join(siblings(log, place, n, levels))) + row["path"])
        return [pa.array(groups, pa.string()), pa.array(places, pa.int64()), pa.array(paths, pa.binary())]

    return run


def _same(left: str, right: str, *names: str) -> Column:
    return reduce(
        lambda a, b: a & b,
        (F.col(f"{left}.{name}").eqNullSafe(F.col(f"{right}.{name}")) for name in names),
    )


def handed_down(runs: DataFrame, height: int) -> DataFrame:
    """The digests above every leaf of ``runs``, which are the runs of the round before."""
    columns = runs.select("grp", "block", "n", "nodes", "path")
    return map_batches(columns, _hand_down(height), "grp string, block bigint, path binary", rows=RUNS)


def with_paths(rounds: list[DataFrame], above: DataFrame, height: int) -> DataFrame:
    """The runs of the first round with the digests above each of them.

    ``above`` has (grp, block = 0, path) for the single run of every group's last round.
    """
    for number, runs in reversed(list(enumerate(rounds))):
        joined = runs.alias("r").join(above.alias("a"), _same("r", "a", "grp", "block"))
        runs = joined.select("r.*", "a.path")
        above = handed_down(runs, height) if number else above
    return runs


def _prove(root: str, height: int):
    def run(batch: pa.RecordBatch) -> list:
        columns: list[list] = [[] for _ in range(6)]
        for row in batch.to_pylist():
            log, changed = _hexes(row["nodes"]), _hexes(row["changed"])
            ids, upper = row["ids"], _hexes(row["path"])
            levels = min(height, levels_above(row["n"]))
            for place, doc_id in enumerate(ids):
                leaf = log[position(0, place, len(ids))]
                proof = siblings(log, place, len(ids), levels) + upper
                trees = [((row["block"] << height) + place, row["n"]), (row["tree_place"], row["tree_n"])]
                folded = fold(changed[place], proof, trees)
                for column, value in zip(
                    columns, (doc_id, leaf, row["subroot"], digest(*proof), folded, folded == root)
                ):
                    column.append(value)
        doc_ids, leaf, subroot, proof, folded, verified = columns
        text = pa.string()
        return [
            pa.array(doc_ids, pa.int64()),
            pa.array(leaf, text),
            pa.array(subroot, text),
            pa.array([root] * len(leaf), text),
            pa.array(proof, text),
            pa.array(folded, text),
            pa.array(verified, pa.bool_()),
        ]

    return run


class Manifest:
    """The log of a dataset: its runs by round, those over the groups' roots, and the root."""

    def __init__(self, leaves: DataFrame, height: int = HEIGHT):
        """From rows (id, grp, digest, changed): the leaf, and the one to be verified."""
        self.height = height
        order = [F.asc_nulls_first("grp"), F.asc_nulls_first("id"), F.asc("digest")]
        placed = numbered(leaves, order, "_place")
        sizes = placed.groupBy("grp").agg(F.min("_place").alias("_first"), F.count("*").alias("n"))
        indexed = (
            placed.alias("p")
            .join(sizes.alias("s"), _same("p", "s", "grp"))
            .select("p.grp", (F.col("_place") - F.col("_first")).alias("place"), "n", "id", "digest", "changed")
        )
        self.rounds = segments(indexed, "rows", height)
        tops = self.rounds[-1].select("grp", "root")
        named = numbered(tops, [F.asc_nulls_first("grp")], "place").withColumn("n", F.lit(tops.count()))
        self.groups = written(named)
        self.group_rounds = segments(
            self.groups.select(
                F.lit("").alias("grp"),
                "place",
                F.col("n").cast("bigint").alias("n"),
                F.lit(None).cast("bigint").alias("id"),
                F.col("root").alias("digest"),
                F.lit(None).cast("binary").alias("changed"),
            ),
            "groups",
            height,
        )
        top = self.group_rounds[-1].select("root").first()
        self.root = bytes(top["root"]).hex() if top else None

    def log(self) -> DataFrame:
        """All runs of the log, to be written as the manifest."""
        return reduce(DataFrame.unionAll, self.rounds + self.group_rounds)

    def proofs(self) -> DataFrame:
        """Per row: leaf, roots, digest of its proof, and the root that its proof gives."""
        spark = self.groups.sparkSession
        top = spark.createDataFrame([("", 0, b"")], "grp string, block bigint, path binary")
        paths = handed_down(with_paths(self.group_rounds, top, self.height), self.height)
        above = written(
            self.groups.alias("g")
            .join(paths.alias("p"), F.col("g.place") == F.col("p.block"))
            .select("g.grp", F.lit(0).cast("bigint").alias("block"), "g.root", "g.place", "g.n", "p.path")
        )
        subroots = above.select(
            "grp",
            F.lower(F.hex("root")).alias("subroot"),
            F.col("place").alias("tree_place"),
            F.col("n").cast("bigint").alias("tree_n"),
        )
        rows = with_paths(self.rounds, above.select("grp", "block", "path"), self.height)
        rows = (
            rows.alias("r")
            .join(subroots.alias("s"), _same("r", "s", "grp"))
            .select("r.block", "r.n", "r.ids", "r.changed", "r.nodes", "r.path", "subroot", "tree_place", "tree_n")
        )
        return map_batches(
            rows,
            _prove(self.root or "", self.height),
            "doc_id bigint, leaf string, subroot string, root string, proof_sha256 string,"
            " folded_root string, verified boolean",
            rows=RUNS,
        )


def manifest(docs: DataFrame, height: int = HEIGHT) -> Manifest:
    """The manifest of ``docs`` by language; where 7 divides crc32(doc_id), the row to be
    verified has one more in ``n_chars``."""
    columns = {name: F.col(name) for name in COLUMNS}
    one_more = columns | {"n_chars": F.col("n_chars").cast("decimal(38,0)") + 1}
    tampered = F.crc32(F.col("doc_id").cast("string")) % 7 == 0
    leaf = leaf_hash(columns)
    return Manifest(
        docs.select(
            F.col("doc_id").cast("bigint").alias("id"),
            F.col("lang").alias("grp"),
            F.unhex(leaf).alias("digest"),
            F.unhex(F.when(tampered, leaf_hash(one_more)).otherwise(leaf)).alias("changed"),
        ),
        height,
    )


def verified_rows(docs: DataFrame, height: int = HEIGHT) -> DataFrame:
    """Per row of ``docs`` its leaf, roots, digest of its proof, and whether that verifies."""
    return manifest(docs, height).proofs()
