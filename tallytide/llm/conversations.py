"""Repair of the turn structure of conversations by the cheapest edits, with an audit of them.

A conversation may open with a system turn and then alternates user and assistant, ending with
the assistant, or is empty. Rows are kept, given another role, deleted, or new ones inserted; the
audit is the edits' initials in order, the least in ASCII of all cheapest ones.

* The edits are found by dynamic programming over rows and the four places a conversation can be
  in. Every place holds its cheapest edits so far as a node of a tree of shared prefixes
  (``Prefixes``): a letter and the node before it. Nothing is copied from row to row.
* A tie is decided by the longest common prefix of two nodes, found by jumps to ancestors 1, 2, 4
  ... letters back and rolling hashes of whole prefixes. As a node is made once for
  a letter after another node, equal prefixes are one node, so every match of hashes is verified.
* Equally dear edits of the same rows are never prefixes of each other (an edit's price follows
  from its letter and its row), so what is less now stays less, whatever follows.

Rows are sorted by range over all tasks. A conversation inside one range is finished there. One
that lies on a boundary, or is longer than a segment, is cut into segments; each gives the cheapest
edits from every place to every place, which are then put together. Only the hash of the repaired
text has to run through the whole conversation; it does so segment by segment, without holding it.

Null roles and texts are one space. Rows without a conversation are one conversation; rows without
a turn come first. Rows of one turn stand in the order of their role, then of the SHA-256 of
their text. A row equal to an earlier one in role and text is a duplicate, also if it is the same
row twice. An empty role is kept as it is and leaves the place unchanged. Further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from tallytide.llm.common import importable, written

# Prices of the edits, and of leaving a truncated text as it is.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
WHITE = " \t\n\x0b\x0c\r"
# A segment ends with this many rows or code points of text.
SEGMENT_ROWS = 4_096
SEGMENT_CHARS = 4_000_000

# Places: nothing yet, after the system turn, after a user turn, after an assistant turn.
START, SYSTEM, USER, ASSISTANT = range(4)
# A user turn may follow all places but itself, an assistant turn only a user turn.
_INSERTS = ((START, USER), (SYSTEM, USER), (ASSISTANT, USER), (USER, ASSISTANT))
_KEEPS = {
    "s": ((START, SYSTEM),),
    "u": ((START, USER), (SYSTEM, USER), (ASSISTANT, USER)),
    "a": ((USER, ASSISTANT),),
    "": tuple((place, place) for place in range(4)),
}
_BASE, _PRIME = 131, (1 << 61) - 1
_MOST = (1 << 63) - 1


class Prefixes:
    """A tree of strings: each node is a string, its parent the string without its last letter."""

    def __init__(self):
        self.parent, self.letter, self.depth, self.hash = [0], [""], [0], [0]
        self._up: list[list[int]] = [[]]
        self._made: dict[tuple[int, str], int] = {}

    def extended(self, node: int, letter: str) -> int:
        key = (node, letter)
        found = self._made.get(key)
        if found is None:
            found = self._made[key] = len(self.parent)
            self.parent.append(node)
            self.letter.append(letter)
            self.depth.append(self.depth[node] + 1)
            self.hash.append((self.hash[node] * _BASE + ord(letter)) % _PRIME)
            self._up.append([node])
        return found

    def ancestor(self, node: int, power: int) -> int:
        """The string without its last ``2 ** power`` letters."""
        while len(self._up[node]) <= power:
            known = self._up[node]
            known.append(self.ancestor(known[-1], len(known) - 1))
        return self._up[node][power]

    def cut(self, node: int, depth: int) -> int:
        """The first ``depth`` letters."""
        over = self.depth[node] - depth
        while over:
            power = over.bit_length() - 1
            node, over = self.ancestor(node, power), over - (1 << power)
        return node

    def _parted(self, a: int, b: int, same) -> tuple[int, int]:
        """The first prefixes of two different strings of one length that are not the same."""
        for power in reversed(range(self.depth[a].bit_length())):
            if 1 << power < self.depth[a]:
                above, other = self.ancestor(a, power), self.ancestor(b, power)
                if not same(above, other):
                    a, b = above, other
        return a, b

    def less(self, a: int, b: int) -> bool:
        """Whether string ``a`` comes before ``b``."""
        if a == b:
            return False
        depth = min(self.depth[a], self.depth[b])
        x, y = self.cut(a, depth), self.cut(b, depth)
        if x == y:
            return self.depth[a] < self.depth[b]
        x_, y_ = self._parted(x, y, lambda i, j: self.hash[i] == self.hash[j])
        if self.parent[x_] != self.parent[y_] or self.letter[x_] == self.letter[y_]:
            # Two different strings with one hash: look for the same node instead.
            x_, y_ = self._parted(x, y, lambda i, j: i == j)
        return self.letter[x_] < self.letter[y_]

    def text(self, node: int) -> str:
        letters = []
        while node:
            letters.append(self.letter[node])
            node = self.parent[node]
        return "".join(reversed(letters))


def _edits(initial: str, delete: bool) -> list[tuple[int, int, str, int]]:
    """(place before, place after, letter, price) of a row's edits."""
    edits = [(place, place, "D", DELETE) for place in range(4)]
    if not delete:
        kept = _KEEPS.get(initial, ())
        edits += [(a, b, "K", 0) for a, b in kept]
        # Where a row may be kept, another role for the same place is only dearer.
        edits += [(a, b, "R", REROLE) for a, b in _INSERTS if (a, b) not in kept]
    return edits


_TABLE = {(i, d): _edits(i, d) for i in ("s", "u", "a", "", "other") for d in (False, True)}

# What edits lead to a place: their price and their node.
Best = dict[int, tuple[int, int]]


def _offer(tree: Prefixes, best: Best, place: int, price: int, node: int, letter: str) -> bool:
    held = best.get(place)
    if held is None or price < held[0]:
        best[place] = (price, tree.extended(node, letter))
        return True
    if price == held[0]:
        other = tree.extended(node, letter)
        if tree.less(other, held[1]):
            best[place] = (price, other)
            return True
    return False


def with_inserts(tree: Prefixes, best: Best) -> Best:
    """``best`` after any inserts; they all cost something, so this comes to an end."""
    again = True
    while again:
        again = False
        for a, b in _INSERTS:
            if a in best:
                price, node = best[a]
                again |= _offer(tree, best, b, price + INSERT, node, "I")
    return best


def after_row(tree: Prefixes, best: Best, initial: str, delete: bool, truncated: bool) -> Best:
    """The best edits after one more row."""
    extra = TRUNCATED if truncated and not delete else 0
    known = initial if initial in _KEEPS else "other"
    found: Best = {}
    for a, b, letter, price in _TABLE[known, delete]:
        if a in best:
            before, node = best[a]
            more = price if letter == "D" else price + extra
            _offer(tree, found, b, before + more, node, letter)
    return with_inserts(tree, found)


class Segment:
    """Rows that follow each other in one conversation, and their faults."""

    def __init__(self, begins: bool):
        self.begins = begins  # whether the conversation is known to begin here
        self.rows: list[tuple[str, str]] = []
        self.flags: list[tuple[str, bool, bool]] = []  # initial, to be deleted, truncated
        self.chars = 0
        self.turns: tuple[int, int, int] | None = None  # first, last, how many
        self.blank = self.duplicate = self.truncated = self.illegal = 0

    def add(self, turn: int | None, role: str, text: str, seen: bool) -> None:
        end = text.rstrip(WHITE)
        blank, cut = not end, bool(end) and end[-1] not in ".!?"
        truncated = cut and not seen
        self.blank += blank
        self.duplicate += seen and not blank
        self.truncated += truncated
        if self.flags:
            self.illegal += self.flags[-1][0] + role[:1] not in ("su", "ua", "au")
        self.rows.append((role, text))
        self.flags.append((role[:1], blank or seen, truncated))
        self.chars += len(text)
        if turn is not None:
            first, last, n = self.turns or (turn, turn, 1)
            self.turns = (first, turn, n + (turn != last))

    @property
    def full(self) -> bool:
        return len(self.rows) >= SEGMENT_ROWS or self.chars >= SEGMENT_CHARS

    def best(self, tree: Prefixes, best: Best) -> Best:
        for initial, delete, truncated in self.flags:
            best = after_row(tree, best, initial, delete, truncated)
        return best

    def solved(self) -> tuple[int, str]:
        """Price and audit of a whole conversation."""
        tree = Prefixes()
        best = self.best(tree, with_inserts(tree, {START: (0, 0)}))
        price, node = best[START]  # all rows may be deleted
        if ASSISTANT in best:
            other, end = best[ASSISTANT]
            if other < price or other == price and tree.less(end, node):
                price, node = other, end
        return price, tree.text(node)

    def ways(self) -> list[dict]:
        """The best edits from every place to every place."""
        found = []
        for begin in range(4):
            tree = Prefixes()
            for end, (price, node) in self.best(tree, {begin: (0, 0)}).items():
                found.append({"begin": begin, "end": end, "price": price, "audit": tree.text(node)})
        return found


def repaired(rows: list[tuple[str, str]], audit: str, place: int) -> tuple[list[str], int]:
    """The turns that an audit leaves, each as ``role:text``, and the place after them."""
    turns, left = [], iter(rows)
    for letter in audit:
        role, text = ("", "") if letter == "I" else next(left)
        if letter == "D":
            continue
        if letter != "K":
            role = "assistant" if place == USER else "user"
        turns.append(f"{role}:{text}")
        place = {"s": SYSTEM, "u": USER, "a": ASSISTANT}.get(role[:1], place)
    return turns, place


def gaps(turns: tuple[int, int, int] | None) -> int:
    if turns is None:
        return 0
    first, last, n = turns
    return min(last - first + 1 - n, _MOST)


_RESULT = (
    "conv_id bigint, gaps bigint, blank bigint, duplicate bigint, truncated bigint,"
    " illegal bigint, cost bigint, audit string, repaired_sha256 string"
)
_OPEN = (
    "part bigint, number int, turns array<bigint>, initials array<string>,"
    " ways array<struct<begin:int,end:int,price:bigint,audit:string>>,"
    " rows array<struct<role:string,text:string>>"
)
_WAYS = pa.list_(
    pa.struct([("begin", pa.int32()), ("end", pa.int32()), ("price", pa.int64()), ("audit", pa.string())])
)
_ROWS = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))
_FIELDS = pa.schema(
    [
        ("conv_id", pa.int64()),
        *((name, pa.int64()) for name in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")),
        ("audit", pa.string()),
        ("repaired_sha256", pa.string()),
        ("part", pa.int64()),
        ("number", pa.int32()),
        ("turns", pa.list_(pa.int64())),
        ("initials", pa.list_(pa.string())),
        ("ways", _WAYS),
        ("rows", _ROWS),
    ]
)


def _closed(conv_id: int | None, segment: Segment) -> dict:
    price, audit = segment.solved()
    turns, _ = repaired(segment.rows, audit, START)
    return {
        "conv_id": conv_id,
        "gaps": gaps(segment.turns),
        "blank": segment.blank,
        "duplicate": segment.duplicate,
        "truncated": segment.truncated,
        "illegal": segment.illegal,
        "cost": price,
        "audit": audit,
        "repaired_sha256": hashlib.sha256("\n".join(turns).encode()).hexdigest(),
    }


def _open(conv_id: int | None, segment: Segment, part: int, number: int) -> dict:
    flags = segment.flags
    return {
        "conv_id": conv_id,
        "blank": segment.blank,
        "duplicate": segment.duplicate,
        "truncated": segment.truncated,
        "illegal": segment.illegal,
        "part": part,
        "number": number,
        "turns": segment.turns,
        "initials": [flags[0][0], flags[-1][0]] if flags else None,
        "ways": segment.ways(),
        "rows": [{"role": role, "text": text} for role, text in segment.rows],
    }


def _sorted_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        for at in range(0, batch.num_rows, 500):
            piece = batch.slice(at, 500)
            yield from zip(*(column.to_pylist() for column in piece.columns))


def _cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows of one range as finished conversations and as segments of unfinished ones."""
    part = TaskContext.get().partitionId()
    held: list[dict] = []
    held_chars = 0

    def flushed() -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist(held, schema=_FIELDS)

    conversation: tuple | None = None
    segment, number, cut = Segment(False), 0, False
    for conv_id, turn, role, text, copies, later in _sorted_rows(batches):
        if conversation != (conv_id,):
            if conversation is not None and segment.begins and not cut:
                held.append(_closed(conversation[0], segment))
            elif conversation is not None:
                held.append(_open(conversation[0], segment, part, number))
                held_chars, number = held_chars + segment.chars, number + 1
            segment, cut = Segment(conversation is not None), False
            conversation = (conv_id,)
        for copy in range(copies):
            if segment.full:
                held.append(_open(conv_id, segment, part, number))
                held_chars, number = held_chars + segment.chars, number + 1
                segment, cut = Segment(False), True
            segment.add(turn, role, text, later or copy > 0)
        if len(held) >= 500 or held_chars >= SEGMENT_CHARS:
            yield flushed()
            held.clear()
            held_chars = 0
    if conversation is not None:
        held.append(_open(conversation[0], segment, part, number))
    if held:
        yield flushed()


def _cheaper(path: tuple[int, tuple], other: tuple[int, tuple]) -> bool:
    """Whether a path through the same segments is cheaper, or as cheap and less in ASCII."""
    if path[0] != other[0]:
        return path[0] < other[0]
    pieces: tuple[list[str], list[str]] = ([], [])
    a, b = path[1], other[1]
    while a is not b and (a or b):
        for link, own in zip((a, b), pieces):
            if link:
                own.append(link[2])
        a, b = a and a[0], b and b[0]
    return "".join(reversed(pieces[0])) < "".join(reversed(pieces[1]))


def _joined_ways(group: pa.Table) -> pa.Table:
    """The segments of one conversation with the edits chosen for each."""
    segments = sorted(group.to_pylist(), key=lambda s: (s["part"], s["number"]))
    # By place: price, and the last of the links (link before, place before, audit).
    nothing = (None, START, "")
    paths: dict[int, tuple[int, tuple]] = {
        START: (0, nothing),
        USER: (INSERT, (nothing, START, "I")),
        ASSISTANT: (2 * INSERT, (nothing, START, "II")),
    }
    total = dict.fromkeys(("blank", "duplicate", "truncated", "illegal"), 0)
    turns, initial = None, None
    for segment in segments:
        found: dict[int, tuple[int, tuple]] = {}
        for way in segment["ways"]:
            if way["begin"] in paths:
                price, link = paths[way["begin"]]
                path = (price + way["price"], (link, way["begin"], way["audit"]))
                held = found.get(way["end"])
                if held is None or _cheaper(path, held):
                    found[way["end"]] = path
        paths = found
        for name in total:
            total[name] += segment[name]
        if segment["initials"]:
            if initial is not None:
                total["illegal"] += initial + segment["initials"][0] not in ("su", "ua", "au")
            initial = segment["initials"][1]
        if segment["turns"]:
            first, last, n = segment["turns"]
            if turns:
                n += turns[2] - (turns[1] == first)
                first = turns[0]
            turns = (first, last, n)
    best = paths[START]
    if ASSISTANT in paths and _cheaper(paths[ASSISTANT], best):
        best = paths[ASSISTANT]
    price, link = best
    begins, audits = [], []
    for _ in segments:
        link, begin, audit = link
        begins.append(begin)
        audits.append(audit)
    begins.reverse()
    audits.reverse()
    # Inserts before the first row belong to the first segment.
    begins[0], audits[0] = START, link[2] + audits[0]
    rows = [
        {
            "conv_id": segment["conv_id"],
            "part": segment["part"],
            "number": segment["number"],
            "place": place,
            "audit": audit,
            "last": segment is segments[-1],
            "gaps": gaps(turns),
            "cost": price,
            **total,
        }
        for segment, place, audit in zip(segments, begins, audits)
    ]
    return pa.Table.from_pylist(rows, schema=_CHOSEN_FIELDS)


_CHOSEN = (
    "conv_id bigint, part bigint, number int, place int, audit string, last boolean, gaps bigint,"
    " cost bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint"
)
_CHOSEN_FIELDS = pa.schema(
    [
        ("conv_id", pa.int64()),
        ("part", pa.int64()),
        ("number", pa.int32()),
        ("place", pa.int32()),
        ("audit", pa.string()),
        ("last", pa.bool_()),
        *((name, pa.int64()) for name in ("gaps", "cost", "blank", "duplicate", "truncated", "illegal")),
    ]
)


def _finished(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments in order, with the edits chosen for each, as one row per conversation."""
    names = _FIELDS.names[:9]
    hashed, some, audits = hashlib.sha256(), False, []
    for batch in batches:
        for at in range(batch.num_rows):
            (row,) = batch.slice(at, 1).to_pylist()
            rows = [(r["role"], r["text"]) for r in row["rows"]]
            turns, _ = repaired(rows, row["audit"], row["place"])
            for turn in turns:
                hashed.update(b"\n" if some else b"")
                hashed.update(turn.encode())
                some = True
            audits.append(row["audit"])
            if row["last"]:
                whole = {**row, "audit": "".join(audits), "repaired_sha256": hashed.hexdigest()}
                yield pa.RecordBatch.from_pylist(
                    [{name: whole[name] for name in names}],
                    schema=pa.schema([_FIELDS.field(name) for name in names]),
                )
                hashed, some, audits = hashlib.sha256(), False, []


def repairs(turns: DataFrame) -> DataFrame:
    """Per conversation of ``turns`` (conv_id, turn, role, text, copies): faults, price and audit
    of the cheapest repair, and the hash of the repaired text.

    ``copies`` says how often a row occurs; a conversation whose rows all have none is empty.
    """
    importable(turns.sparkSession)
    spaces = {name: F.coalesce(F.col(name), F.lit(" ")) for name in ("role", "text")}
    turns = turns.select("conv_id", "turn", "role", "text", "copies").withColumns(spaces)
    hashed = F.sha2("text", 256).alias("_hash")
    when = F.struct(F.col("turn").isNotNull().alias("known"), F.coalesce("turn", F.lit(0)).alias("turn"))
    # Texts that occur at several turns of a conversation, with the first of them.
    spread = (
        turns.where("copies > 0")
        .select("conv_id", "role", hashed, when.alias("_when"))
        .groupBy("conv_id", "role", "_hash")
        .agg(F.min("_when").alias("_first"), F.max("_when").alias("_last"))
        .where("_first < _last")
    )
    rows = (
        turns.groupBy("conv_id", "turn", "role", "text")
        .agg(F.sum("copies").alias("copies"))
        .withColumns({"_hash": hashed, "_when": when})
    )
    same = (
        F.col("r.conv_id").eqNullSafe(F.col("s.conv_id"))
        & (F.col("r.role") == F.col("s.role"))
        & (F.col("r._hash") == F.col("s._hash"))
    )
    placed = (
        rows.alias("r")
        .join(spread.alias("s"), same, "left")
        .select("r.*", F.coalesce(F.col("r._when") > F.col("s._first"), F.lit(False)).alias("later"))
        .orderBy(F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), "role", "_hash")
        .select("conv_id", "turn", "role", "text", "copies", "later")
    )
    cut = written(placed.mapInArrow(_cut_up, f"{_RESULT}, {_OPEN}"))
    names = _FIELDS.names[:9]
    pieces = cut.where("part IS NOT NULL")
    chosen = (
        pieces.select(
            "conv_id", "blank", "duplicate", "truncated", "illegal", "part", "number", "turns", "initials", "ways"
        )
        .groupBy("conv_id")
        .applyInArrow(_joined_ways, _CHOSEN)
    )
    both = (
        pieces.select("part", "number", "rows")
        .join(chosen, ["part", "number"])
        .repartition("conv_id")
        .sortWithinPartitions("conv_id", "part", "number")
    )
    finished = both.mapInArrow(_finished, _RESULT)
    return cut.where("part IS NULL").select(*names).unionAll(finished)


def damaged(turns: DataFrame) -> DataFrame:
    """``turns`` with planted faults, by a hash of conversation and turn: rows that are missing,
    empty, without ends of sentences, repeated, or of another role."""
    key = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")))
    role, text = (F.coalesce(F.col(c), F.lit(" ")) for c in ("role", "text"))
    kind = F.col("_kind")
    gone = kind == 0
    return turns.select(
        F.col("conv_id").cast("bigint"),
        F.col("turn").cast("bigint"),
        role.alias("role"),
        text.alias("text"),
        (F.crc32(key) % 20).alias("_kind"),
    ).select(
        "conv_id",
        F.when(~gone, F.col("turn")).alias("turn"),
        F.when(gone, "").when(kind == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(kind.isin(0, 1), "")
        .when(kind == 2, F.translate("text", ".!?", ""))
        .otherwise(F.col("text"))
        .alias("text"),
        F.when(gone, 0).when(kind == 3, 2).otherwise(1).cast("bigint").alias("copies"),
    )


def audited(turns: DataFrame) -> DataFrame:
    """Repairs of the damaged ``turns``, one row per conversation of ``turns``."""
    return repairs(damaged(turns))
