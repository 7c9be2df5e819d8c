"""Secrets in texts: three plain patterns, and probabilistic automata learnt from their finds.

Values that the patterns find are labelled credentials. Per kind, a prefix tree of a bounded
sample of distinct values (``SAMPLE``, picked by hash, of up to ``LONGEST_TAUGHT`` characters) is
made an automaton by merging states
whose frequencies of ending and of going on do not differ beyond a Hoeffding bound,
recursively with the states below them. Letters are grouped into classes, so that an automaton
learns formats rather than values. One more automaton is learnt from runs of the same
characters that no pattern found. Every such run in any text, of ``SHORTEST`` characters or
more, is then scored: it is added as a secret of the likeliest kind if it is more likely a
credential than an ordinary run by ``MARGIN`` bits. So are what a pattern's find leaves of a run,
what follows the first ``=`` of a run, and each part between separators; of those that overlap,
the longest credential is added.

Spans are in code points, end exclusive; those of the patterns cover the whole match and
always stay. Added spans do not overlap them. Null counts as the empty text.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect
from collections.abc import Iterable, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tallytide.llm.common import map_batches, texts_of, written

KINDS = ("assign", "access", "hex")
SAMPLE = 500
LONGEST_TAUGHT = 512
SHORTEST = 16
MARGIN = 16.0

# How unlikely a difference between two states of one kind must be to keep them apart.
ALPHA = 0.02

# The patterns, with the least length of what they find.
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    re.IGNORECASE | re.ASCII,
)
LEAST_ASSIGN = 6
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")

_PART = re.compile(rf"[A-Za-z0-9]{{{SHORTEST},}}")
_NAME = re.compile("[^=]*=+")
_RUN = re.compile(rf"[A-Za-z0-9+/_=-]{{{SHORTEST},}}")

# Classes of characters and their sizes; others stand for themselves.
_CLASSES = {
    **dict.fromkeys("0123456789", "0"),
    **dict.fromkeys("abcdef", "a"),
    **dict.fromkeys("ghijklmnopqrstuvwxyz", "z"),
    **dict.fromkeys("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "A"),
}
_SIZES = {"0": 10, "a": 6, "z": 20, "A": 26}

Span = tuple[str, int, int]


def base_spans(text: str) -> list[tuple[str, int, int, str]]:
    """(kind, start, end, value) of the patterns' finds, by start and then kind."""
    found = []
    if ":" in text or "=" in text:
        for m in ASSIGN.finditer(text):
            if len(m[2]) >= LEAST_ASSIGN:
                found.append(("assign", *m.span(), m[2]))
    if "AKIA" in text:
        found += [("access", *m.span(), m[0]) for m in ACCESS.finditer(text)]
    found += [("hex", *m.span(), m[0]) for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


def runs(
    text: str, taken: Sequence[tuple[str, int, int, str]]
) -> list[tuple[str, int, int, str]]:
    """Candidates: (kind, start, end, value) of runs beside the patterns' finds and of their parts.

    ``taken`` is sorted by start. The kind is empty; it is ``rest`` for what follows an ``=``,
    which is scored only.
    """
    found: dict[tuple[int, int], str] = {}
    near, at = [], 0
    for m in _RUN.finditer(text):
        # Runs and finds are both in order; at most one find per kind reaches from run to run.
        near = [span for span in near if span[2] > m.start()]
        while at < len(taken) and taken[at][1] < m.end():
            if taken[at][2] > m.start():
                near.append(taken[at])
            at += 1
        begin, pieces = m.start(), []
        for _, start, end, _ in near:
            pieces.append((begin, start))
            begin = max(begin, end)
        for start, end in [*pieces, (begin, m.end())]:
            if end - start < SHORTEST:
                continue
            found[start, end] = ""
            found |= {p.span(): "" for p in _PART.finditer(text, start, end)}
            name = _NAME.match(text, start, end)
            if name:
                found.setdefault((name.end(), end), "rest")
    return [(k, b, e, text[b:e]) for (b, e), k in sorted(found.items()) if e - b >= SHORTEST]


def longest_apart(spans: Iterable[Span]) -> list[Span]:
    """The longest spans that do not overlap, the first one of equals."""
    kept: list[tuple[int, int, str]] = []
    for kind, start, end in sorted(spans, key=lambda s: (s[1] - s[2], s[1])):
        at = bisect(kept, (start,))
        if (at == 0 or kept[at - 1][1] <= start) and (at == len(kept) or end <= kept[at][0]):
            kept.insert(at, (start, end, kind))
    return [(kind, start, end) for start, end, kind in kept]


class Automaton:
    """A probabilistic automaton over character classes."""

    def __init__(self, values: Iterable[str], alpha: float = ALPHA):
        self.next: list[dict[str, int]] = [{}]
        self.passed: list[dict[str, int]] = [{}]
        self.ended = [0]
        for value in values:
            state = 0
            for letter in value:
                c = _CLASSES.get(letter, letter)
                if c not in self.next[state]:
                    self.next[state][c] = len(self.next)
                    self.next.append({})
                    self.passed.append({})
                    self.ended.append(0)
                self.passed[state][c] = self.passed[state].get(c, 0) + 1
                state = self.next[state][c]
            self.ended[state] += 1
        self._merge(alpha)

    def _arrived(self, state: int) -> int:
        return self.ended[state] + sum(self.passed[state].values())

    def _alike(self, a: int, b: int, alpha: float) -> bool:
        """Whether two states differ no more than chance, and all pairs below them."""
        bound = math.sqrt(0.5 * math.log(2 / alpha))
        waiting = [(a, b)]
        while waiting:
            a, b = waiting.pop()
            n, m = self._arrived(a), self._arrived(b)
            if not n or not m:
                continue
            limit = bound * (1 / math.sqrt(n) + 1 / math.sqrt(m))
            if abs(self.ended[a] / n - self.ended[b] / m) > limit:
                return False
            for c in self.passed[a].keys() | self.passed[b].keys():
                if abs(self.passed[a].get(c, 0) / n - self.passed[b].get(c, 0) / m) > limit:
                    return False
            waiting += [
                (self.next[a][c], self.next[b][c]) for c in self.next[a].keys() & self.next[b].keys()
            ]
        return True

    def _fold(self, into: int, tree: int) -> None:
        """Add the counts of a subtree to a state and those it leads to."""
        waiting = [(into, tree)]
        while waiting:
            a, b = waiting.pop()
            self.ended[a] += self.ended[b]
            for c, count in self.passed[b].items():
                self.passed[a][c] = self.passed[a].get(c, 0) + count
                if c in self.next[a]:
                    waiting.append((self.next[a][c], self.next[b][c]))
                else:
                    self.next[a][c] = self.next[b][c]

    def _merge(self, alpha: float) -> None:
        """Red states are settled; blue ones, next to them, are merged into one or settled."""
        red = [0]
        while True:
            settled = set(red)
            blue = [(r, c, s) for r in red for c, s in sorted(self.next[r].items()) if s not in settled]
            if not blue:
                return
            before, c, state = blue[0]
            for r in red:
                if self._alike(r, state, alpha):
                    self.next[before][c] = r
                    self._fold(r, state)
                    break
            else:
                red.append(state)

    def bits(self, value: str) -> float:
        """Minus the base-2 logarithm of the probability of a value; unseen steps are smoothed."""
        state: int | None = 0
        total = 0.0
        for letter in value:
            c = _CLASSES.get(letter, letter)
            seen = self._arrived(state) if state is not None else 0
            count = self.passed[state].get(c, 0) if state is not None else 0
            total -= math.log2((count + 0.05) / (seen + 0.05 * 12))
            total += math.log2(_SIZES.get(c, 1))
            state = self.next[state].get(c) if state is not None else None
        seen = self._arrived(state) if state is not None else 0
        ended = self.ended[state] if state is not None else 0
        return total - math.log2((ended + 0.05) / (seen + 0.05 * 12))


class Scorer:
    """Tells credentials from ordinary runs by the automata of both."""

    def __init__(self, samples: dict[str, list[str]], margin: float = MARGIN):
        self.kinds = {k: Automaton(samples[k]) for k in KINDS if samples.get(k)}
        self.ordinary = Automaton(samples.get("", []))
        self.margin = margin

    def kind(self, value: str) -> str | None:
        scores = [(a.bits(value), KINDS.index(k)) for k, a in self.kinds.items()]
        if not scores:
            return None
        bits, index = min(scores)
        return KINDS[index] if self.ordinary.bits(value) - bits >= self.margin else None


def as_text(spans: Iterable[Span]) -> str:
    ordered = sorted(spans, key=lambda s: (s[1], KINDS.index(s[0])))
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in ordered)


_SPANS = "array<struct<kind:string,start:bigint,end:bigint,value:string>>"
_SPAN_TYPE = pa.list_(
    pa.struct(
        [("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("value", pa.string())]
    )
)


def scan(docs: DataFrame, id: str, text: str) -> DataFrame:
    """(doc_id, base, runs): finds of the patterns and candidates, runs with an empty kind."""

    def columns(batch: pa.RecordBatch) -> list:
        base, others = [], []
        for value in texts_of(batch.column(1)):
            found = base_spans(value)
            as_dict = lambda s: dict(zip(("kind", "start", "end", "value"), s))
            base.append([as_dict(s) for s in found])
            others.append([as_dict(s) for s in runs(value, found)])
        return [batch.column(0), pa.array(base, _SPAN_TYPE), pa.array(others, _SPAN_TYPE)]

    rows = docs.select(F.col(id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    return map_batches(rows, columns, f"doc_id bigint; base {_SPANS}; runs {_SPANS}", ";")


def samples(scanned: DataFrame, size: int = SAMPLE) -> dict[str, list[str]]:
    """Up to ``size`` distinct values of each kind and of the other runs (kind '').

    Those of more than ``LONGEST_TAUGHT`` characters teach nothing; they are scored like others.
    """
    values = (
        scanned.select(F.explode(F.concat("base", "runs")).alias("s"))
        .select("s.kind", "s.value")
        .where(F.length("value") <= LONGEST_TAUGHT)
    )
    found = {}
    for kind in (*KINDS, ""):
        of_kind = values.where(F.col("kind") == kind).select("value").distinct()
        picked = of_kind.orderBy(F.xxhash64("value"), "value").limit(size).collect()
        found[kind] = [row["value"] for row in picked]
    return found


def secrets(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans) of every row.

    Counts and digest are of the patterns' finds alone; ``spans`` has those added as well.
    """
    scanned = written(scan(docs, id, text))
    learnt = samples(scanned)
    scorer = Scorer(learnt)

    def columns(batch: pa.RecordBatch) -> list:
        rows = []
        for base, others in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            found = [(s["kind"], s["start"], s["end"]) for s in base]
            added = [(scorer.kind(s["value"]), s["start"], s["end"]) for s in others]
            rows.append(
                (
                    *(sum(s[0] == kind for s in found) for kind in KINDS),
                    hashlib.sha256(as_text(found).encode()).hexdigest(),
                    as_text([*found, *longest_apart(s for s in added if s[0])]),
                )
            )
        kinds = [pa.int64()] * 3 + [pa.string()] * 2
        made = zip(*rows) if rows else [[]] * 5
        return [batch.column(0), *(pa.array(c, k) for c, k in zip(made, kinds))]

    schema = (
        "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string,"
        " spans string"
    )
    return map_batches(scanned, columns, schema)
