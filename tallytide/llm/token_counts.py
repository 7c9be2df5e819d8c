"""Exact token counts of every prefix of a text, by dynamic programming over byte-level BPE.

A sequence of tokens is what BPE makes of its text exactly if every two neighbours stay apart
when encoded together. So the last token of a prefix is the one token that ends there and
stays apart from the last token of the prefix before it; counts of all prefixes of a word
come from one pass over its bytes, and no prefix is encoded again.

Words are separate: a text's table is the running sum over its words plus the table inside
each word. It answers how many tokens a prefix has, and which prefix is the longest within
a budget, from at most the last two words.

Null counts as the empty text. Special strings inside a text count one token each, as the
library treats them by default. Texts are never cut.
"""

from __future__ import annotations

import json
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import cache
from itertools import accumulate

import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from tallytide.llm.common import map_batches, texts_of

VOCABULARY = "byte_bpe_50k.json"
LIMIT = 512

# Words and neighbours remembered by a worker; the memory is emptied when it is full, by number or
# by the code points of its words.
REMEMBERED = 400_000
REMEMBERED_CHARS = 32_000_000

# How the tokenizer cuts text into words, and white space as it sees it.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SPACE = r"\t-\r \x85\xa0  -     　"

# A unit is a run without white space, with the blank before it, or a run of white space.
_IS_SPACE = re.compile(f"[{SPACE}]")
_UNIT = re.compile(f" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")


def _byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in the vocabulary file."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class PrefixCounter:
    """Token counts of prefixes under one vocabulary."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            content = json.load(file)
        letters = _byte_letters()
        special = [t["content"] for t in content["added_tokens"]]
        raw = lambda token: bytes(letters[c] for c in token)
        self.tokens = {raw(t) for t in content["model"]["vocab"] if t not in special}
        lengths: dict[bytes, set[int]] = {}
        for token in self.tokens:
            if len(token) > 2:
                lengths.setdefault(token[-3:], set()).add(len(token))
        # Lengths of the longer tokens by their last three bytes, longest first.
        self.lengths = {end: tuple(sorted(of, reverse=True)) for end, of in lengths.items()}
        merges = (m.split(" ") if isinstance(m, str) else m for m in content["model"]["merges"])
        self.ranks = {(raw(a), raw(b)): rank for rank, (a, b) in enumerate(merges)}
        self.pieces = regex.compile(PIECES)
        self.special = re.compile("|".join(map(re.escape, special))) if special else None
        self.apart: dict[tuple[bytes, bytes], bool] = {}
        self.words: dict[str, int] = {}
        self.units: dict[str, int] = {}
        self.chars = 0
        # Then white space before a cut is a word of its own, whatever stands before it.
        self.space_apart = not any(_IS_SPACE.search(t) for t in special)

    def _stay_apart(self, left: bytes, right: bytes) -> bool:
        """Whether BPE leaves the two tokens as they are when they stand together."""
        parts = [bytes([b]) for b in left + right]
        while len(parts) > 2:
            ranked = [
                (rank, i)
                for i, pair in enumerate(zip(parts, parts[1:]))
                if (rank := self.ranks.get(pair)) is not None
            ]
            if not ranked:
                return False
            _, i = min(ranked)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return len(parts) < 2 or (parts == [left, right] and (left, right) not in self.ranks)

    def byte_prefixes(self, word: bytes) -> list[int]:
        """Token counts of the first 0, 1, ... bytes of a word."""
        tokens, apart, lengths = self.tokens, self.apart, self.lengths
        counts, last = [0], [b""]
        for end in range(1, len(word) + 1):
            for length in (*lengths.get(word[max(0, end - 3) : end], ()), 2, 1):
                start = end - length
                token = word[start:end]
                if start < 0 or token not in tokens:
                    continue
                if start:
                    pair = (last[start], token)
                    fits = apart.get(pair)
                    if fits is None:
                        if len(apart) >= REMEMBERED:
                            apart.clear()
                        fits = apart[pair] = self._stay_apart(*pair)
                    if not fits:
                        continue
                counts.append(counts[start] + 1)
                last.append(token)
                break
        return counts

    def _make_room(self, memory: dict[str, int], word: str) -> None:
        self.chars += len(word)
        if len(memory) >= REMEMBERED:
            memory.clear()
        if self.chars > REMEMBERED_CHARS:
            self.words.clear()
            self.units.clear()
            self.chars = len(word)

    def _piece(self, piece: str) -> int:
        found = self.words.get(piece)
        if found is None:
            self._make_room(self.words, piece)
            found = self.words[piece] = self.byte_prefixes(piece.encode())[-1]
        return found

    def _unit(self, unit: str) -> int:
        found = self.units.get(unit)
        if found is None:
            self._make_room(self.units, unit)
            found = self.units[unit] = sum(map(self._piece, self.pieces.findall(unit)))
        return found

    def segments(self, text: str) -> tuple[list[str], list[int]]:
        """The units of a text, special strings among them, and the tokens of each."""
        units: list[str] = []
        counts: list[int] = []
        at = 0
        for match in self.special.finditer(text) if self.special else ():
            part = _UNIT.findall(text[at : match.start()])
            units += [*part, match[0]]
            counts += [*map(self._unit, part), 1]
            at = match.end()
        part = _UNIT.findall(text[at:] if at else text)
        get = self.units.get
        found = list(map(get, part))
        if None in found:
            found = [self._unit(u) if n is None else n for u, n in zip(part, found)]
        return units + part, counts + found


    def total(self, text: str) -> int:
        return sum(self.segments(text)[1])

    def table(self, text: str) -> "PrefixTable":
        return PrefixTable(self, text)


class PrefixTable:
    """The counts of every prefix of one text."""

    def __init__(self, counter: PrefixCounter, text: str):
        self.counter, self.text = counter, text
        units, counts = counter.segments(text)
        self.ends = list(accumulate(map(len, units), initial=0))
        self.counts = list(accumulate(counts, initial=0))
        # The run of white space asked for last: where it begins, and the tokens up to each place.
        self._run: tuple[int, list[int]] = (0, [])

    @property
    def total(self) -> int:
        return self.counts[-1]

    def _start(self, unit: int) -> int:
        """The unit whose start is unaffected by a cut inside ``unit``."""
        return max(0, unit - 2)

    def count_at(self, offset: int) -> int:
        """Tokens of the first ``offset`` code points."""
        if offset and self.counter.space_apart and _IS_SPACE.match(self.text, offset - 1):
            return self._count_in_space(offset)
        first = self._start(bisect_left(self.ends, offset) - 1)
        return self.counts[first] + self.counter.total(self.text[self.ends[first] : offset])

    def _count_in_space(self, offset: int) -> int:
        """Tokens of a prefix that ends with white space.

        All white space at its end is one word there, so one table serves every prefix that ends in
        the same run.
        """
        begin, counts = self._run
        if not begin < offset < begin + len(counts):
            begin = end = offset - 1
            while begin and _IS_SPACE.match(self.text, begin - 1):
                begin -= 1
            while end < len(self.text) and _IS_SPACE.match(self.text, end):
                end += 1
            run = self.text[begin:end]
            inside = self.counter.byte_prefixes(run.encode())
            places = accumulate((len(letter.encode()) for letter in run), initial=0)
            before = self.count_at(begin)
            counts = [before + inside[place] for place in places]
            self._run = (begin, counts)
        return counts[offset - begin]

    def _cuts(self, unit: int) -> Iterator[tuple[int, int]]:
        """(offset, tokens) of the prefixes that end in a unit, its end included, last first."""
        counter, at, before = self.counter, self.ends[unit], self.counts[unit]
        found: list[tuple[int, int | None]] = []
        if counter.special and counter.special.fullmatch(self.text, at, self.ends[unit + 1]):
            found = [(offset, None) for offset in range(at + 1, self.ends[unit + 1] + 1)]
            at = self.ends[unit + 1]
        for piece in counter.pieces.findall(self.text[at : self.ends[unit + 1]]):
            inside = counter.byte_prefixes(piece.encode())
            size = 0
            for i, letter in enumerate(piece, 1):
                size += len(letter.encode())
                # White space at the end, or a contraction cut short, is divided anew.
                known = not letter.isspace() and piece[0] != "'"
                found.append((at + i, before + inside[size] if known else None))
            at, before = at + len(piece), before + inside[-1]
        for offset, count in reversed(found):
            yield offset, self.count_at(offset) if count is None else count

    def longest_within(self, budget: int) -> int:
        """Code points of the longest prefix with at most ``budget`` tokens.

        White space at the end of a prefix is one piece there and may be two in the text, and a
        cut inside a word may take fewer tokens than a shorter one. So each cut of the first
        two units beyond the budget is looked at.
        """
        if self.total <= budget:
            return len(self.text)
        over = bisect_right(self.counts, budget)
        for unit in range(min(over, len(self.ends) - 2), over - 2, -1):
            for offset, count in self._cuts(unit):
                if count <= budget:
                    return offset
        return self.ends[over - 1]


@cache
def counter(vocabulary: str = VOCABULARY) -> PrefixCounter:
    """One counter per worker and vocabulary; a name or a path."""
    return PrefixCounter(vocabulary if "/" in vocabulary else public_tokenizers.path(vocabulary))


def token_counts(
    docs: DataFrame,
    id: str = "doc_id",
    text: str = "text",
    limit: int = LIMIT,
    vocabulary: str = VOCABULARY,
) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit, cut_at): ``cut_at`` is the length in code points
    of the longest prefix within the limit."""

    def columns(batch: pa.RecordBatch) -> list:
        count = counter(vocabulary)
        texts = texts_of(batch.column(1))
        n_tokens, cuts = [], []
        for value in texts:
            prefixes = count.table(value)
            n_tokens.append(prefixes.total)
            cuts.append(prefixes.longest_within(limit))
        return [
            batch.column(0),
            pa.array([len(value.encode()) for value in texts], pa.int64()),
            pa.array(n_tokens, pa.int64()),
            pa.array([n > limit for n in n_tokens], pa.bool_()),
            pa.array(cuts, pa.int64()),
        ]

    schema = "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean, cut_at bigint"
    return map_batches(
        docs.select(F.col(id).cast("bigint").alias("doc_id"), F.col(text).alias("text")),
        columns,
        schema,
    )
