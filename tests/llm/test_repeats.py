"""Repeated strings against a dictionary of all strings."""

import hashlib
import os
import random
import sys

sys.path.insert(0, os.path.dirname(__file__))

import edge
import numpy as np
import pytest

from tallytide.llm import repeats
from tallytide.llm.common import table

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def plain(rows, length):
    """Rows (doc_id, text), in the order of the contract."""
    first, found = set(), []
    for doc_id, text in rows:
        data = (text or "").encode()
        gone = np.zeros(len(data), bool)
        for at in range(len(data) - length + 1):
            piece = data[at : at + length]
            if piece in first:
                gone[at : at + length] = True
            first.add(piece)
        kept = bytes(np.frombuffer(data, np.uint8)[~gone])
        spans = int((np.diff(gone.astype(int), prepend=0) == 1).sum())
        found.append((doc_id, len(data), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return found


def result(spark, rows, length, gram, parts=5):
    docs = edge.documents(spark, *rows).repartition(parts)
    return [tuple(r) for r in repeats.digests(repeats.without_repeats(docs, length, gram)).collect()]


def words(rng, n):
    return " ".join(rng.choice(["the", "of", "and", "é", "日本"] + [f"w{i}" for i in range(90)]) for _ in range(n))


def made_up(seed, n):
    rng = random.Random(seed)
    shared = [words(rng, 40) for _ in range(4)]
    rows = []
    for i in range(n):
        text = words(rng, rng.randrange(60))
        for _ in range(rng.randrange(3)):
            piece = rng.choice(shared)
            at = rng.randrange(len(piece))
            text = text[: len(text) // 2] + piece[at % 30 :][: rng.choice([20, 60, 400])] + text[len(text) // 2 :]
        if rows and rng.random() < 0.3:
            other = list(rng.choice(rows)[1])
            for _ in range(rng.randrange(4)):
                other[rng.randrange(len(other)) : 0] = "x"
            text = "".join(other)
        rows.append((rng.randrange(10**9) if i % 9 else i, text))
    return rows


@pytest.mark.parametrize("length,gram", [(12, 4), (13, 9), (30, 15), (100, 50)])
def test_cuts_equal_those_of_a_dictionary(spark, length, gram):
    rows = [(i, t) for i, t in sorted(made_up(length, 120)) if t]
    rows = list(dict(rows).items())
    rows += [(10**10, "a" * 500), (10**10 + 1, "ab" * 200), (10**10 + 2, ""), (10**10 + 3, None)]
    rows += [(10**10 + 4, rows[3][1] * 3)]
    assert sorted(result(spark, rows, length, gram)) == plain(rows, length)


def test_frequent_strings_over_many_ranges(spark):
    passage = words(random.Random(5), 60)
    rows = [(i, f"{i} {passage[i % 3 :]} {i * 7919}") for i in range(600)] + [(600 + i, passage) for i in range(200)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert sorted(result(spark, rows, 40, 20)) == plain(rows, 40)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_texts_longer_than_a_piece(spark):
    rng = np.random.default_rng(6)
    text = "".join(map(chr, rng.integers(97, 123, repeats.PIECE * 2 + 77)))
    rows = [(1, text), (2, text[5:90]), (3, "z" + text[repeats.PIECE - 60 : repeats.PIECE + 160] + "z"), (4, text[:-1])]
    found = sorted(result(spark, rows, 100, 50))
    n = len(text)
    assert [r[1:4] for r in found] == [(n, 0, 0), (85, 0, 0), (222, 220, 1), (n - 1, n - 1, 1)]


def test_repeated_and_missing_ids(spark):
    a, b = ("some text that is long enough " * 2, "another text that is long enough " * 2)
    rows = [(1, a), (1, a), (1, b), (None, b), (None, b), (None, "short"), (None, "short"), (2, None), (2, None)]
    found = result(spark, rows, 40, 20)
    ordered = sorted(rows[3:7], key=lambda r: r[1]) + rows[:3] + rows[7:]
    expected = plain(ordered, 40)
    removed = lambda rs: sorted(((r[0] is not None, r[0] or 0), r[1], r[2]) for r in rs)
    assert removed(found) == removed(expected)


def test_odd_and_empty_tables(spark):
    found = repeats.digests(repeats.without_repeats(edge.odd(spark)))
    assert found.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    rows = {r["doc_id"]: r for r in found.collect()}
    size = len(edge.PASSAGE.encode())
    assert (rows[1]["n_removed"], rows[2]["n_removed"]) == (0, size)
    assert found.count() == len(edge.ODD_ROWS)
    assert repeats.without_repeats(edge.none(spark)).count() == 0


def test_query_equals_a_dictionary(spark):
    docs = table(spark, SF_DIR, "documents")
    rows = sorted(tuple(r) for r in docs.select("doc_id", "text").collect())
    found = repeats.digests(repeats.without_repeats(docs)).collect()
    assert sorted(map(tuple, found)) == plain(rows, repeats.LENGTH)
