"""The Merkle manifest against trees built level by level."""

import hashlib
import os
import sys
import zlib

sys.path.insert(0, os.path.dirname(__file__))

import edge
import pytest
from pyspark.sql import functions as F

from tallytide.llm import merkle


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def tree(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        below = levels[-1]
        levels.append([digest(*below[i : i + 2]) for i in range(0, len(below), 2)])
    return levels


def siblings(levels, place):
    """(is the sibling on the left, sibling or None) from the bottom up."""
    found = []
    for level in levels[:-1]:
        other = place ^ 1
        found.append((place & 1, level[other] if other < len(level) else None))
        place //= 2
    return found


def leaf(row, more=0):
    values = (*row[:3], None if row[3] is None else row[3] + more, row[4])
    return digest(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def plain(rows):
    groups = {}
    for row in rows:
        groups.setdefault(row[2], []).append(row)
    names = sorted(groups, key=lambda name: (name is not None, (name or "").encode()))
    trees = {}
    for name in names:
        groups[name].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[name] = tree([leaf(row) for row in groups[name]])
    top = tree([trees[name][-1][0] for name in names])
    root = top[-1][0]
    found = []
    for k, name in enumerate(names):
        for i, row in enumerate(groups[name]):
            proof = siblings(trees[name], i) + siblings(top, k)
            tampered = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 7 == 0
            node = leaf(row, 1 if tampered else 0)
            for left, other in proof:
                node = digest(node) if other is None else digest(*((other, node) if left else (node, other)))
            path = digest(*(other for _, other in proof if other))
            found.append((row[0], leaf(row), trees[name][-1][0], root, path, node, node == root))
    return sorted(found, key=repr)


def test_positions_are_those_of_the_append_log():
    for n in range(1, 70):
        leaves = [f"{i}" for i in range(n)]
        levels = tree(leaves)
        log = merkle.append_log(leaves, len(levels) - 1)
        assert len(log) == sum(map(len, levels)) == merkle.position(len(levels) - 1, 0, n) + 1
        for level, nodes in enumerate(levels):
            for place, node in enumerate(nodes):
                assert log[merkle.position(level, place, n)] == node


@pytest.mark.parametrize("height", [1, 3, merkle.HEIGHT])
def test_proofs_equal_those_of_trees_built_level_by_level(spark, height):
    rows = [(i, f"text {i}" * (i % 4), ("en", "de", None, "é", "z")[i % 5 if i < 60 else 0], "s", i) for i in range(150)]
    rows += [(7, None, "single", None, None), (8, "", "", "", None), (2**40, "x", "en", "s", 2**63 - 1)]
    rows = [(i, text, lang, source, n) for i, text, lang, source, n in rows]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    docs = docs.withColumns({"n": F.lit(1), "grp": F.lit("x"), "id": F.lit(2), "digest": F.lit("y")})
    found = merkle.verified_rows(docs.repartition(5), height).collect()
    expected = plain([(i, source, lang, n, text) for i, text, lang, source, n in rows])
    assert sorted(map(tuple, found), key=repr) == expected
    assert any(r["verified"] for r in found) and not all(r["verified"] for r in found)


def test_odd_single_and_no_rows(spark):
    odd = edge.odd(spark)
    found = sorted(map(tuple, merkle.verified_rows(odd, 2).collect()), key=repr)
    assert found == plain([tuple(r) for r in odd.select(*merkle.COLUMNS).collect()])
    one = edge.documents(spark, (3, "t", "en", "a"))
    (row,) = merkle.verified_rows(one).collect()
    assert row["root"] == row["subroot"] == row["leaf"] and row["proof_sha256"] == digest()
    assert merkle.verified_rows(edge.none(spark)).count() == 0


def test_every_changed_column_changes_the_root(spark):
    rows = [(i, f"text {i}", "en", "a") for i in range(9)]
    roots = {merkle.manifest(edge.documents(spark, *rows)).root}
    for changed in ((3, "Text 3", "en", "a"), (3, "text 3", "de", "a"), (3, "text 3", "en", None), (9, "text 3", "en", "a")):
        roots.add(merkle.manifest(edge.documents(spark, *rows[:3], changed, *rows[4:])).root)
    assert len(roots) == 5


def test_the_log_holds_every_run(spark):
    rows = [(i, f"text {i}", "en" if i < 30 else "de", "a") for i in range(41)]
    made = merkle.manifest(edge.documents(spark, *rows), 2)
    runs = made.log().collect()
    sizes = {(r["tree"], r["round"], r["grp"]): 0 for r in runs}
    for r in runs:
        sizes[r["tree"], r["round"], r["grp"]] += 1
    assert sizes == {
        ("rows", 0, "en"): 8, ("rows", 1, "en"): 2, ("rows", 2, "en"): 1,
        ("rows", 0, "de"): 3, ("rows", 1, "de"): 1, ("rows", 2, "de"): 1, ("groups", 0, ""): 1,
    }
