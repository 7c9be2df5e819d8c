import random
import sys, os  # noqa: E401

sys.path.insert(0, os.path.dirname(__file__))

import edge
import pytest

from tallytide.llm import near_dup
from tallytide.llm.near_dup import components, near_duplicates, shingle_set


def exact(rows, words=3, percent=85):
    """Smallest reachable id of every id, from all pairs of whole shingle sets."""

    def shingles(text):
        parts = (text or "").encode().lower().split()
        if not parts:
            return frozenset()
        width = min(words, len(parts))
        return frozenset(tuple(parts[i : i + width]) for i in range(len(parts) - width + 1))

    sets = [(doc, shingles(text)) for doc, text in rows if doc is not None]
    root = {doc: doc for doc, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                low, high = sorted((find(a), find(b)))
                root[high] = low
    return {doc: find(doc) for doc in root}, {doc: len(s) for doc, s in sets}


def edited(rng, words, share):
    return [w if rng.random() > share else f"new{rng.randrange(10**6)}" for w in words]


def groups(seed):
    """A large group of near copies, chains of copies, a common passage and single texts."""
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(5000)}"
    base = [word() for _ in range(150)]
    passage = [word() for _ in range(25)]
    texts = [edited(rng, base, rng.choice([0, 0.005, 0.01, 0.02, 0.05])) for _ in range(120)]
    for _ in range(30):
        text = [word() for _ in range(rng.choice([3, 8, 40, 600]))]
        for _ in range(rng.randrange(1, 5)):
            texts.append(text)
            text = edited(rng, text, 0.02)
    texts += [[*passage, *(word() for _ in range(rng.choice([2, 10, 60])))] for _ in range(60)]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    rng.shuffle(rows)
    return [(i, text) for i, (_, text) in enumerate(rows)]


@pytest.mark.parametrize(("seed", "words", "percent"), [(1, 3, 85), (2, 5, 80)])
def test_components_equal_all_pairs(spark, monkeypatch, seed, words, percent):
    monkeypatch.setattr(near_dup, "SHORT_LIST", 8)
    rows = groups(seed)
    found = near_duplicates(edge.documents(spark, *rows), words=words, percent=percent).collect()
    roots, sizes = exact(rows, words, percent)
    assert {r["doc_id"]: r["component_id"] for r in found} == roots
    assert {r["doc_id"]: r["n_shingles"] for r in found} == sizes
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in found)


@pytest.mark.parametrize(("words", "percent"), [(3, 85), (5, 80)])
def test_links_of_sets_about_as_large_as_a_sketch(spark, words, percent):
    """The larger text of a pair has values beyond its sketch, the smaller one has not."""
    rng, rows = random.Random(3), []
    for size in range(near_dup.SKETCH - 14, near_dup.SKETCH + 20):
        for more in (size * 100 // percent - size, (size * 100 // percent - size) // 2):
            for _ in range(3):
                text = [f"w{rng.randrange(10**9)}" for _ in range(size + more + words - 1)]
                rows.append((len(rows), " ".join(text)))
                rows.append((len(rows), " ".join(text[: size + words - 1])))
    found = near_duplicates(edge.documents(spark, *rows), words=words, percent=percent).collect()
    roots, _ = exact(rows, words, percent)
    assert len(set(roots.values())) == len(rows) // 2
    assert {r["doc_id"]: r["component_id"] for r in found} == roots


def test_texts_of_one_document_are_linked(spark):
    a, b = (" ".join(f"{x}{i}" for i in range(9)) for x in "ab")
    rows = [(3, a), (5, a), (5, b), (7, b), (8, ""), (5, ""), (9, " "), (9, None), (4, "a single text")]
    found = near_duplicates(edge.documents(spark, *rows)).collect()
    assert len(found) == len(rows)
    assert {(r["doc_id"], r["component_id"]) for r in found} == {
        (3, 3), (5, 3), (7, 3), (8, 8), (9, 9), (4, 4),
    }


def test_repeated_ids_equal_all_pairs(spark):
    rng = random.Random(4)
    rows = [(rng.randrange(200) if rng.random() < 0.2 else doc, text) for doc, text in groups(4)]
    rows += [(rng.randrange(250), rng.choice(["", None, "two words"])) for _ in range(20)]
    found = near_duplicates(edge.documents(spark, *rows)).collect()
    roots, _ = exact(rows)
    assert len(found) == len(rows)
    assert all(r["component_id"] == roots[r["doc_id"]] for r in found)


def test_odd_rows(spark):
    found = near_duplicates(edge.odd(spark)).collect()
    roots, _ = exact([row[:2] for row in edge.ODD_ROWS])
    assert len(found) == len(edge.ODD_ROWS)
    assert {r["doc_id"]: r["component_id"] for r in found if r["doc_id"] is not None} == roots
    assert all(r["kept"] for r in found if r["doc_id"] is None)
    assert near_duplicates(edge.none(spark)).count() == 0


def test_white_space_and_case_are_ascii():
    assert len(shingle_set("a\x0bb\x1cc\xa0d E", 1)) == 3
    assert (shingle_set("AB", 3) == shingle_set("ab", 3)).all()
    assert (shingle_set("É", 3) != shingle_set("é", 3)).all()


def test_a_long_chain_is_one_component(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 600)], "a bigint, b bigint")
    found = {r["node"]: r["root"] for r in components(links).collect()}
    assert found == {**{i: 0 for i in range(201)}, 500: 500, 600: 500}
    assert components(links.where("false")).count() == 0


def family(seed, copies):
    """Copies of one text: with edits that some share, copies of a far copy, cut off, with gaps."""
    rng = random.Random(seed)
    base = [f"w{rng.randrange(9000)}" for _ in range(200)]
    far = edited(rng, base, 0.06)
    texts = [base]
    for _ in range(copies):
        text = list(rng.choice([base, base, base, far]))
        for _ in range(rng.choice([0, 2, 4, 8, 12, 16])):
            text[rng.randrange(len(text))] = rng.choice(["of", "the", f"own{rng.randrange(10**6)}"])
        if rng.random() < 0.3:
            start = rng.randrange(30)
            text = text[start : start + rng.randrange(120, 200)]
        elif rng.random() < 0.2:
            text = [word for word in text if rng.random() > 0.03]
        texts.append(text)
    rows = [" ".join(text) for text in texts]
    rng.shuffle(rows)
    return list(enumerate(rows))


def test_copies_and_cuts_equal_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(near_dup, "SHORT_LIST", 8)
    rows = family(6, 150)
    found = near_duplicates(edge.documents(spark, *rows)).collect()
    roots, _ = exact(rows)
    assert {r["doc_id"]: r["component_id"] for r in found} == roots
    assert 1 < len(set(roots.values())) < len(rows)


def test_few_whole_sets_are_compared_inside_a_long_list(spark, monkeypatch):
    """Half of the copies are too far from the text, but nothing in their sketches shows it."""
    monkeypatch.setattr(near_dup, "SHORT_LIST", 8)
    similar, pairs = near_dup._similar, []

    def counted(frame, *others):
        pairs.append(frame.count())
        return similar(frame, *others)

    monkeypatch.setattr(near_dup, "_similar", counted)
    rng = random.Random(7)
    rows = []
    for i in range(240):
        text = [f"w{j}" for j in range(600)]
        for place in rng.sample(range(600), (4, 18)[i % 2]):
            text[place] = rng.choice(["of", "the"])
        rows.append((i, " ".join(text)))
    found = near_duplicates(edge.documents(spark, *rows)).collect()
    roots, _ = exact(rows)
    assert {r["doc_id"]: r["component_id"] for r in found} == roots
    assert sum(pairs) < 20 * len(rows)
