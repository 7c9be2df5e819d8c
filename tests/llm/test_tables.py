"""Archives, mixing, token files, lines, decontamination and the pipeline."""

import hashlib
import math
import os
import random
import sys
import zlib
from collections import Counter
from itertools import combinations

sys.path.insert(0, os.path.dirname(__file__))

import __spark_entry__ as registered
import compare
import corpus_pipeline
import edge
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tallytide.llm import decontaminate, lines, mixing, near_dup, token_files, warc
from tallytide.llm.common import new_folder, table
from tallytide.llm.range_coder import decode, encode

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", registered.LLM_SQL)
def test_query_equals_sql(spark, name):
    found = compare.of_spark(registered.queries()[name](spark, SF_DIR))
    assert found == compare.of_sql(compare.database(SF_DIR), registered.oracle_sql()[name])


def test_every_operator_is_registered():
    numbers = {int(n[2:].split("_")[0]) for n in registered.LLM_QUERIES if n.startswith("op")}
    assert numbers == set(range(1, 14)) and "pipeline" in registered.LLM_QUERIES


def archive(spark, rows, least=10):
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumns(
        {"row": F.lit("x"), "size": F.lit(1), "content": F.lit(2)}
    )
    path = new_folder(spark)
    warc.write_archives(pages.repartition(2), path, least=least)
    return path


def test_archives_keep_every_payload(spark, monkeypatch):
    monkeypatch.setattr(warc, "CHUNK", 7)
    monkeypatch.setattr(warc, "RECORDS_PER_FILE", 5)
    long = "é\r\n\r\nWARC/1.1\r\n😀" * 9
    rows = [
        (1, "http://a/ b\r\nX: y", long), (2, None, long), (3, "u", "short"), (4, "u", "short"),
        (5, "u", None), (6, "u", ""), (7, "u", "same page"), (7, "u", "same page"), (8, "u", long),
        (None, "u", "without an id, rather long"), (9, "u", "\r\n\r\n" * 5),
    ]
    path = archive(spark, rows)
    expected = []
    for page, _, html in rows:
        raw = (html or "").encode()
        equal = [p for p, _, h in rows if (h or "") == (html or "") and p is not None]
        other = max(equal, default=None) if len(raw) >= 10 else None
        revisit = other is not None and page is not None and page < other
        kind = "revisit" if revisit else "response"
        expected.append((page, len(raw), hashlib.sha1(raw).hexdigest(), kind, other if revisit else None))
    found = warc.archived(spark, path)
    columns = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    assert found.columns == list(columns)
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(expected, key=repr)
    chunks = warc.read_chunks(spark, path).where("page_id = 8").orderBy("chunk").collect()
    assert b"".join(r["content"] for r in chunks).decode() == long
    assert [r["chunk"] for r in chunks] == list(range(1, math.ceil(len(long) / 7) + 1))
    assert warc.archived(spark, archive(spark, [])).count() == 0


def test_a_long_payload_is_cut_once(spark):
    html = "a line of é and 😀\r\n\r\n" * 200_000
    path = archive(spark, [(1, "u", html), (2, "u", "short")])
    chunks = warc.read_chunks(spark, path).where("page_id = 1").orderBy("chunk").collect()
    raw, size = html.encode(), warc.CHUNK
    contents = [r["content"].decode() for r in chunks]
    assert contents == [html[i : i + size] for i in range(0, len(html), size)]
    assert {(r["page_id"], r["payload_digest"]) for r in warc.archived(spark, path).collect()} == {
        (1, hashlib.sha1(raw).hexdigest()), (2, hashlib.sha1(b"short").hexdigest()),
    }


def test_a_damaged_payload_is_an_error(spark):
    rows = [(1, 1, "response", None, "0" * 40, 1, 1, 3, hashlib.sha1(b"abc").hexdigest(), None)]
    with pytest.raises(Exception, match="damaged"):
        warc.payloads(spark.createDataFrame(rows, warc._SCHEMA)).collect()


def test_pfair_periods_stay_within_a_block():
    rng = random.Random(1)
    for _ in range(40):
        weights = {f"s{i}": rng.randrange(1, 60) for i in range(rng.randrange(1, 9))}
        total, seen = sum(weights.values()), Counter()
        for slot, name in enumerate(mixing.period(weights), 1):
            seen[name] += 1
            for other, weight in weights.items():
                assert abs(seen[other] - slot * weight / total) < 1
        assert seen == weights


def test_mixing_places_every_document_as_a_step_by_step_schedule_does(spark):
    rng = random.Random(2)
    names = ["a"] * 8 + ["b", "b", "c", "d", None]
    rows = [(i, "t", "en", rng.choice(names)) for i in range(900)] + [(5, "t", "en", "a")]
    weights = {"a": 3, "b": 2, "c": 2, "absent": 4}
    found = mixing.mixed(edge.documents(spark, *rows), weights, block=4).orderBy("position").collect()
    assert len(found) == len(rows) and len({r["position"] for r in found}) == len(rows)
    group = lambda name: name if name in weights else "others"
    left = Counter(group(r[3]) for r in rows)
    blocks = {name: -(-n // 4) for name, n in left.items()}
    own = {**weights, "others": 2}
    slots = {}
    for r in found:
        slots.setdefault(r["slot"], set()).add(group(r["source"]))
    assert all(len(names) == 1 for names in slots.values())
    assert sorted(slots) == list(range(len(slots))) and len(slots) == sum(blocks.values())
    # Between two slots at which a source ends, everyone keeps to the target within a block.
    seen, begin, base = Counter(), 0, Counter()
    for slot in range(len(slots)):
        active = [n for n in blocks if base[n] < blocks[n]]
        seen[next(iter(slots[slot]))] += 1
        for name in active:
            share = (slot + 1 - begin) * own[name] / sum(own[n] for n in active)
            assert abs(seen[name] - base[name] - share) < 1
        if any(seen[n] == blocks[n] for n in active):
            begin, base = slot + 1, seen.copy()
    assert mixing.mixed(edge.none(spark), weights).count() == 0
    assert mixing.mixed(edge.odd(spark), {}).count() == len(edge.ODD_ROWS)


def test_any_number_of_sources_is_mixed(spark):
    """Small sources go in rounds within classes of their size, classes as single sources do."""
    rng = random.Random(6)
    sizes = {"big": 700, "next": 300} | {f"s{i}": rng.choice([1, 2, 3, 9, 10]) for i in range(1_100)}
    names = [name for name, n in sizes.items() for _ in range(n)] + [None] * 5
    rows = [(i, "t", "en", name) for i, name in enumerate(names)]
    docs = edge.documents(spark, *rows)
    weights = mixing.tempered_weights(docs, singles=2)
    class_of = lambda n: f"\0size:{math.floor(math.log2(n) * mixing.STEPS)}"
    group = {name: name if n > 10 else class_of(n) for name, n in sizes.items()} | {None: None}
    shares = Counter()
    for name, n in sizes.items():
        shares[group[name]] += n**0.5
    total = sum(shares.values())
    assert weights == {g: max(1, round(1_000 * s / total)) for g, s in shares.items()}

    found = mixing.mixed(docs, weights, block=4).orderBy("position").collect()
    assert sorted(r["doc_id"] for r in found) == [r[0] for r in rows]
    assert len({r["position"] for r in found}) == len(rows)
    in_order, slots = {}, {}
    for r in found:
        in_order.setdefault(group[r["source"]], []).append(r["source"])
        slots.setdefault(r["slot"], set()).add(group[r["source"]])
    assert sorted(slots) == list(range(len(slots))) and all(len(g) == 1 for g in slots.values())
    for name, sources in in_order.items():
        if name and name.startswith("\0size"):
            seen, rounds = Counter(), []
            for source in sources:
                rounds.append((seen[source] // 4, source))
                seen[source] += 1
            assert rounds == sorted(rounds)
    # Until the first source ends, everyone keeps to the target within a block.
    own = {**weights, None: min(weights.values())}
    left = {name: -(-len(sources) // 4) for name, sources in in_order.items()}
    seen = Counter()
    for slot in range(len(slots)):
        seen[next(iter(slots[slot]))] += 1
        assert all(abs(seen[g] - (slot + 1) * own[g] / sum(own.values())) < 1 for g in own)
        if any(seen[g] == left[g] for g in own):
            break


def test_range_coder_round_trip():
    rng = np.random.default_rng(3)
    for n in (0, 1, 7, 300, 2500):
        blocks = [rng.integers(0, 1 << 16, rng.integers(0, n + 1)) for _ in range(5)]
        blocks += [np.zeros(n, int), np.full(n, 65535), rng.zipf(1.3, n) % 50_000, np.arange(n) % 5]
        found = decode(encode(blocks), [len(b) for b in blocks])
        assert all((a == b).all() for a, b in zip(blocks, found))
    repeated = np.tile(rng.integers(0, 50_000, 40), 60)
    assert len(encode([repeated])[0]) < 0.25 * 2 * len(repeated)


def test_token_files_read_back(spark, monkeypatch):
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    docs = table(spark, SF_DIR, "documents").select("doc_id", "text")
    odd = edge.odd(spark).select("doc_id", "text")
    for frame in (docs, odd):
        path = new_folder(spark)
        token_files.write_tokens(frame, path)
        found = token_files.read_tokens(spark, path).orderBy("start").collect()
        rows = sorted(map(tuple, frame.collect()), key=lambda r: (r[0] is not None, r[0] or 0))
        assert [r["doc_id"] for r in found] == [r[0] for r in rows]
        ids = {}
        for doc_id, text in rows:
            own = [*library.encode(text or "", add_special_tokens=False).ids, 2]
            ids.setdefault(doc_id, []).append((len(own), zlib.crc32(np.array(own, "<u4").tobytes())))
        at = 0
        for r in found:
            assert r["start"] == at and (r["n_tokens"], r["ids_crc32"]) in ids[r["doc_id"]]
            at += r["n_tokens"]
    whole = token_files.read_pieces(spark, path).where("doc_id = 10").orderBy("start").collect()
    text = dict(row[:2] for row in edge.ODD_ROWS)[10]
    assert sum((r["ids"] for r in whole), []) == [*library.encode(text, add_special_tokens=False).ids, 2]
    assert len(whole) > 1
    path = new_folder(spark)
    token_files.write_tokens(edge.none(spark), path)
    assert token_files.read_tokens(spark, path).count() == 0


def test_words_of_tokens_equal_whole_texts(monkeypatch):
    rng = random.Random(5)
    parts = [*"aAeEzßéÉñİıŉſK×÷ÀΣσςЖ日😀.,;:!?%&$#*)](\"<>|-_019²½\u0338\u0331\u0301\u0307\u200d\u00ad\u00a0ﬁẞǅẖH", " ", "\n"]
    parts += ["\x0b", "\x1c", "'s", "'RE", "'ll", "<|endoftext|>", "</w>", "ll)", "s.", "Word", "été"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 14))) for _ in range(4000)]
    texts += ["Word word, WORD. word; (word) " * 3, "", "x" * 5000 + "."]
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    expected = [library.encode(t, add_special_tokens=False).ids for t in texts]
    for limits in ((200_000, 200_000), (40, 60)):
        for name, limit in zip(("_REMEMBERED", "_REMEMBERED_PARTS"), limits):
            monkeypatch.setattr(token_files, name, limit)
        monkeypatch.setattr(token_files, "_CHARACTERS", 2000)
        words = token_files._Words("word_bpe_49k.json")
        assert [np.frombuffer(raw, "<u4").tolist() for raw in words.ids(texts)] == expected


def test_letters_reach_the_library_once_for_all_cases_and_marks():
    words, seen = token_files._Words("word_bpe_49k.json"), []

    class Library:
        def __init__(self, library):
            self.library = library

        def encode(self, text, **more):
            seen.append(text)
            return self.library.encode(text, **more)

        def encode_batch_fast(self, texts, **more):
            seen.extend(texts)
            return self.library.encode_batch_fast(texts, **more)

    words.tokenizer = Library(words.tokenizer)
    list(words.ids(["Strange STRANGE, strange. other", "Other! strange;"]))
    assert " ".join(seen).lower().count("strange") == 1


def test_range_coder_many_blocks_and_damage():
    rng = np.random.default_rng(4)
    blocks = [rng.zipf(1.2, rng.integers(0, 90)) % 50_000 for _ in range(1500)]
    lengths, codes = [len(b) for b in blocks], encode(blocks)
    assert all((a == b).all() for a, b in zip(blocks, decode(codes, lengths)))
    # Surprises after a long run of right guesses take the least intervals there are.
    sure = np.full(3000, 7)
    sure[100::97] = rng.integers(0, 1 << 16, len(sure[100::97]))
    assert (decode(encode([sure]), [len(sure)])[0] == sure).all()
    # A damaged code gives some ids, which the checksum of the block tells.
    broken = [bytes(rng.integers(0, 256, len(c), np.uint8)) for c in codes]
    assert [len(b) for b in decode(broken, lengths)] == lengths


def test_token_workers_get_few_rows_at_a_time(spark, monkeypatch):
    docs = spark.range(5000).selectExpr("id AS doc_id", "'some text' AS text").coalesce(1)
    whole, name = type(docs).mapInArrow, "spark.sql.execution.arrow.maxRecordsPerBatch"

    def watched(frame, function, schema, *more):
        def few(batches):
            for batch in batches:
                if batch.num_rows > 1000:
                    raise ValueError(f"{batch.num_rows} rows at a time")
                yield batch

        return whole(frame, lambda batches: function(few(batches)), schema, *more)

    before, path = spark.conf.get(name), new_folder(spark)
    with monkeypatch.context() as patched:
        patched.setattr(type(docs), "mapInArrow", watched)
        token_files.write_tokens(docs, path)
    assert token_files.read_tokens(spark, path).count() == 5000
    assert spark.conf.get(name) == before


def test_lines_above_the_ratio_go_from_their_host_alone(spark):
    rows = [(i, "H.com", f"menu\n own {i} \nmenu\n\nrare{i % 4}") for i in range(20)]
    rows += [(100 + i, "other.com", "menu") for i in range(3)]
    rows += [(200, None, None), (201, "", "x"), (202, "H.com", None), (203, "H.com", "")]
    pages = spark.createDataFrame(rows, "page_id bigint, host string, html string").withColumns(
        {"line": F.lit(1), "drop": F.lit(2), "pages": F.lit(3)}
    )
    found = {
        r["page_id"]: r
        for r in lines.without_boilerplate(pages, "page_id", F.col("host"), F.col("html")).collect()
    }
    assert len(found) == len(rows)
    assert found[3]["text"] == "own 3\nrare3" and (found[3]["n_lines"], found[3]["n_dropped"]) == (4, 2)
    assert found[100]["text"] == "" and found[101]["n_dropped"] == 1 and found[201]["text"] == "x"
    assert found[200]["text"] == "" and found[202]["n_lines"] == 0
    empty = lines.without_boilerplate(pages.where("false"), "page_id", F.col("host"), F.col("html"))
    assert empty.count() == 0


def test_small_hosts_lose_what_their_pages_share(spark):
    rows = [(10 * n + i, f"h{n}", f"menu\nown {n} {i}") for n in range(1, 10) for i in range(n)]
    pages = spark.createDataFrame(rows, "page_id bigint, host string, html string")
    found = lines.without_boilerplate(pages, "page_id", F.col("host"), F.col("html"))
    texts = {r["page_id"]: r["text"] for r in found.collect()}
    assert texts == {
        page: text if host == "h1" else text.removeprefix("menu\n") for page, host, text in rows
    }


def test_masks_hit_every_window_with_as_many_substitutions_as_agree():
    def hit(n, changed):
        return any(
            all(not (bit == "1" and start + i in changed) for i, bit in enumerate(mask))
            for mask in decontaminate.MASKS
            for start in range(n - len(mask) + 1)
        )

    for n in range(decontaminate.LEAST_WORDS, decontaminate.WINDOW + 1):
        most = n * (100 - decontaminate.AGREE) // 100
        assert all(hit(n, set(changed)) for changed in combinations(range(n), most))


def plain_overlaps(docs, items):
    found = set()
    for doc_id, text in docs:
        words = decontaminate.word_hashes(text).tolist()
        for item, other in items:
            wanted = decontaminate.word_hashes(other).tolist()
            n = len(wanted)
            if n < decontaminate.LEAST_WORDS:
                if n >= decontaminate.LEAST_EXACT and any(
                    words[i : i + n] == wanted for i in range(len(words) - n + 1)
                ):
                    found.add((doc_id, item))
                continue
            width = min(n, decontaminate.WINDOW)
            for begin in range(-n + 1, len(words)):
                same = [
                    0 <= begin + i < len(words) and words[begin + i] == w for i, w in enumerate(wanted)
                ]
                best = max(sum(same[i : i + width]) for i in range(n - width + 1))
                if best * 100 >= decontaminate.AGREE * width:
                    found.add((doc_id, item))
    return found


def test_overlaps_equal_all_alignments(spark):
    rng = random.Random(7)
    vocabulary = [f"w{i}" for i in range(40)] + ["the", "of", "and"] * 4
    words = lambda n: rng.choices(vocabulary, k=n)
    items = [(i, words(rng.choice([1, 2, 3, 5, 7, 8, 10, 11, 12, 20, 25, 60]))) for i in range(24)]
    docs = []
    for i in range(60):
        text = words(rng.randrange(0, 80))
        if i % 2:
            piece = list(rng.choice(items)[1])
            for _ in range(rng.randrange(len(piece) // 4 + 1)):
                piece[rng.randrange(len(piece))] = "changed"
            text[rng.randrange(len(text) + 1) : 0] = piece
        docs.append((i, " ".join(text).upper()))
    docs += [(60, None), (61, ""), (62, " ".join(items[4][1])), (62, " ".join(items[4][1]))]
    items = [(i, ", ".join(w)) for i, w in items] + [(50, None), (51, ""), (None, "a b c d e f g h i")]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    frame = edge.documents(spark, *docs)
    found = {tuple(r)[:2] for r in decontaminate.overlaps(frame, bench).collect()}
    assert found == plain_overlaps(docs, items)
    rows = decontaminate.decontaminated(frame, bench).collect()
    assert len(rows) == len(docs)
    assert {r["doc_id"] for r in rows if not r["kept"]} == {doc for doc, _ in found}
    assert decontaminate.decontaminated(frame, bench.where("false")).where("NOT kept").count() == 0
    assert decontaminate.decontaminated(edge.none(spark), bench).count() == 0


def test_letters_of_scripts_without_spaces_are_words(spark):
    items = [(1, "春天来了花园里的树木都长出了新的叶子"), (2, "きょうはとてもいいてんきです"), (3, "短い文"), (4, "a b c")]
    docs = edge.documents(
        spark, (1, f"从前{items[0][1]}后来下雨"), (2, f"x{items[1][1]}y"), (3, "春天来了短い文"), (4, "a b c")
    )
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    found = {tuple(r)[:2] for r in decontaminate.overlaps(docs, bench).collect()}
    assert found == {(1, 1), (2, 2), (3, 3), (4, 4)}
    short = spark.createDataFrame([(1, "a b c"), (2, "a b"), (3, None)], "item_id bigint, text string")
    assert sorted(map(tuple, decontaminate.too_short(short).collect())) == [(2, 2), (3, 0)]


def test_short_and_nameless_items_and_documents_without_an_id(spark):
    bench = spark.createDataFrame(
        [(1, "What is the capital of France?"), (None, "a b c d e f g h i j")], "item_id bigint, text string"
    )
    rows = [
        (1, "x what is the capital of france y"), (2, "What is a capital of France?"), (3, "zero a b c d e f g h i j"),
        (None, "What is the capital of France"), (None, "clean text without any item"), (None, None),
    ]
    docs = edge.documents(spark, *rows)
    found = {(r["doc_id"], r["n_items"], r["items"], r["kept"]) for r in decontaminate.decontaminated(docs, bench).collect()}
    assert found == {(1, 1, "1", False), (2, 0, "", True), (3, 1, "", False), (None, 1, "1", False), (None, 0, "", True)}
    left = decontaminate.without_leaks(docs, bench)
    assert left.columns == docs.columns
    texts = {(r["doc_id"], r["text"]) for r in left.collect()}
    assert texts == {rows[1], rows[4], rows[5]}


def test_a_phrase_repeated_in_one_document_and_many_items(spark):
    phrase = "one two three four five six seven eight nine"
    items = [(i, " ".join([phrase, *(f"end{i}of{j}" for j in range(6))])) for i in range(200)]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    docs = edge.documents(spark, (1, f"{phrase} . " * 5000), (2, items[7][1]), (3, f"{phrase} " * 40 + items[9][1]))
    found = {tuple(r)[:2] for r in decontaminate.overlaps(docs, bench).collect()}
    assert found == {(2, 7), (3, 9)}


def test_pipeline_equals_its_decisions_made_one_by_one(spark):
    docs = table(spark, SF_DIR, "documents")
    rows = {r["doc_id"]: r for r in docs.collect()}
    kept = [d for d, r in rows.items() if any(c.isalpha() for c in r["text"] or "")]
    sets = {d: set(near_dup.shingle_set(rows[d]["text"], 5).tolist()) for d in kept}
    root = {d: d for d in kept}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(sorted(kept), 2):
        x, y = sets[a], sets[b]
        if x and y and 100 * len(x & y) >= 80 * len(x | y):
            low, high = sorted((find(a), find(b)))
            root[high] = low
    kept = [d for d in kept if root[d] == d]
    items = [tuple(r) for r in table(spark, SF_DIR, "benchmark").select("item_id", "text").collect()]
    leaks = {d for d, _ in plain_overlaps([(d, rows[d]["text"]) for d in kept[:60]], items)}
    stages, frame = dict(corpus_pipeline.STAGES), docs
    order = None
    for name, stage in corpus_pipeline.STAGES:
        path = new_folder(spark)
        stage(spark, frame, SF_DIR).write.parquet(path)
        frame = spark.read.parquet(path)
        if name != "token ids":
            assert frame.columns == docs.columns
        if name == "near-dedup":
            assert {r["doc_id"] for r in frame.collect()} == set(kept)
        if name == "decontamination":
            left = {r["doc_id"] for r in frame.collect()}
            assert left & set(kept[:60]) == set(kept[:60]) - leaks
            places = mixing.mixed(frame, mixing.tempered_weights(frame))
            order = [r["doc_id"] for r in places.orderBy("position").collect()]
    assert [r["doc_id"] for r in frame.orderBy("start").collect()] == order
    assert list(stages) == ["language ID", "near-dedup", "decontamination", "mixing", "token ids"]


def test_stages_take_odd_and_empty_tables(spark):
    for docs in (edge.odd(spark), edge.none(spark)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            result = stage(spark, docs, SF_DIR)
            assert result.columns == docs.columns, name
            if name == "mixing":
                assert result.count() == docs.count()
        assert corpus_pipeline.write_token_ids(spark, docs, SF_DIR).count() == docs.count()
