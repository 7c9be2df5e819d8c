"""Token ids of documents in binary files, coded by the range coder.

A file is a sequence of blocks. Each holds up to ``BLOCK`` ids of successive documents,
begins with a header and a table of its documents, is coded independently of all others and
carries a checksum of its ids; a long document goes over several blocks. Spark's own writer
puts one block per row into the file, ended by a line feed, so that a lost task leaves nothing
behind; files hold at most ``BLOCKS_PER_FILE`` blocks and are read back one at a time.

Layout, little endian: ``TIDB``, then the numbers of ids and of documents, the checksum (crc32
of the ids as 32-bit integers), the length of the code, the part (4 bytes each), the document's
number in the part, the ids before the block in the part (8 each), whether the first document
began earlier (1); then per document its id (8), number of ids in the block (4) and whether it
has an id at all (1); then the code and a line feed.

Null texts count as empty; a document always has its end id. Rows of equal order keep one
place each; rows without an id come first.
"""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from collections.abc import Iterator, Sequence
from functools import cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tallytide.llm.common import importable, map_batches, small_batches, texts_of, written
from tallytide.llm.range_coder import IDS, decode, encode

VOCABULARY = "word_bpe_49k.json"
END_ID = 2
BLOCK = 4096
BLOCKS_PER_FILE = 2048

# Blocks coded side by side.
_LANES = 2048

# Characters of the texts whose words are looked up together.
_CHARACTERS = 1 << 20

# Words a worker remembers, and parts of words; a memory is emptied when it is full.
_REMEMBERED, _REMEMBERED_PARTS = 200_000, 200_000

# A word a line: letters up to U+027F that stay as they are in every normal form, then marks of
# ASCII; vocabularies that split at `_LETTERS` cut in between. Any other word is a match without.
_PLAIN = re.compile(
    rb"^(?:((?:[a-z]|(?!\xc3[\x97\xb7]|\xc4\xb0)[\xc3-\xc9][\x80-\xbf])+)([.,;:!?%&$#*)\]]*)|.*)$",
    re.MULTILINE,
)
_LETTERS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

_HEADER = struct.Struct("<4sIIIIIQQB")
_MAGIC = b"TIDB"


class _Words:
    """Ids of texts by the tokenizer library, which sees every distinct word once.

    The vocabulary drops white space, so words between ASCII white space do not affect
    each other. If it also ignores case and cuts between letters and marks, the library sees
    the letters of a word once for all cases and marks, many such words in one text.
    """

    def __init__(self, vocabulary: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        path = vocabulary if "/" in vocabulary else public_tokenizers.path(vocabulary)
        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            rules = json.load(file)
        kinds = [n["type"] for n in (rules["normalizer"] or {}).get("normalizers", [])]
        cuts = (rules["pre_tokenizer"] or {}).get("pretokenizers", [{}])
        self.cuts = kinds == ["NFC", "Replace", "Lowercase"] and cuts[0].get("pattern") == {"Regex": _LETTERS}
        self.known: dict[bytes, bytes] = {}
        self.parts: dict[bytes, bytes] = {}

    def ids(self, texts: Sequence[str]) -> Iterator[bytes]:
        """The ids of each text as 32-bit integers."""
        some, size = [], 0
        for text in texts:
            some.append(text.encode().split())
            size += len(text)
            if size >= _CHARACTERS:
                yield from self._looked_up(some)
                some, size = [], 0
        yield from self._looked_up(some)

    def _looked_up(self, texts: list[list[bytes]]) -> Iterator[bytes]:
        new = set().union(*texts).difference(self.known)
        if len(self.known) + len(new) > _REMEMBERED:
            self.known.clear()
            new = set().union(*texts)
        self._learn(list(new))
        for words in texts:
            yield b"".join(map(self.known.__getitem__, words))

    def _learn(self, new: list[bytes]) -> None:
        if not new:
            return
        cut = _PLAIN.findall(b"\n".join(new).lower()) if self.cuts else [(b"", b"")] * len(new)
        odd = [word for word, (letters, _) in zip(new, cut) if not letters]
        for at in range(0, len(odd), 1000):
            some = odd[at : at + 1000]
            self.known.update(zip(some, self._each(some)))
        letters, marks = ({part for part in parts if part} for parts in zip(*cut))
        if len(self.parts) + len(letters) + len(marks) > _REMEMBERED_PARTS:
            self.parts.clear()
        fresh = list(letters.difference(self.parts))
        for at in range(0, len(fresh), 500):
            some = fresh[at : at + 500]
            self.parts.update(zip(some, self._together(some)))
        fresh = list(marks.difference(self.parts))
        self.parts.update(zip(fresh, self._each(fresh)))
        parts = self.parts
        parts[b""] = b""
        self.known.update(
            (word, parts[letters] + parts[marks]) for word, (letters, marks) in zip(new, cut) if letters
        )

    def _each(self, words: list[bytes]) -> list[bytes]:
        """The ids of each word, by itself."""
        coded = self.tokenizer.encode_batch_fast(
            [word.decode() for word in words], add_special_tokens=False
        )
        return [struct.pack(f"<{len(found.ids)}I", *found.ids) for found in coded]

    def _together(self, words: list[bytes]) -> list[bytes]:
        """The ids of each word of letters, from one text that holds them all."""
        found = self.tokenizer.encode(b" ".join(words).decode(), add_special_tokens=False)
        places = np.array(found.word_ids, np.int64)
        sizes = np.bincount(places, minlength=len(words))
        if len(sizes) != len(words) or not sizes.all() or (places[1:] < places[:-1]).any():
            return self._each(words)
        ids, ends = np.array(found.ids, "<u4").tobytes(), (sizes.cumsum() * 4).tolist()
        return [ids[at:end] for at, end in zip([0, *ends], ends)]


@cache
def _words(vocabulary: str) -> _Words:
    return _Words(vocabulary)


class _Packer:
    """Cuts the ids of one part into blocks."""

    def __init__(self, part: int):
        self.part, self.document, self.start = part, 0, 0
        self.pieces: list[tuple[int | None, np.ndarray]] = []
        self.size, self.first, self.continued = 0, 0, False
        self.full: list[tuple] = []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        at = 0
        while True:
            piece = ids[at : at + BLOCK - self.size]
            if not self.pieces:
                self.first, self.continued = self.document, at > 0
            self.pieces.append((doc_id, piece))
            self.size += len(piece)
            at += len(piece)
            if self.size == BLOCK:
                self.close()
            if at == len(ids):
                break
        self.document += 1

    def close(self) -> None:
        if self.pieces:
            ids = np.concatenate([piece for _, piece in self.pieces])
            table = b"".join(
                struct.pack("<qIB", doc_id or 0, len(piece), doc_id is not None)
                for doc_id, piece in self.pieces
            )
            about = (len(self.pieces), self.part, self.first, self.start, self.continued)
            check = zlib.crc32(ids.astype("<u4").tobytes())
            self.full.append((ids.astype(np.uint16), table, check, about))
            self.start += len(ids)
        self.pieces, self.size = [], 0

    def coded(self) -> list[bytes]:
        """The blocks that are full, as they stand in the file."""
        blocks = []
        codes = encode([b[0] for b in self.full])
        for (ids, table, check, about), code in zip(self.full, codes):
            n_documents, part, first, start, continued = about
            head = _HEADER.pack(
                _MAGIC, len(ids), n_documents, check, len(code), part, first, start, continued
            )
            blocks.append(head + table + code)
        self.full = []
        return blocks


def write_tokens(
    docs: DataFrame,
    path: str,
    id: str = "doc_id",
    text: str = "text",
    order: Sequence[Column] | None = None,
    vocabulary: str = VOCABULARY,
    end_id: int = END_ID,
) -> None:
    """Write the ids of all documents to ``path``, by ascending id unless ``order`` says else.

    Every document gets ``end_id`` at its end. Parts are numbered in the order of the table.
    """
    spark = docs.sparkSession
    importable(spark)
    keys = [F.col(id).asc()] if order is None else list(order)
    rows = docs.select(
        F.col(id).cast("bigint").alias("doc_id"),
        F.col(text).alias("text"),
        F.struct(*keys).alias("_order") if order is not None else F.col(id).alias("_order"),
    )
    end = struct.pack("<I", end_id)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, words = _Packer(TaskContext.get().partitionId()), _words(vocabulary)
        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(packer.coded(), pa.binary())], names=["block"]
            )

        for batch in batches:
            texts = texts_of(batch.column(1))
            for doc_id, raw in zip(batch.column(0).to_pylist(), words.ids(texts)):
                ids = np.frombuffer(raw + end, "<u4")
                if ids.max() >= IDS:
                    raise ValueError(f"ids from {IDS} on do not fit the block format")
                packer.add(doc_id, ids)
                if len(packer.full) >= _LANES:
                    yield flush()
        packer.close()
        if packer.full:
            yield flush()

    with small_batches(spark):
        (
            rows.orderBy("_order")
            .select("doc_id", "text")
            .mapInArrow(pack, "block binary")
            # Bytes go into the file as they are.
            .select(F.col("block").cast("string"))
            .write.option("maxRecordsPerFile", BLOCKS_PER_FILE)
            .text(path)
        )


def _blocks(content: bytes) -> Iterator[tuple]:
    """(header, documents, code) of every block in a file."""
    at = 0
    while at < len(content):
        head = _HEADER.unpack_from(content, at)
        if head[0] != _MAGIC:
            raise ValueError("not a block of token ids")
        table = at + _HEADER.size
        code = table + 13 * head[2]
        documents = list(struct.iter_unpack("<qIB", content[table:code]))
        yield head, documents, content[code : code + head[4]]
        at = code + head[4] + 1


def _pieces(content: bytes) -> Iterator[tuple[int, int, int, int | None, np.ndarray]]:
    """(part, document, start, doc_id, ids) of every document or part of one in a file."""
    blocks = list(_blocks(content))
    for at in range(0, len(blocks), _LANES):
        some = blocks[at : at + _LANES]
        decoded = decode([b[2] for b in some], [b[0][1] for b in some])
        for (head, documents, _), ids in zip(some, decoded):
            _, _, _, check, _, part, document, start, _ = head
            raw = ids.astype("<u4")
            if zlib.crc32(raw.tobytes()) != check:
                raise ValueError(f"block at {start} of part {part} is damaged")
            offset = 0
            for doc_id, size, has_id in documents:
                piece = raw[offset : offset + size]
                yield part, document, start + offset, doc_id if has_id else None, piece
                offset += size
                document += 1


def _read(spark: SparkSession, path: str, value, schema: str) -> DataFrame:
    importable(spark)
    names = [part.split()[0] for part in schema.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64()] * 5 + [pa.list_(pa.int32()) if value is list else pa.int64()]
        for batch in batches:
            for content in batch.column(0):
                rows = []
                for part, document, start, doc_id, ids in _pieces(content.as_py()):
                    last = ids.tolist() if value is list else zlib.crc32(ids.tobytes())
                    rows.append((part, document, start, doc_id, len(ids), last))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(zip(*rows), kinds)] if rows
                    else [pa.array([], k) for k in kinds],
                    names=names,
                )

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return files.select("content").mapInArrow(run, schema)


def read_pieces(spark: SparkSession, path: str) -> DataFrame:
    """(part, document, start, doc_id, n, ids): the ids themselves, long documents in pieces."""
    schema = (
        "part bigint, document bigint, start bigint, doc_id bigint, n bigint, ids array<int>"
    )
    return _read(spark, path, list, schema)


def _joined_crc(parts: Sequence[tuple[int, int]]) -> int:
    """crc32 of byte strings one after the other, from the (length, crc32) of each."""
    total = 0
    for size, crc in parts:
        zeros = bytes(size)
        total = zlib.crc32(zeros, total) ^ zlib.crc32(zeros) ^ crc
    return total


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in the files."""
    schema = (
        "part bigint, document bigint, start bigint, doc_id bigint, n bigint, crc bigint"
    )
    with small_batches(spark):
        pieces = written(_read(spark, path, int, schema))
    # One row per part of the table.
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = (
        pieces.groupBy("part")
        .agg(F.sum("n").alias("size"))
        .select("part", F.coalesce(F.sum("size").over(earlier), F.lit(0)).alias("before"))
    )
    documents = (
        pieces.groupBy("part", "document")
        .agg(
            F.max("doc_id").alias("doc_id"),
            F.min("start").alias("start"),
            F.sum("n").alias("n"),
            F.sort_array(F.collect_list(F.struct("start", "n", "crc"))).alias("pieces"),
        )
        .join(F.broadcast(parts), "part")
        .select("doc_id", (F.col("start") + F.col("before")).alias("start"), "n", "pieces")
    )

    def columns(batch: pa.RecordBatch) -> list:
        crcs = [
            p[0]["crc"] if len(p) == 1 else _joined_crc([(4 * x["n"], x["crc"]) for x in p])
            for p in batch.column(3).to_pylist()
        ]
        return [*batch.columns[:3], pa.array(crcs, pa.int64())]

    result = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint"
    return map_batches(documents, columns, result)
