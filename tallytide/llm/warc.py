"""Web archives: pages to WARC records and back.

Payloads go through a chunked record table: a long payload is several rows, each with the
record's identifier and the chunk's number. Written, a chunk is a segment: the first one a
``response`` record, the others ``continuation`` records with their segment numbers. Spark's
text writer ends every row with the two line ends that close a record, so its files are
archives, and a lost task leaves none behind. They are compressed as a whole.

Read back, a file is unpacked and parsed piece by piece into chunks. A payload in one chunk has
its digest at once; chunks of longer ones are sorted by record and number, and a digest is
carried on from chunk to chunk, so that no task holds a whole payload.

Of records with equal payloads of at least ``LEAST`` bytes the one with the largest page_id is
a ``response`` and the others, without payload, ``revisit`` it. Null payloads count as empty.
Rows that repeat a page_id are records of their own, and of equal largest ones each is a
response. A null url is left out of the record.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tallytide.llm.common import importable, written

LEAST = 1000

# Code points of a chunk.
CHUNK = 1 << 16
RECORDS_PER_FILE = 4096

# Bytes unpacked at a time.
_PIECE = 1 << 20

_END = "\r\n"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_SCHEMA = (
    "row bigint, page_id bigint, record_type string, refers_to bigint, claimed string,"
    " chunk bigint, chunks bigint, size bigint, digest string, content binary"
)
_KINDS = [
    pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(),
    pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary(),
]
_NAMES = [part.split()[0] for part in _SCHEMA.split(",")]


def _lines(*headers: tuple[str, Column]) -> Column:
    """Header lines; those with a null value are left out."""
    parts = [F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit(_END)) for name, value in headers]
    return F.concat(*(F.coalesce(part, F.lit("")) for part in parts))


def with_originals(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """``pages`` (page_id, url, payload) with sha1, size and, for revisits, ``refers_to``."""
    known = pages.withColumn("sha1", F.sha1(F.col("payload").cast("binary"))).withColumn(
        "size", F.octet_length("payload")
    )
    repeated = written(
        known.where(f"size >= {least}")
        .groupBy("sha1", "size")
        .agg(F.max("page_id").alias("original"), F.count("*").alias("n"))
        .where("n > 1")
        .drop("n")
    )
    return known.join(repeated, ["sha1", "size"], "left").withColumn(
        "refers_to", F.when(F.col("page_id") < F.col("original"), F.col("original"))
    )


def _cut(size: int) -> Callable[[Column], Column]:
    def parts(text: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(text)), F.lit(size))
        return F.transform(starts, lambda start: F.substring(text, start, F.lit(size)))

    return parts


def chunked(records: DataFrame) -> DataFrame:
    """One row per chunk: revisits and short payloads are one chunk, numbered from 1.

    A payload is cut in at most 16 parts, each of these in 16, and so on: letters have to be
    counted from the start of what is cut, so this keeps the work in proportion to the length. A
    row carries its own chunk only.
    """
    whole = F.when(F.col("refers_to").isNull(), F.col("payload")).otherwise("")
    pieces = F.array(whole)
    for size in (CHUNK << 12, CHUNK << 8, CHUNK << 4, CHUNK):
        pieces = F.flatten(F.transform(pieces, _cut(size)))
    cut = (
        records.withColumn("row", F.monotonically_increasing_id())
        .withColumn("pieces", pieces)
        .drop("payload")
        .withColumn("chunks", F.size("pieces"))
    )
    others = [name for name in cut.columns if name != "pieces"]
    parts = cut.select(*others, F.posexplode("pieces").alias("chunk", "content"))
    return parts.withColumn("chunk", F.col("chunk") + 1)


def _record(date: str) -> Column:
    """The text of a chunk's record, without the two line ends that close it."""
    first, revisit = F.col("chunk") == 1, F.col("refers_to").isNotNull()
    several = F.col("chunks") > 1
    kind = F.when(revisit, "revisit").when(first, "response").otherwise("continuation")
    name = lambda page: F.concat(F.lit("<urn:page:"), page.cast("string"), F.lit(">"))
    own = F.concat(
        F.lit("<urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("none")),
        F.when(several, F.concat(F.lit(":"), F.col("chunk").cast("string"))).otherwise(""), F.lit(">"),
    )
    origin = F.concat(
        F.lit("<urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("none")), F.lit(":1>")
    )
    http = F.when(
        first & ~revisit,
        F.concat(
            F.lit("HTTP/1.1 200 OK" + _END),
            _lines(("Content-Type", F.lit("text/html; charset=utf-8")), ("Content-Length", F.col("size"))),
            F.lit(_END),
        ),
    ).otherwise("")
    block = F.concat(http, "content")
    head = _lines(
        ("WARC-Type", kind),
        ("WARC-Record-ID", own),
        ("WARC-Date", F.lit(date)),
        # White space and line ends have no place in an address.
        ("WARC-Target-URI", F.regexp_replace("url", r"\s", "%20")),
        ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "sha1")),
        ("WARC-Profile", F.when(revisit, _PROFILE)),
        ("WARC-Refers-To", F.when(revisit, name(F.col("refers_to")))),
        ("WARC-Segment-Number", F.when(several, F.col("chunk"))),
        ("WARC-Segment-Origin-ID", F.when(several & ~first, origin)),
        ("WARC-Segment-Total-Length", F.when(several & (F.col("chunk") == F.col("chunks")), F.col("size"))),
        ("Content-Type", F.when(first & ~revisit, "application/http;msgtype=response")),
        # Not of the standard: the row in the table, its page, and how many chunks there are.
        ("Tallytide-Row", F.col("row")),
        ("Tallytide-Page", F.col("page_id")),
        ("Tallytide-Refers-To", F.col("refers_to")),
        ("Tallytide-Chunks", F.col("chunks")),
        ("Content-Length", F.octet_length(block)),
    )
    return F.concat(F.lit("WARC/1.1" + _END), head, F.lit(_END), block)


def write_archives(
    pages: DataFrame,
    path: str,
    id: str = "page_id",
    url: str = "url",
    payload: str = "html",
    least: int = LEAST,
    date: str = "1970-01-01T00:00:00Z",
) -> None:
    """Write every row of ``pages`` as a record to archives in ``path``."""
    rows = pages.select(
        F.col(id).cast("bigint").alias("page_id"),
        F.col(url).cast("string").alias("url"),
        F.coalesce(F.col(payload), F.lit("")).alias("payload"),
    )
    (
        chunked(with_originals(rows, least))
        .select(_record(date).alias("record"))
        .write.options(lineSep=2 * _END, compression="gzip", maxRecordsPerFile=RECORDS_PER_FILE)
        .text(path)
    )


class _Stream:
    """Bytes of a packed file, unpacked as far as they are asked for."""

    def __init__(self, packed: memoryview):
        self.packed, self.at, self.held = packed, 0, bytearray()
        self.unpack = zlib.decompressobj(31)

    def _more(self) -> bool:
        while self.at < len(self.packed) or self.unpack.unconsumed_tail:
            data = self.unpack.unconsumed_tail
            if not data:
                data = bytes(self.packed[self.at : self.at + _PIECE])
                self.at += len(data)
            fresh = self.unpack.decompress(data, _PIECE)
            if fresh:
                self.held += fresh
                return True
        return False

    def take(self, size: int) -> bytes:
        while len(self.held) < size:
            if not self._more():
                raise ValueError("an archive ends inside a record")
        taken = bytes(self.held[:size])
        del self.held[:size]
        return taken

    def take_to(self, mark: bytes) -> bytes | None:
        """Bytes before the next mark, which is skipped; None at the end."""
        seen = 0
        while (found := self.held.find(mark, seen)) < 0:
            seen = max(0, len(self.held) - len(mark) + 1)
            if not self._more():
                if self.held:
                    raise ValueError("an archive ends inside a header")
                return None
        taken = bytes(self.held[:found])
        del self.held[: found + len(mark)]
        return taken


def parse(packed: memoryview) -> Iterator[tuple]:
    """Chunk rows of one archive, as in ``_SCHEMA``."""
    stream = _Stream(packed)
    while (head := stream.take_to(b"\r\n\r\n")) is not None:
        version, *lines = head.decode().split(_END)
        if not version.startswith("WARC/"):
            raise ValueError("not a WARC record")
        fields = dict(line.split(": ", 1) for line in lines)
        block = stream.take(int(fields["Content-Length"]))
        if stream.take(4) != b"\r\n\r\n":
            raise ValueError("a record is longer than it says")
        kind = fields["WARC-Type"]
        if kind == "response":
            block = block[block.index(b"\r\n\r\n") + 4 :]
        number = lambda name: int(fields[name]) if name in fields else None
        chunks = int(fields["Tallytide-Chunks"])
        whole = chunks == 1 and kind != "revisit"
        yield (
            int(fields["Tallytide-Row"]),
            number("Tallytide-Page"),
            "revisit" if kind == "revisit" else "response",
            number("Tallytide-Refers-To"),
            fields["WARC-Payload-Digest"].removeprefix("sha1:"),
            int(fields.get("WARC-Segment-Number", 1)),
            chunks,
            len(block),
            hashlib.sha1(block).hexdigest() if whole else None,
            block if chunks > 1 else None,
        )


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """The chunked record table of the archives in ``path``; one chunk keeps no content."""
    importable(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for packed in batch.column(0):
                rows: list[tuple] = []
                held = 0
                for row in parse(memoryview(packed.as_buffer())):
                    rows.append(row)
                    held += len(row[-1] or b"")
                    if len(rows) == 5000 or held > 1 << 24:
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(c, k) for c, k in zip(zip(*rows), _KINDS)], names=_NAMES
                        )
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, k) for c, k in zip(zip(*rows), _KINDS)], names=_NAMES
                    )

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return files.select("content").mapInArrow(run, _SCHEMA)


def payloads(chunks: DataFrame) -> DataFrame:
    """(page_id, record_type, refers_to, size, digest) of each record, from its chunks.

    Raises an error if a payload is not what its record claims.
    """
    importable(chunks.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest, size, last = None, 0, None
        for batch in batches:
            rows = []
            for row in zip(*(column.to_pylist() for column in batch.columns)):
                record, page, kind, refers_to, claimed, chunk, n, length, whole, content = row
                if n > 1:
                    if chunk == 1:
                        digest, size, last = hashlib.sha1(), 0, (record, 0)
                    if last != (record, chunk - 1):
                        raise ValueError(f"chunk {chunk} of page {page} has no predecessor")
                    digest.update(content)
                    size, last = size + length, (record, chunk)
                    if chunk < n:
                        continue
                    whole, length = digest.hexdigest(), size
                if whole is not None and whole != claimed:
                    raise ValueError(f"the payload of page {page} is damaged")
                rows.append((page, kind, refers_to, length if whole else None, whole))
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names
                )

    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]
    names = ["page_id", "record_type", "refers_to", "size", "digest"]
    return (
        chunks.repartition("row")
        .sortWithinPartitions("row", "chunk")
        .mapInArrow(
            run, "page_id bigint, record_type string, refers_to bigint, size bigint, digest string"
        )
    )


def archived(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of every record.

    Size and digest of a revisit are those of the response it refers to.
    """
    found = written(payloads(read_chunks(spark, path)))
    originals = (
        found.where("record_type = 'response'")
        .join(found.select(F.col("refers_to").alias("page_id")).distinct(), "page_id", "left_semi")
        .groupBy("page_id")
        .agg(F.max("size").alias("_size"), F.max("digest").alias("_digest"))
        .withColumnRenamed("page_id", "refers_to")
    )
    return found.join(originals, "refers_to", "left").select(
        "page_id",
        F.coalesce("size", "_size").alias("payload_bytes"),
        F.coalesce("digest", "_digest").alias("payload_digest"),
        "record_type",
        "refers_to",
    )
