"""WARC archives in Zstandard with a shared dictionary: writing and reading.

An archive is one file. It begins with a skippable frame that holds the dictionary; after
that every record is one Zstandard frame, compressed with that dictionary. Readers find
the dictionary in the leading frame, decode frame after frame, and check every record's
header and length.

Spark's text writer writes the archives, so they reach any store that Spark can write,
and a task that is lost or repeated leaves no half archive. The writer needs a separator
between rows: an empty skippable frame, which is valid between the frames of a Zstandard
file and which readers pass over.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator
from datetime import UTC, datetime

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import attach, stored

#: Magic numbers of the Zstandard format, little-endian.
FRAME_MAGIC = 0xFD2FB528
SKIPPABLE_FIRST = 0x184D2A50
#: The skippable frame that holds a dictionary in WARC files.
DICTIONARY_MAGIC = 0x184D2A5D

SEPARATOR = struct.pack("<II", SKIPPABLE_FIRST, 0).decode("latin-1")
CRLF = b"\r\n"

#: Fixed value: dates of WARC records, in UTC, with up to nine decimals of a second.
DATE = re.compile(r"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(\.\d{1,9})?Z")

#: Payloads below this many bytes are always written in full.
REVISIT_BYTES = 1000
#: Bytes of payload that one archive is meant to hold.
ARCHIVE_BYTES = 32_000_000
#: The dictionary is trained on at most so many pages, and so many bytes of each.
SAMPLE_PAGES = 400
SAMPLE_PAGE_BYTES = 16_384
DICTIONARY_BYTES = 65_536
LEVEL = 3


def train_dictionary(pages: DataFrame, identifier: str, payload: str) -> bytes:
    """A Zstandard dictionary from a bounded sample of payloads, in a fixed order.

    Only compression depends on it. Too few samples to train on give plain content.
    """
    # identifiers first: tasks hand on no payload that is not chosen
    chosen = pages.select(identifier).distinct().orderBy(F.xxhash64(identifier)).limit(SAMPLE_PAGES)
    sample = (
        pages.join(F.broadcast(chosen), identifier)
        .select(F.substring(payload, 1, SAMPLE_PAGE_BYTES).alias("start"))
        .orderBy(F.length("start"), "start")
        .limit(SAMPLE_PAGES)
        .collect()
    )
    samples = [bytes(row["start"]) for row in sample if row["start"]]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(samples)[:DICTIONARY_BYTES]


def with_record_types(
    pages: DataFrame,
    archives: int,
    identifier: str = "page_id",
    payload: str = "payload",
    least: int = REVISIT_BYTES,
    url: str = "url",
) -> DataFrame:
    """Add ``payload_digest`` (SHA-1), ``record_type``, ``refers_to`` and ``refers_to_url``;
    in ``archives`` parts. Columns that are called so already are replaced.

    Of equal payloads of at least ``least`` bytes the row with the largest identifier is
    the response; others are revisits that refer to it. Payloads are equal if length,
    SHA-256 and SHA-1 are. Payloads that rows share are counted by digest before any
    payload moves. A row without an identifier is a response, and so is a repeated row
    with the response's identifier.
    """
    pages = pages.drop("payload_digest", "record_type", "refers_to", "refers_to_url")
    digested = pages.withColumn("payload_digest", F.sha1(payload)).withColumn(
        "_content", F.unhex(F.concat(F.sha2(payload, 256), "payload_digest"))
    )
    long = digested.where(F.length(payload) >= least)
    shared = stored(
        long.groupBy("_content", F.length(payload))
        .agg(
            F.count(F.lit(1)).alias("_size"),
            F.max(identifier).alias("_response"),
            F.max_by(url, identifier).alias("_url"),
        )
        .where("_size > 1")
        .select("_content", "_size", "_response", "_url")
    )
    key = [identifier, "_content"]
    revisits = stored(
        attach(stored(long.select(*key)), shared, "_content", "_size", how="inner")
        .where(F.col(identifier) != F.col("_response"))
        .select(*key, F.col("_response").alias("refers_to"), F.col("_url").alias("refers_to_url"))
        .distinct()
    )
    # both sides dealt out alike: the join and the archives share one shuffle
    return (
        digested.repartition(archives, *key)
        .join(revisits.repartition(archives, *key), key, "left")
        .drop("_content")
        .withColumn("record_type", F.when(F.col("refers_to").isNull(), "response").otherwise("revisit"))
    )


def record(
    identifier, url: str, payload: bytes, digest: str, kind: str, refers_to, refers_to_url, date: str
) -> bytes:
    """One WARC record. A revisit has no block; its headers name the response."""
    block = payload if kind == "response" else b""
    lines = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: {_name(identifier)}",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {_one_line(url)}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"WARC-Payload-Length: {len(payload)}",
    ]
    if kind == "revisit":
        lines.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        lines.append(f"WARC-Refers-To: {_name(refers_to)}")
        lines.append(f"WARC-Refers-To-Target-URI: {_one_line(refers_to_url)}")
        lines.append(f"WARC-Refers-To-Date: {date}")
    lines += ["Content-Type: text/html", f"Content-Length: {len(block)}"]
    head = CRLF.join(line.encode() for line in lines)
    return head + CRLF + CRLF + block + CRLF + CRLF


def _name(identifier) -> str:
    return f"<urn:page:{'' if identifier is None else _one_line(str(identifier))}>"


def _one_line(text: str | None) -> str:
    return "".join(f"%{ord(c):02X}" if c < " " or c == "\x7f" else c for c in text or "")


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (names in lower case) and block; ``ValueError`` where they are not valid."""
    head, mark, rest = raw.partition(CRLF + CRLF)
    lines = head.split(CRLF)
    if not mark or lines[0] not in (b"WARC/1.0", b"WARC/1.1"):
        raise ValueError("no WARC header")
    headers = {}
    for line in lines[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            raise ValueError(f"header without a colon: {line[:80]!r}")
        headers[name.decode().strip().lower()] = value.decode().strip()
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if name not in headers:
            raise ValueError(f"header {name} is missing")
    if not DATE.fullmatch(headers["warc-date"]):
        raise ValueError(f"no date: {headers['warc-date'][:80]!r}")
    length = int(headers["content-length"])
    if len(rest) != length + 4 or rest[length:] != CRLF + CRLF:
        raise ValueError(f"block of {len(rest) - 4} bytes, {length} are said")
    block = rest[:length]
    if headers["warc-type"] == "response" and "warc-payload-digest" in headers:
        if headers["warc-payload-digest"] != f"sha1:{hashlib.sha1(block).hexdigest()}":
            raise ValueError("the payload differs from its digest")
        if int(headers.get("warc-payload-length", length)) != length:
            raise ValueError("the payload differs from its length")
    return headers, block


def _frame_end(data: memoryview, at: int) -> int:
    """Where the Zstandard frame at ``at`` ends, from its block headers."""
    size = zstandard.frame_header_size(bytes(data[at : at + 18]))
    checksum = zstandard.get_frame_parameters(bytes(data[at : at + 18])).has_checksum
    at += size
    while True:
        if at + 3 > len(data):
            raise ValueError("a frame is cut off")
        header = int.from_bytes(data[at : at + 3], "little")
        last, kind, length = header & 1, (header >> 1) & 3, header >> 3
        at += 3 + (1 if kind == 1 else length)
        if last:
            break
    at += 4 if checksum else 0
    if at > len(data):
        raise ValueError("a frame is cut off")
    return at


def read_archive(content: bytes) -> Iterator[bytes]:
    """The decompressed records of one archive, one frame each."""
    data = memoryview(content)
    decompressor = zstandard.ZstdDecompressor()
    at = 0
    while at < len(data):
        if at + 8 > len(data):
            raise ValueError("a frame is cut off")
        magic, length = struct.unpack("<II", data[at : at + 8])
        if SKIPPABLE_FIRST <= magic < SKIPPABLE_FIRST + 16:
            end = at + 8 + length
            if end > len(data):
                raise ValueError("a skippable frame is cut off")
            if magic == DICTIONARY_MAGIC and at == 0:
                decompressor = zstandard.ZstdDecompressor(
                    dict_data=zstandard.ZstdCompressionDict(bytes(data[at + 8 : end]))
                )
            at = end
        elif magic == FRAME_MAGIC:
            end = _frame_end(data, at)
            yield decompressor.decompress(bytes(data[at:end]))
            at = end
        else:
            raise ValueError(f"no Zstandard frame at byte {at}")


def write_archives(
    pages: DataFrame,
    path: str,
    dictionary: bytes,
    identifier: str = "page_id",
    url: str = "url",
    payload: str = "payload",
    date: str | None = None,
) -> None:
    """One record per row of ``with_record_types``, one archive per partition, at ``path``.

    Every archive begins with the dictionary. Missing payloads must be empty ones. Records
    carry ``date``, by default the time of this call, which a repeated task repeats.
    """
    date = date or datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    if not DATE.fullmatch(date):
        raise ValueError(f"no date of a WARC record: {date!r}")
    sent = pages.sparkSession.sparkContext.broadcast(dictionary)

    def compress(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw = sent.value
        compressor = zstandard.ZstdCompressor(
            level=LEVEL,
            dict_data=zstandard.ZstdCompressionDict(raw) if raw else None,
            write_content_size=True,
            write_checksum=True,
        )
        first = [struct.pack("<II", DICTIONARY_MAGIC, len(raw)) + raw] if raw else []
        for batch in batches:
            frames = first
            first = []
            for row in batch.to_pylist():
                frames.append(
                    compressor.compress(
                        record(
                            row["id"], row["url"], row["payload"], row["payload_digest"],
                            row["record_type"], row["refers_to"], row["refers_to_url"], date,
                        )
                    )
                )
            yield pa.RecordBatch.from_arrays([pa.array(frames, pa.binary())], names=["frame"])

    rows = pages.select(
        F.col(identifier).alias("id"),
        F.col(url).alias("url"),
        F.col(payload).alias("payload"),
        "payload_digest",
        "record_type",
        "refers_to",
        "refers_to_url",
    )
    # the bytes go through as they are: a string of Spark is bytes to the writer
    frames = rows.mapInArrow(compress, "frame binary").select(F.col("frame").cast("string"))
    frames.write.option("lineSep", SEPARATOR).option("maxRecordsPerFile", 0).text(path)


def read_archives(spark: SparkSession, path: str, blocks: bool = True) -> DataFrame:
    """One row per record: ``record_id, url, payload_bytes, payload_digest, record_type,
    refers_to_id, block``.

    ``block`` is null without ``blocks``; it is checked all the same. An invalid archive or
    record fails with its file's name. Archives are tens of megabytes, read whole, one
    task each.
    """

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for place, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                rows, size = [], 0
                try:
                    for raw in read_archive(content.as_py()):
                        headers, block = parse_record(raw)
                        rows.append(
                            {
                                "record_id": headers["warc-record-id"],
                                "url": headers.get("warc-target-uri"),
                                "payload_bytes": int(headers["warc-payload-length"]),
                                "payload_digest": headers["warc-payload-digest"].removeprefix("sha1:"),
                                "record_type": headers["warc-type"],
                                "refers_to_id": headers.get("warc-refers-to"),
                                "block": block if blocks else None,
                            }
                        )
                        size += len(block)
                        if size > 8_000_000:
                            yield pa.RecordBatch.from_pylist(rows, schema=arrow)
                            rows, size = [], 0
                except (ValueError, KeyError, zstandard.ZstdError) as error:
                    raise ValueError(f"{place}: {error}") from error
                yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    text = ("record_id", "url", "payload_digest", "record_type", "refers_to_id")
    order = "record_id url payload_bytes payload_digest record_type refers_to_id block".split()
    kinds = {"payload_bytes": pa.int64(), "block": pa.binary()} | dict.fromkeys(text, pa.string())
    arrow = pa.schema([(name, kinds[name]) for name in order])
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(
        records,
        "record_id string, url string, payload_bytes bigint, payload_digest string, "
        "record_type string, refers_to_id string, block binary",
    )


def archive_count(pages: DataFrame, payload: str = "payload") -> int:
    """How many archives of about ``ARCHIVE_BYTES`` the payloads fill."""
    total = pages.agg(F.sum(F.length(payload))).first()[0] or 0
    return max(1, -(-total // ARCHIVE_BYTES))
