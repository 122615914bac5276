import struct

import pytest
import zstandard
from compare import connect, differences
from conftest import FOLDER
from pyspark.sql import functions as F

from plumbline.llm import url_filter, warc
from plumbline.llm.common import attach, shared_path, stored
from plumbline.llm.queries import QUERIES, SQL, URL_RULES


@pytest.mark.parametrize("name", ["op2_url_filter", "op5_warc"])
@pytest.mark.parametrize("folder", [FOLDER, "/root/testdata/sf0.01"])
def test_queries_as_sql(spark, name, folder):
    assert differences(QUERIES[name](spark, folder), connect(folder), SQL[name]) == []


# --- URLs -------------------------------------------------------------------

URLS = [
    (1, "http://A.Example.COM/en/x?q#f", "a.example.com", "/en/x", "example.com/en/", "block"),
    (2, "https://www.example.com/en/", "www.example.com", "/en/", "www.example.com/en/", "allow"),
    (3, "https://notexample.com/en/", "notexample.com", "/en/", "com/", "allow"),
    (4, "http://x.net/fr/1", "x.net", "/fr/1", "net/fr/", "block"),
    (5, "http://x.net/de/1", "x.net", "/de/1", None, "allow"),
    (6, "http://listed.org", "listed.org", "", None, "block"),
    (7, "ftp://LISTED.org/#part", "listed.org", "/", None, "block"),
    (8, "http://listed.org?x", "listed.org", "", None, "allow"),
    (9, None, "", "", None, "allow"),
    (10, "no scheme", "", "", None, "allow"),
    (11, "://", "", "", None, "allow"),
    (12, "http://ÄX.com?a/b", "Äx.com", "", None, "allow"),
    (13, "http://x.com:80/en/", "x.com:80", "/en/", None, "allow"),
]


def test_rules_and_list(spark):
    pages = spark.createDataFrame(
        [(i, url, "x", "y") for i, url, *_ in URLS], "page_id bigint, url string, host string, block string"
    )
    listed = spark.createDataFrame([("http://listed.org/",), (None,), ("nothing",)] * 2, "url string")
    rows = url_filter.filter_urls(pages, URL_RULES, listed).collect()
    found = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in rows}
    assert found == {i: tuple(rest) for i, _, *rest in URLS}


@pytest.mark.parametrize("blocks", [1 << 17, 1])
def test_a_full_filter_changes_no_verdict(spark, monkeypatch, blocks):
    """One block for all: nearly every page passes it, and the join puts that right."""
    monkeypatch.setattr(url_filter, "MAX_BLOCKS", blocks)
    pages = spark.range(2000).selectExpr(
        "id as page_id", "if(id % 3 = 0, 'http://hot.org/', concat('http://h.org/', id)) as url"
    )
    listed = spark.range(0, 4000, 2).selectExpr("concat('https://h.org/', id) as url")
    listed = listed.union(spark.sql("select 'http://hot.org'"))
    rows = url_filter.filter_urls(pages, [], listed).collect()
    assert len(rows) == 2000
    assert all((r.verdict == "block") == (r.page_id % 3 == 0 or r.page_id % 2 == 0) for r in rows)


def test_most_other_urls_stop_at_the_filter(spark):
    listed = stored(spark.range(20_000).selectExpr("concat('h.org/', id) as canonical"))
    blocks = 20_000 // url_filter.URLS_PER_BLOCK
    filter_rows = url_filter.bloom_filter(listed, blocks)
    others = spark.range(20_000).selectExpr("concat('other.org/', id) as canonical")
    bits = url_filter._bits()
    probed = (
        others.withColumn("_other", url_filter._second_hash())
        .withColumn("block", url_filter._block(blocks))
        .join(filter_rows, "block")
    )
    for i, bit in enumerate(bits):
        probed = probed.where(F.col(f"word{i}").bitwiseAND(bit) == bit)
    assert probed.count() < 200


def test_no_pages_and_no_list(spark):
    pages = spark.createDataFrame([], "page_id bigint, url string")
    assert url_filter.filter_urls(pages, URL_RULES, pages).count() == 0


def test_hot_keys_meet_their_group(spark):
    rows = stored(spark.range(5000).selectExpr("id", "if(id % 3 = 0, 0, id) as k").union(spark.sql("select -1L, null")))
    groups = stored(rows.groupBy("k").agg(F.count("*").alias("n"), F.max("id").alias("top")).where("k is not null"))
    found = {r.id: r.top for r in attach(rows, groups, "k", "n").collect()}
    assert found == {-1: None} | {i: 4998 if i % 3 == 0 else i for i in range(5000)}


# --- archives ---------------------------------------------------------------

LONG = b"p" * 1500
DATE = "2024-05-06T07:08:09Z"


def test_round_trip_of_payloads(spark):
    """Null and empty payloads, repeated ones, control characters and bytes that are no text."""
    rows = [
        (1, "http://a/", LONG), (2, "http://b/\r\nX: y", LONG), (3, None, b""), (4, "u", b"\r\n\r\n\x00\xff"),
        (5, "u", b"short"), (6, "u", b"short"), (None, "n", LONG), (2, "http://b/\r\nX: y", LONG),
    ]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, payload binary")
    path = shared_path(spark)
    typed = warc.with_record_types(pages, 3)
    warc.write_archives(typed, path, warc.train_dictionary(pages, "page_id", "payload"))
    found = warc.read_archives(spark, path).collect()
    assert len(found) == len(rows)
    kinds = sorted((r.record_id, r.record_type, r.refers_to_id) for r in found if r.payload_bytes == 1500)
    two = "<urn:page:2>"
    assert kinds == [("<urn:page:1>", "revisit", two)] + [(two, "response", None)] * 2 + [("<urn:page:>", "response", None)]
    blocks = sorted(bytes(r.block) for r in found if r.record_type == "response")
    assert blocks == sorted([LONG, LONG, LONG, b"", b"\r\n\r\n\x00\xff", b"short", b"short"])


def test_headers_that_every_record_needs(spark):
    rows = [(1, "http://a/", LONG), (2, "http://b/", LONG), (3, "http://c/", b"x")]
    # a table that already has columns of these names
    pages = spark.createDataFrame(rows, "page_id bigint, url string, payload binary").selectExpr(
        "*", "'z' as refers_to", "1 as record_type", "2 as payload_digest", "3 as refers_to_url"
    )
    path = shared_path(spark)
    warc.write_archives(warc.with_record_types(pages, 1), path, b"", date=DATE)
    files = spark.read.format("binaryFile").load(path).collect()
    found = [warc.parse_record(raw)[0] for file in files for raw in warc.read_archive(bytes(file.content))]
    assert len(found) == 3
    for headers in found:
        assert headers["warc-date"] == DATE
        if headers["warc-type"] == "revisit":
            assert headers["warc-refers-to"] == "<urn:page:2>"
            assert headers["warc-refers-to-target-uri"] == "http://b/"
            assert headers["warc-refers-to-date"] == DATE
    with pytest.raises(ValueError, match="no date"):
        warc.write_archives(warc.with_record_types(pages, 1), path, b"", date="today")


@pytest.mark.parametrize("line", [b"", b"WARC-Date: today\r\n", b"WARC-Date: 2024-05-06\r\n"])
def test_records_without_a_date_are_refused(line):
    raw = b"WARC/1.1\r\nWARC-Type: x\r\nWARC-Record-ID: y\r\n" + line + b"Content-Length: 0\r\n\r\n\r\n\r\n"
    with pytest.raises(ValueError):
        warc.parse_record(raw)


def test_no_pages_no_records(spark):
    pages = spark.createDataFrame([], "page_id bigint, url string, payload binary")
    path = shared_path(spark)
    assert warc.archive_count(pages) == 1
    warc.write_archives(warc.with_record_types(pages, 1), path, warc.train_dictionary(pages, "page_id", "payload"))
    assert warc.read_archives(spark, path).count() == 0


def archive(records, dictionary=b"some dictionary content " * 20, checksum=True):
    compressor = zstandard.ZstdCompressor(
        dict_data=zstandard.ZstdCompressionDict(dictionary), write_checksum=checksum
    )
    head = struct.pack("<II", warc.DICTIONARY_MAGIC, len(dictionary)) + dictionary
    return head + b"".join(compressor.compress(r) + warc.SEPARATOR.encode("latin-1") for r in records)


def test_reading_needs_the_dictionary_of_the_leading_frame():
    records = [warc.record(i, "u", bytes([i]) * 3000 * i, "0" * 40, "revisit", 0, "v", DATE) for i in range(4)]
    assert list(warc.read_archive(archive(records))) == records
    assert list(warc.read_archive(archive(records, checksum=False))) == records
    assert list(warc.read_archive(b"")) == []


@pytest.mark.parametrize(
    "broken",
    [
        lambda a: a[:-12],
        lambda a: a[:6],
        lambda a: a + b"rest of a file",
        lambda a: b"WARC/1.1\r\n\r\n" + a,
        lambda a: a[:30] + bytes([a[30] ^ 1]) + a[31:-30] + bytes([a[-30] ^ 255]) + a[-29:],
    ],
)
def test_broken_archives_are_noticed(broken):
    whole = archive([warc.record(1, "u", LONG + bytes(range(256)), "0" * 40, "revisit", 2, "v", DATE)])
    with pytest.raises((ValueError, zstandard.ZstdError)):
        list(warc.read_archive(broken(whole)))


@pytest.mark.parametrize(
    "raw",
    [
        b"HTTP/1.1 200\r\n\r\n",
        b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 0\r\n\r\n\r\n\r\n",
        b"WARC/1.1\r\nWARC-Type: x\r\nWARC-Record-ID: y\r\nWARC-Date: 2024-05-06T07:08:09Z\r\nContent-Length: 3\r\n\r\nab\r\n\r\n",
        b"WARC/1.1\r\nWARC-Type: x\r\nno colon\r\nWARC-Record-ID: y\r\nWARC-Date: 2024-05-06T07:08:09Z\r\nContent-Length: 0\r\n\r\n\r\n\r\n",
        warc.record(1, "u", b"body", "0" * 40, "response", None, None, DATE),
    ],
)
def test_invalid_records_are_refused(raw):
    with pytest.raises(ValueError):
        warc.parse_record(raw)
