"""WARC archive: round trips, damage, odd rows; the query has SQL."""

import gzip
import hashlib
from base64 import b32encode

import pytest

from gridloom.llm.common import new_path
from gridloom.llm.warc import ID_PREFIX, parse_warc, read_archive, read_warc_files, reconstruct_records, write_archive

ROWS = [(1, "http://a/", "<p>é</p>"), (2, "http://b/\r\nX: y", "<p>é</p>"), (3, None, None), (4, "http://d/", ""), (5, "http://e/", "other\r\n\r\nWARC/1.1"), (None, "http://f/", "<p>é</p>"), (None, "http://g/", "alone")]


@pytest.fixture(scope="module")
def archive(spark):
    path = new_path(spark, "warc-test")
    write_archive(spark.createDataFrame(ROWS, "page_id long, url string, html string").selectExpr("*", "'x' as address", "1 as first"), path)
    return path


def test_read_back(spark, archive):
    got = {r["page_id"]: r for r in read_archive(spark, archive).where("page_id is not null").collect()}
    for page, _, html in ROWS:
        if page is not None:
            payload = (html or "").encode()
            assert got[page]["payload_bytes"] == len(payload)
            assert got[page]["payload_digest"] == b32encode(hashlib.sha1(payload).digest()).decode()
    assert {p: (r["record_type"], r["refers_to"]) for p, r in got.items()} == {1: ("revisit", 2), 2: ("response", None), 3: ("revisit", 4), 4: ("response", None), 5: ("response", None)}


def test_rows_without_an_id(spark, archive):
    rows = read_archive(spark, archive).where("page_id is null").collect()
    assert sorted((r["payload_bytes"], r["record_type"], r["refers_to"]) for r in rows if r["refers_to"] is None) == [(5, "response", None)]
    assert [(r["record_type"], r["refers_to"]) for r in rows if r["refers_to"] is not None] == [("revisit", 2)]


def test_payloads_are_stored_once(spark, archive):
    assert spark.read.parquet(f"{archive}/payloads").count() == 4


def test_reconstructed_records_parse(spark, archive):
    records = [bytes(r["record"]) for r in reconstruct_records(spark, archive).orderBy("page_id").collect()]
    plain, zipped = b"".join(records), b"".join(gzip.compress(r) for r in records)
    assert list(parse_warc(plain)) == list(parse_warc(zipped))
    by_id = {f["WARC-Record-ID"]: (f, block) for f, block in parse_warc(plain)}
    fields, block = by_id[f"<{ID_PREFIX}2>"]
    assert fields["WARC-Type"] == "response" and block.endswith(b"\r\n\r\n<p>\xc3\xa9</p>") and fields["WARC-Target-URI"] == "http://b/%0D%0AX: y"
    fields, block = by_id[f"<{ID_PREFIX}1>"]
    assert fields["WARC-Refers-To"] == f"<{ID_PREFIX}2>" and block.endswith(b"\r\n\r\n") and "WARC-Target-URI" in fields
    assert "WARC-Target-URI" not in by_id[f"<{ID_PREFIX}3>"][0]


def test_small_payloads_stay_responses(spark):
    path = new_path(spark, "warc-test")
    write_archive(spark.createDataFrame(ROWS[:5], "page_id long, url string, html string"), path, min_bytes=5)
    assert {r["page_id"]: r["record_type"] for r in read_archive(spark, path).collect()} == {1: "revisit", 2: "response", 3: "response", 4: "response", 5: "response"}


def test_damage_is_found(spark, archive):
    path = new_path(spark, "warc-test")
    spark.read.parquet(f"{archive}/records").write.parquet(f"{path}/records")
    spark.read.parquet(f"{archive}/payloads").selectExpr("address", "cast(concat(cast(payload as string), '!') as binary) as payload").write.parquet(f"{path}/payloads")
    with pytest.raises(Exception, match="does not match"):
        read_archive(spark, path).collect()


def test_empty_table(spark):
    path = new_path(spark, "warc-test")
    write_archive(spark.createDataFrame([], "page_id long, url string, html string"), path)
    assert read_archive(spark, path).count() == 0


def test_files_of_others(spark, tmp_path):
    record = b"WARC/1.0\r\nWARC-Type: warcinfo\r\nX-Folded: a\r\n b\r\ncontent-length: 3\r\n\r\nabc\r\n\r\n"
    (tmp_path / "a.warc").write_bytes(record * 2)
    (tmp_path / "b.warc.gz").write_bytes(gzip.compress(record) + gzip.compress(record)[:-5])
    rows = read_warc_files(spark, f"file://{tmp_path}").collect()
    assert len(rows) >= 3 and all(bytes(r["block"]) == b"abc" and r["fields"]["X-Folded"] == "a b" for r in rows)
    with pytest.raises(ValueError):
        list(parse_warc(b"HTTP/1.1 200 OK\r\n\r\n"))
