"""WARC records in a content-addressed archive.

Payload bytes are stored once under their verified SHA-256; exact record
headers are kept separately; original records come back by a join. Built-in
functions do it all; files of others are parsed in Python.
"""

from __future__ import annotations

import io
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.common import shuffles_removed

PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Record ids name the page, so a revisit's header tells what it refers to.
ID_PREFIX = "urn:gridloom:page:"
DATE = "1970-01-01T00:00:00Z"

_BASE32_HEX, _BASE32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32_sha1(data: Column) -> Column:
    """Bare upper-case base32 of the SHA-1 of a binary column: four groups of forty bits."""
    digest = F.sha1(data)
    groups = [F.lpad(F.conv(F.substring(digest, 10 * i + 1, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.concat(*groups), _BASE32_HEX, _BASE32)


def _line(name: str, value: Column) -> Column:
    """A header line; none where the value is null; line breaks in values are escaped."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), F.replace(F.replace(value.cast("string"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A")), F.lit("\r\n")), F.lit(""))


def write_archive(pages: DataFrame, path: str, min_bytes: int = 0, date: str = DATE) -> None:
    """Write one WARC record for each row of ``pages`` (page_id, url, html) below ``path``.

    ``path``/records: page_id, address, header (exact bytes up to the payload);
    ``path``/payloads: address, payload, once for each distinct payload. Of
    rows with equal payloads of at least ``min_bytes`` the one with the largest
    page_id is a response, the others are revisits of it.

    Null html: an empty payload. Null url: no target line. Null page_id: named
    null, a revisit if its payload has a row with an id, else a response. Rows
    that repeat the largest page_id and the payload are all responses. Empty
    table: empty archive. Other columns are not read.
    """
    again = F.pmod(F.crc32("address"), F.lit(1024)).alias("again")
    body = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    keyed = pages.select("page_id", "url", F.sha2(body, 256).alias("address"), F.length(body).cast("long").alias("n"), base32_sha1(body).alias("digest"))
    largest = pages.select("page_id", F.sha2(body, 256).alias("address")).groupBy("address").agg(F.max("page_id").alias("first"))
    joined = keyed.select("*", again).join(largest.select("address", "first", again), ["address", "again"])
    own = F.col("first").isNull() | F.coalesce(F.col("page_id") == F.col("first"), F.lit(False)) | (F.col("n") < min_bytes)
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("n").cast("string"), F.lit("\r\n\r\n"))
    name = F.concat(F.lit(f"<{ID_PREFIX}"), F.coalesce(F.col("page_id").cast("string"), F.lit("null")), F.lit(">"))
    revisit = F.when(
        ~own,
        F.concat(_line("WARC-Refers-To", F.concat(F.lit(f"<{ID_PREFIX}"), F.col("first").cast("string"), F.lit(">"))), _line("WARC-Profile", F.lit(PROFILE))),
    ).otherwise(F.lit(""))
    header = F.concat(
        F.lit("WARC/1.1\r\n"),
        _line("WARC-Type", F.when(own, F.lit("response")).otherwise(F.lit("revisit"))),
        _line("WARC-Record-ID", name),
        _line("WARC-Date", F.lit(date)),
        _line("WARC-Target-URI", F.col("url")),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        revisit,
        _line("Content-Type", F.lit("application/http; msgtype=response")),
        _line("Content-Length", F.length(http) + F.when(own, F.col("n")).otherwise(F.lit(0))),
        F.lit("\r\n"),
        http,
    )
    with shuffles_removed(pages.sparkSession):
        joined.select("page_id", "address", F.encode(header, "UTF-8").alias("header")).write.parquet(f"{path}/records")
    # one row for each address: the largest page_id's, or any where no row has an id
    store = pages.select("page_id", body.alias("payload")).select("page_id", F.sha2("payload", 256).alias("address"), "payload")
    named = store.join(largest.where("first is not null").select(F.col("first").alias("page_id"), "address"), ["page_id", "address"], "left_semi").select("address", "payload")
    nameless = store.where("page_id is null").join(largest.where("first is null").select("address"), "address", "left_semi").dropDuplicates(["address"]).select("address", "payload")
    with shuffles_removed(pages.sparkSession):
        named.union(nameless).write.parquet(f"{path}/payloads")


def _field(head: Column, name: str) -> Column:
    """A field of a header; empty where it is missing."""
    return F.regexp_extract(head, rf"\r\n{name}: ([^\r\n]*)", 1)


def _page(field: Column) -> Column:
    """The page that a record's name tells; null where it tells none."""
    number = F.regexp_extract(field, rf"<{ID_PREFIX}(-?\d+)>", 1)
    return F.when(number != "", number).cast("long")


def _rebuilt(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, address, record, n, digest, same): each record's exact bytes, and what its stored payload is."""
    again = F.pmod(F.crc32("address"), F.lit(1024)).alias("again")
    stored = spark.read.parquet(f"{path}/payloads").select(
        "address", "payload", F.length("payload").cast("long").alias("n"), base32_sha1(F.col("payload")).alias("digest"), (F.sha2("payload", 256) == F.col("address")).alias("same"), again
    )
    own = _field(F.decode("header", "UTF-8"), "WARC-Type") == "response"
    joined = spark.read.parquet(f"{path}/records").select("*", own.alias("own"), again).join(stored, ["address", "again"], "left")
    end = F.encode(F.lit("\r\n\r\n"), "UTF-8")
    record = F.concat("header", F.when(F.col("own"), F.col("payload")).otherwise(F.encode(F.lit(""), "UTF-8")), end)
    return joined.select("page_id", "address", record.alias("record"), "n", "digest", "same")


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """What an archive's records say: each is rebuilt from its header and payload and read again.

    Columns: page_id, record_type, payload_bytes, payload_digest, refers_to.
    A response's size and digest are those of the payload in its record, a
    revisit's those its headers name. A payload that is missing, or does not
    have its address, or another size or digest than a record says, raises an
    error.
    """
    end = "\r\n\r\n"
    head = F.substring_index(F.col("record").cast("string"), end, 1)
    size = _field(F.col("head"), "Content-Length").cast("int")
    read = _rebuilt(spark, path).withColumn("head", head).withColumn("block", F.substring(F.col("record"), F.octet_length("head") + F.lit(5), size)).drop("record")
    read = read.withColumn("http", F.substring_index(F.col("block").cast("string"), end, 1))
    payload = F.substring(F.col("block"), F.octet_length("http") + F.lit(5), F.length("block"))
    kind, said = _field(F.col("head"), "WARC-Type"), _field(F.col("head"), "WARC-Payload-Digest")
    own = kind == "response"
    bytes_ = F.when(own, F.length(payload)).otherwise(_field(F.col("http"), "Content-Length").cast("long")).cast("long")
    digest = F.when(own, base32_sha1(payload)).otherwise(F.substring_index(said, "sha1:", -1))
    out = read.select(
        "address", "n", "same", F.col("digest").alias("stored"), said.alias("said"), _page(_field(F.col("head"), "WARC-Record-ID")).alias("page_id"), kind.alias("record_type"),
        bytes_.alias("payload_bytes"), digest.alias("digest"), _page(_field(F.col("head"), "WARC-Refers-To")).alias("refers_to"),
    )
    right = F.col("same") & (F.col("n") == F.col("payload_bytes")) & (F.col("stored") == F.col("digest")) & (F.col("said") == F.concat(F.lit("sha1:"), F.col("stored")))
    checked = F.when(F.coalesce(right, F.lit(False)), F.col("digest")).otherwise(F.raise_error(F.concat(F.lit("payload does not match its digest: "), F.col("address"))).cast("string"))
    return out.select("page_id", "record_type", "payload_bytes", checked.alias("payload_digest"), "refers_to")


def reconstruct_records(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, record): the exact bytes of each WARC record, payload joined to header again; an empty archive has none."""
    return _rebuilt(spark, path).select("page_id", "record")


def parse_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields, block) of each record of a WARC file, plain or gzip by record; a cut-off last record is left out."""
    plain = bytearray()
    while data[:2] == b"\x1f\x8b":
        member = zlib.decompressobj(31)
        plain += member.decompress(data)
        if not member.eof:
            break
        data = member.unused_data
    stream = io.BytesIO(bytes(plain) or data)
    while version := stream.readline():
        if not version.strip():
            continue
        if not version.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {version[:40]!r}")
        fields, last = {}, None
        while (line := stream.readline()) and line.strip():
            text = line.decode("utf-8", "replace").rstrip("\r\n")
            if text[:1] in " \t" and last:
                fields[last] += " " + text.strip()
            else:
                last, _, value = text.partition(":")
                fields[last] = value.strip()
        size = int({k.lower(): v for k, v in fields.items()}.get("content-length", 0))
        block = stream.read(size)
        if len(block) < size:
            return
        yield fields, block


def read_warc_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, position, fields, block) of every record of WARC files that Spark can reach."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.int64(), pa.map_(pa.string(), pa.string()), pa.binary()]
        for batch in batches:
            for file, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for n, (fields, block) in enumerate(parse_warc(content.as_py())):
                    yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip((file, n, list(fields.items()), block), kinds, strict=True)], ["path", "position", "fields", "block"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "path string, position long, fields map<string,string>, block binary")
