"""Deduplicated WARC archives with revisit records, and a reader for them.

Narrow headers (identifier, payload digest, length) are shuffled by digest to find the original of each payload; the
originals of payloads that occur again are joined to the records, which become ``response`` or
``revisit``.  Records are written by Spark's text writer, whose record separator is the WARC one
(CR LF CR LF), so that a lost task is redone under Spark's commit protocol.  The reader
walks a file by the declared lengths and compares every payload with its digest.

Defined results: a null payload is empty; a record with a null identifier is always a response and never an original;
records that repeat identifier and payload are written alike; control characters
in a URL are percent-encoded, a null URL leaves the header out; further columns are ignored; an empty
table gives an empty archive.
"""

from __future__ import annotations

import hashlib
import zlib
from base64 import b32encode
from collections.abc import Iterator
from datetime import datetime, timezone

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodefield.llm.common import new_folder, table

_END = "\r\n"
_URN = "urn:x-page:"
# The digits that conv() writes in base 32, and those of RFC 4648.
_CONV_DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUV"
_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_READ_BYTES = 4_000_000


def sha1_base32(text: Column) -> Column:
    """Upper-case base32 of the SHA-1 of the UTF-8 bytes: each ten hex digits give eight base32 digits."""
    digest = F.sha1(text)
    parts = [F.lpad(F.conv(F.substring(digest, at, 10), 16, 32), 8, "0") for at in (1, 11, 21, 31)]
    return F.translate(F.concat(*parts), _CONV_DIGITS, _BASE32)


def _safe_url(url: Column) -> Column:
    """URLs hold no spaces or control characters; those found are percent-encoded."""
    plain = ~url.rlike(r"[\x00-\x20\x7F]")
    return F.when(plain, url).otherwise(F.replace(F.url_encode(url), F.lit("+"), F.lit("%20")))


def resolve(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_bytes: int = 0) -> DataFrame:
    """``page_id, url, payload, payload_bytes, payload_digest, record_type, refers_to, refers_to_url`` per page."""
    payload = F.coalesce(F.col(payload_col).cast("string"), F.lit(""))
    records = pages.select(
        F.col(id_col).alias("page_id"), _safe_url(F.col(url_col)).alias("url"), payload.alias("payload"),
        F.octet_length(payload).cast("bigint").alias("payload_bytes"), sha1_base32(payload).alias("payload_digest"))
    headers = records.filter((F.col("payload_bytes") >= min_bytes) & F.col("page_id").isNotNull())
    originals = (
        headers.groupBy("payload_digest")
        .agg(F.min(F.struct("page_id", "url")).alias("first"), F.count(F.lit(1)).alias("n"))
        .filter("n > 1")
        .select("payload_digest", F.col("first.page_id").alias("first_id"), F.col("first.url").alias("first_url"))
    )
    again = (F.col("page_id") > F.col("first_id")) & (F.col("payload_bytes") >= min_bytes)
    return (
        records.join(originals, "payload_digest", "left")
        .withColumn("record_type", F.when(again, "revisit").otherwise("response"))
        .withColumn("refers_to", F.when(again, F.col("first_id")))
        .withColumn("refers_to_url", F.when(again, F.col("first_url")))
        .drop("first_id", "first_url")
    )


def _field(name: str, value: Column) -> Column:
    """A header line, or nothing for a null value."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit(_END)), F.lit(""))


def write_archives(resolved: DataFrame, folder: str, date: datetime | None = None, records_per_file: int = 10_000) -> None:
    """Write the records of ``resolve`` as gzipped WARC 1.1 files with headers made anew."""
    stamp = (date or datetime.now(timezone.utc)).strftime("%Y-%m-%dT%H:%M:%SZ")
    revisit = F.col("record_type") == "revisit"
    http = F.concat(
        F.lit(f"HTTP/1.1 200 OK{_END}Content-Type: text/html; charset=utf-8{_END}Content-Length: "),
        F.col("payload_bytes").cast("string"), F.lit(_END + _END))
    body = F.when(revisit, "").otherwise(F.col("payload"))
    record = F.concat(
        F.lit(f"WARC/1.1{_END}"),
        _field("WARC-Type", F.col("record_type")),
        F.lit(f"WARC-Record-ID: <{_URN}"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(f">{_END}"),
        F.lit(f"WARC-Date: {stamp}{_END}"),
        _field("WARC-Target-URI", F.col("url")),
        _field("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        F.when(revisit, f"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest{_END}").otherwise(""),
        _field("WARC-Refers-To", F.concat(F.lit(f"<{_URN}"), F.col("refers_to").cast("string"), F.lit(">"))),
        _field("WARC-Refers-To-Target-URI", F.col("refers_to_url")),
        F.lit(f"Content-Type: application/http;msgtype=response{_END}"),
        _field("Content-Length", F.octet_length(http) + F.octet_length(body)),
        F.lit(_END), http, body)
    (
        resolved.select(record.alias("value")).write.option("lineSep", _END + _END)
        .option("compression", "gzip").option("maxRecordsPerFile", records_per_file).text(folder)
    )


def _stream(raw: bytes) -> Iterator[bytes]:
    """The unpacked bytes of a gzip file of any number of members, in pieces."""
    view = memoryview(raw)
    while len(view):
        unpack = zlib.decompressobj(31)
        while not unpack.eof:
            piece = unpack.decompress(view, _READ_BYTES)
            view = memoryview(unpack.unconsumed_tail) if not unpack.eof else memoryview(unpack.unused_data)
            if piece:
                yield piece
            elif not unpack.eof and not len(view):
                raise ValueError("the archive ends inside a gzip member")


def records_of(raw: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields (names in lower case) and block of each record of a gzipped WARC file."""
    held, pieces = b"", _stream(raw)

    def need(n: int) -> bool:
        nonlocal held
        while len(held) < n:
            more = next(pieces, None)
            if more is None:
                return False
            held += more
        return True

    while need(1):
        size = 1024
        while (end := held.find(b"\r\n\r\n")) < 0:
            if not need(size := max(size * 2, len(held) + 1)) and held.find(b"\r\n\r\n") < 0:
                raise ValueError("the archive ends inside a header")
        version, *lines = held[:end].decode("utf-8").split("\r\n")
        if not version.startswith("WARC/"):
            raise ValueError(f"not a WARC record: {version[:40]!r}")
        fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}
        stop = end + 4 + int(fields["content-length"])
        if not need(stop + 4) or held[stop : stop + 4] != b"\r\n\r\n":
            raise ValueError("a record does not end where its header says")
        yield fields, held[end + 4 : stop]
        held = held[stop + 4 :]


def _page(uri: str | None) -> int | None:
    number = (uri or "").strip("<>").removeprefix(_URN)
    return int(number) if number else None


def _read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]

    def frame(rows: list[tuple]) -> pd.DataFrame:
        # Typed from the start: a null would turn a column of numbers into doubles.
        kinds = dict.fromkeys(names, object) | {"page_id": "Int64", "refers_to": "Int64", "payload_bytes": "int64"}
        return pd.DataFrame({name: pd.Series(values, dtype=kinds[name]) for name, values in zip(names, zip(*rows))})

    for batch in batches:
        for raw in batch["content"]:
            rows, size = [], 0
            for fields, block in records_of(raw):
                head, _, payload = block.partition(b"\r\n\r\n")
                http = {k.strip().lower(): v.strip() for k, _, v in (x.partition(b":") for x in head.split(b"\r\n")[1:])}
                digest = fields["warc-payload-digest"].removeprefix("sha1:")
                revisit = fields["warc-type"] == "revisit"
                if not revisit and b32encode(hashlib.sha1(payload).digest()).decode() != digest:
                    raise ValueError(f"the payload of {fields['warc-record-id']} does not have its digest")
                rows.append((
                    _page(fields["warc-record-id"]), fields.get("warc-target-uri"), int(http[b"content-length"]), digest,
                    fields["warc-type"], _page(fields.get("warc-refers-to")), None if revisit else payload))
                size += len(payload)
                if len(rows) >= 2_000 or size >= _READ_BYTES:
                    yield frame(rows)
                    rows, size = [], 0
            if rows:
                yield frame(rows)


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """A row per record: ``page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload``."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(folder).select("content")
    return files.mapInPandas(
        _read, "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, payload binary")


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archives written from ``pages`` and read back: ``page_id, payload_bytes, payload_digest, record_type, refers_to``."""
    folder = new_folder(spark, "warc")
    write_archives(resolve(table(spark, sf_dir, "pages").select("page_id", "url", "html")), folder)
    return read_archives(spark, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP3_SQL = """
with p as (select page_id, coalesce(html, '') as t, sha1(coalesce(html, '')) as h from pages),
f as (select *, min(page_id) over (partition by h) as first_id from p)
select page_id, strlen(t)::bigint as payload_bytes,
       list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
           1 + (((('0x' || substr(h, (5 * i // 4 + 1)::bigint, 2))::int >> (3 - (5 * i) % 4)::int) & 31)), 1)), 'string_agg', '') as payload_digest,
       case when page_id > first_id then 'revisit' else 'response' end as record_type,
       case when page_id > first_id then first_id end as refers_to
from f
"""
