"""Operator 5: a content-addressed web archive.

Two tables stand for the archive. ``payloads`` holds each distinct payload once, under its
SHA-256; ``records`` holds one row a WARC record with its exact header and HTTP head, which name the
payload's SHA-1 as WARC does. Whole records come back by joining the two: a response is its header, head and
payload, a revisit its header and head, and its payload that of the record it refers to. On reading, payloads
are digested anew; one that doesn't answer to its address, or a record whose length or digest isn't what
its header says, stops the job.

Of records with equal payloads of at least ``min_bytes``, the one with the largest id is the
response and the others are revisits that refer to it; below that all are responses.

A url goes into the header with line breaks and other control characters as %XX. Where that changes it, or it is null or
has blanks at its ends, a field of our own holds it exactly, in base 64, and reading gives it back as it was.

Cases: null html is an empty payload. Repeated rows are records of their own, each with its own record id; of equal
largest ids one is the response that others refer to, and all of them are responses. Null ids are never referred to. Very long payloads are
taken whole. An empty table writes empty archives. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import cut, discard, fresh_path, table, with_mark

_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
CRLF = "\r\n"
VERSION = "WARC/1.1"
#: A page table has no time of capture; where none is given, this is written.
NO_DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_of_hex(digest: Column) -> Column:
    """Of a SHA-1 in hex: 15 hex digits are 12 base-32 ones, which ``conv`` writes as 0-9 and A-V."""
    runs = [F.lpad(F.conv(F.substring(digest, at, n), 16, 32), n * 4 // 5, "0") for at, n in ((1, 15), (16, 15), (31, 10))]
    return F.translate(F.concat(*runs), "0123456789ABCDEFGHIJKLMNOPQRSTUV", _BASE32)


def _uuid(*cols: Column) -> Column:
    """A name-based record id."""
    h = F.md5(F.concat_ws("|", *[F.coalesce(c.cast("string"), F.lit("-")) for c in cols]))
    return F.concat(F.lit("<urn:uuid:"), F.regexp_replace(h, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"), F.lit(">"))


def _field(name: str, value: Column) -> Column:
    """A line of a header, none where the value is null."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit(CRLF)), F.lit(""))


def _http() -> Column:
    """The HTTP head before a payload."""
    return F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("payload_bytes").cast("string"), F.lit(CRLF * 2))


def _header(date: str) -> Column:
    """The exact header block, with the blank line after it."""
    is_revisit = F.col("record_type") == "revisit"
    uri = F.coalesce(F.col("url"), F.lit(""))
    for code in (9, 10, 13):
        uri = F.replace(uri, F.lit(chr(code)), F.lit(f"%{code:02X}"))
    uri = F.regexp_replace(uri, r"[\x00-\x1F\x7F]", "%00")
    exact = F.col("url").isNotNull() & (F.trim(uri) == F.col("url")) & (uri != "")
    held = F.when(exact, None).otherwise(F.coalesce(F.concat(F.lit("="), F.base64(F.encode("url", "utf-8"))), F.lit("-")))
    length = F.octet_length("http") + F.when(is_revisit, 0).otherwise(F.col("payload_bytes"))
    return F.concat(
        F.lit(f"{VERSION}{CRLF}"), _field("WARC-Type", F.col("record_type")), _field("WARC-Record-ID", F.col("record_id")),
        _field("WARC-Date", F.lit(date)), _field("WARC-Target-URI", uri), _field("Page-ID", F.col("page_id").cast("string")), _field("Page-URL-Base64", F.regexp_replace(held, r"\s", "")),
        _field("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        _field("WARC-Profile", F.when(is_revisit, F.lit(PROFILE))), _field("WARC-Refers-To", F.when(is_revisit, F.col("first_record"))), _field("Page-Refers-To", F.when(is_revisit, F.col("refers_to").cast("string"))),
        _field("Content-Type", F.lit("application/http; msgtype=response")), _field("Content-Length", length.cast("string")), F.lit(CRLF),
    )


def write_archive(pages: DataFrame, path: str, min_bytes: int = 0, date: str = NO_DATE) -> None:
    """Write ``path/payloads`` and ``path/records``.

    Types are settled on rows without payloads. Payloads of one row are written where they lie; only those that a bitmap
    can't rule out to be repeated are shuffled by address, and each map task leaves one row an address.
    """
    payload = F.coalesce(F.col("html").cast("binary"), F.lit(b""))
    thin = cut(
        pages.select(
            F.monotonically_increasing_id().alias("row"), F.col("page_id").cast("long").alias("page_id"), "url", F.sha2(payload, 256).alias("address"),
            base32_of_hex(F.sha1(payload)).alias("payload_digest"), F.octet_length(payload).cast("long").alias("payload_bytes"),
        ),
        "pages",
    )
    named = thin.withColumn("record_id", _uuid(F.col("address"), F.col("page_id"), F.col("row")))
    first = cut(named.groupBy("address").agg(F.max(F.struct("page_id", "record_id")).alias("first"), F.count("*").alias("n")).where("n > 1"), "repeated")
    rows = pages.select(payload.alias("payload")).withColumn("address", F.sha2("payload", 256))
    marked = with_mark(rows, "address", first.select("address"))
    alone, again = (marked.where(c).select("address", "payload") for c in ("not _marked", "_marked"))
    alone.unionAll(again.dropDuplicates(["address"])).write.parquet(f"{path}/payloads")

    typed = named.join(first, "address", "left")
    revisit = (F.col("payload_bytes") >= min_bytes) & (F.col("first.page_id").isNotNull()) & ~F.col("page_id").eqNullSafe(F.col("first.page_id"))
    typed = typed.withColumn("record_type", F.when(revisit, "revisit").otherwise("response")).withColumns({"refers_to": F.when(revisit, F.col("first.page_id")), "first_record": F.col("first.record_id"), "http": _http()})
    typed.select("address", _header(date).alias("header"), "http").write.parquet(f"{path}/records")
    discard(thin, first)


def read_payloads(spark: SparkSession, path: str) -> DataFrame:
    """The payloads; the digest is computed from the bytes that were read and must be the address."""
    stored = spark.read.parquet(f"{path}/payloads")
    true = F.sha2("payload", 256) == F.col("address")
    return stored.select(F.when(true, F.col("address")).otherwise(F.raise_error(F.concat(F.lit("corrupt payload "), F.col("address")))).alias("address"), "payload")


def fields_of(header: Column) -> Column:
    """The header's fields as a map; the first line is a key without a value."""
    return F.str_to_map(header.substr(F.lit(1), F.length(header) - 4), F.lit(CRLF), F.lit(": "))


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Every record: ``record``, its exact bytes; its fields, parsed from the header; and its payload.

    A response's payload is cut out of the record's own bytes. The join is on the address, whose hot values Spark's
    adaptive join splits, as records are thin and payloads distinct.
    """
    records = spark.read.parquet(f"{path}/records").withColumn("f", fields_of(F.col("header")))
    joined = records.join(read_payloads(spark, path), "address")
    is_revisit = F.col("f")["WARC-Type"] == "revisit"
    rebuilt = joined.withColumn("record", F.concat(F.col("header").cast("binary"), F.col("http").cast("binary"), F.when(is_revisit, F.lit(b"")).otherwise(F.col("payload")), F.lit((CRLF * 2).encode())))
    own = F.expr("substring(record, octet_length(header) + octet_length(http) + 1, octet_length(record) - octet_length(header) - octet_length(http) - 4)")
    read = rebuilt.select("f", "record", F.when(is_revisit, F.col("payload")).otherwise(own).alias("payload"), (F.octet_length("record") == F.octet_length("header") + F.col("f")["Content-Length"].cast("int") + 4).alias("whole"))
    named = F.substring(F.col("f")["WARC-Payload-Digest"], len("sha1:") + 1, 32)
    right = F.col("whole") & (base32_of_hex(F.sha1("payload")) == named)
    wrong = F.raise_error(F.concat(F.lit("corrupt record "), F.col("f")["WARC-Record-ID"]))
    return read.select(
        F.col("f")["Page-ID"].cast("long").alias("page_id"), _url().alias("url"), F.col("f")["WARC-Type"].alias("record_type"), F.col("f")["Page-Refers-To"].cast("long").alias("refers_to"),
        F.col("f")["WARC-Record-ID"].alias("record_id"), F.when(right, named).otherwise(wrong).alias("payload_digest"), "payload", "record",
    )


def _url() -> Column:
    held = F.col("f")["Page-URL-Base64"]
    return F.when(held.isNull(), F.col("f")["WARC-Target-URI"]).when(held != "-", F.decode(F.unbase64(F.substring(held, 2, 1 << 30)), "utf-8"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "warc")
    write_archive(table(spark, sf_dir, "pages").select("page_id", "url", "html"), path)
    return read_records(spark, path).select("page_id", F.octet_length("payload").cast("long").alias("payload_bytes"), "payload_digest", "record_type", "refers_to")


QUERIES = {"op5_warc": op5_warc}

ORACLE = {
    "op5_warc": """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS h FROM pages
), d AS (
  SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes, sha1(h) AS x, max(page_id) OVER (PARTITION BY h) AS first FROM p
), g AS (
  SELECT *, list_transform(range(0, 8), lambda i: CAST('0x' || substr(x, CAST(i * 5 + 1 AS INTEGER), 5) AS INTEGER)) AS n FROM d
)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(((n[CAST(i // 4 + 1 AS INTEGER)] >> CAST(15 - 5 * (i % 4) AS INTEGER)) & 31) + 1 AS INTEGER), 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to
FROM g
"""
}
