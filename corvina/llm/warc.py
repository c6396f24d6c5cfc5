"""A content-addressed archive of web records.

Payload bytes are stored once, by SHA-256 and length, compressed one by one, and checked again when they are read. The exact header block of each record is kept apart, with the digest that it names. Records are put together again through a join by digest: a `response` record is its header, an HTTP response with the payload, and the closing lines; a `revisit` has the HTTP header only, so payloads move once for each distinct one, however many pages share it. Where pages share a digest, what is joined to them has no payload and comes in SALTS parts.

Defined cases: a null payload is empty; payloads of any length are stored and put together whole; a null page_id comes after all others; of rows with equal payload and page_id, that with the smaller url (null last) is the response, rows equal in all three are one record repeated; other columns are ignored; an empty table gives an empty archive.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from ._common import bounded_batches, shared_dir, table

#: Records date from here: the input has no time.
DATE = "2024-01-01T00:00:00Z"
DIGITS, LETTERS = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
KEY = ["sha256", "n_bytes"]
#: Parts in which a digest is joined to the pages that share it.
SALTS = 16
#: Bytes below which payloads may, on demand, be in many response records.
SMALL = 4096
HEADERS, PAYLOADS = "sha256 string, n_bytes long, salt int, header string", "sha256 string, n_bytes long, digest string, lead struct<no_page:boolean,page_id:bigint,no_url:boolean,url:string>, shared boolean, payload binary"


@F.arrow_udf(BinaryType())
def _squeezed(payload: pa.Array) -> pa.Array:
    codec = pa.Codec("zstd", 3)
    return pa.array([codec.compress(x.as_buffer(), asbytes=True) for x in payload], pa.binary())


@F.arrow_udf(BinaryType())
def _restored(payload: pa.Array, n_bytes: pa.Array) -> pa.Array:
    codec = pa.Codec("zstd")
    return pa.array([None if x.as_py() is None else codec.decompress(x.as_buffer(), n.as_py(), asbytes=True) if n.as_py() else b"" for x, n in zip(payload, n_bytes, strict=True)], pa.binary())


def base32_sha1(payload: Column) -> Column:
    """The SHA-1 of bytes in upper-case base 32: 5 hexadecimal digits make 4 letters."""
    hex_ = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(hex_, 1 + 5 * k, 5), 16, 32), 4, "0") for k in range(8)]
    return F.translate(F.concat(*parts), DIGITS, LETTERS)


def _record_id(page: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page.cast("string"), F.lit("none")), F.lit(">"))


def _http(n_bytes: Column) -> Column:
    """The head of the HTTP response that holds a payload."""
    return F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), n_bytes.cast("string"), F.lit("\r\n\r\n"))


def _salt(among: Column) -> Column:
    return F.pmod(F.xxhash64(among), F.lit(SALTS)).cast("int")


def write(pages: DataFrame, folder: str, page: str = "page_id", url: str = "url", payload: str = "html", least: int = 0) -> None:
    """Writes folder/payloads and folder/headers. Records whose payload has fewer than `least` bytes (SMALL at most) are never revisits."""
    if least > SMALL:
        raise ValueError(f"`least` may be {SMALL} at most")
    bounded_batches(pages.sparkSession)
    rows = pages.select(F.col(f"`{page}`").cast("long").alias("page_id"), F.col(f"`{url}`").cast("string").alias("url"), F.coalesce(F.col(f"`{payload}`").cast("string"), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumns({"sha256": F.sha2("payload", 256), "n_bytes": F.octet_length("payload").cast("long"), "digest": base32_sha1(F.col("payload"))})
    first = F.struct(F.col("page_id").isNull().alias("no_page"), "page_id", F.col("url").isNull().alias("no_url"), "url")
    squeezed = rows.withColumn("payload", _squeezed("payload"))
    stored = squeezed.groupBy(*KEY).agg(F.first("digest").alias("digest"), F.min(first).alias("lead"), (F.col("n_bytes") < least).alias("shared"), F.first("payload").alias("payload"))
    stored.write.parquet(f"{folder}/payloads")
    leads = pages.sparkSession.read.schema(PAYLOADS).parquet(f"{folder}/payloads").select(*KEY, "digest", "lead").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    records = rows.select("page_id", "url", *KEY, _salt(F.concat_ws(" ", "page_id", "url")).alias("salt")).join(leads, [*KEY, "salt"])
    response = (F.col("n_bytes") < least) | (F.col("page_id").eqNullSafe(F.col("lead.page_id")) & F.col("url").eqNullSafe(F.col("lead.url")))
    head = F.octet_length(_http(F.col("n_bytes")))
    lines = [
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.when(response, "response").otherwise("revisit")),
        F.concat(F.lit("WARC-Record-ID: "), _record_id(F.col("page_id"))),
        F.lit(f"WARC-Date: {DATE}"),
        F.concat(F.lit("WARC-Target-URI: "), F.regexp_replace(F.coalesce("url", F.lit("")), "[\\r\\n]", " ")),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("digest")),
        F.when(~response, F.concat(F.lit("WARC-Refers-To: "), _record_id(F.col("lead.page_id")))),
        F.when(~response, F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        F.lit("Content-Type: application/http; msgtype=response"),
        F.concat(F.lit("Content-Length: "), F.when(response, head + F.col("n_bytes")).otherwise(head).cast("string")),
    ]
    # concat_ws leaves out the lines that are null
    header = F.concat(F.concat_ws("\r\n", *lines), F.lit("\r\n\r\n"))
    records.select(*KEY, F.when(F.col("n_bytes") < least, F.col("salt")).otherwise(0).alias("salt"), header.alias("header")).write.parquet(f"{folder}/headers")


def _field(name: str) -> Column:
    return F.regexp_extract("header", f"\\r\\n{name}: ([^\\r]*)\\r", 1)


def _parsed(records: DataFrame) -> DataFrame:
    number = lambda name: F.try_to_number(F.nullif(F.regexp_extract(_field(name), "^<urn:page:(-?[0-9]+)>$", 1), F.lit("")), F.lit("S9999999999999999999")).cast("long")
    return records.withColumns({"page_id": number("WARC-Record-ID"), "record_type": _field("WARC-Type"), "named_digest": F.regexp_replace(_field("WARC-Payload-Digest"), "^sha1:", ""), "refers_to": number("WARC-Refers-To")})


def records(spark: SparkSession, folder: str) -> DataFrame:
    """(page_id, record_type, refers_to, header, http, record): the exact bytes of each record, put together from its header and, for a response, its payload."""
    bounded_batches(spark)
    headers = _parsed(spark.read.schema(HEADERS).parquet(f"{folder}/headers"))
    # only responses take a payload: one for each, but for short ones that are never revisited, which come in parts
    responses = headers.where("record_type = 'response'")
    parts = F.when(F.col("shared"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    stored = spark.read.schema(PAYLOADS).parquet(f"{folder}/payloads").select(*KEY, "payload", F.explode(parts).alias("salt"))
    joined = responses.join(stored, [*KEY, "salt"]).drop("salt").withColumn("payload", _restored("payload", "n_bytes"))
    ok = (F.sha2("payload", 256) == F.col("sha256")) & (F.octet_length("payload") == F.col("n_bytes"))
    joined = joined.withColumn("payload", F.when(ok, F.col("payload")).otherwise(F.raise_error(F.lit("a stored payload is damaged")).cast("binary")))
    every = joined.unionByName(headers.drop("salt").where("record_type = 'revisit'").withColumn("payload", F.lit(None).cast("binary")))
    every = every.withColumn("http", _http(F.col("n_bytes")))
    record = F.concat(F.col("header").cast("binary"), F.col("http").cast("binary"), F.coalesce("payload", F.lit(b"")), F.lit(b"\r\n\r\n"))
    return every.select("page_id", "record_type", "refers_to", "named_digest", "n_bytes", F.octet_length("header").alias("header_bytes"), F.octet_length("http").alias("http_bytes"), record.alias("record"))


def digests(spark: SparkSession, folder: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to), taken from the records: of a response from the payload within it, of a revisit from its header."""
    rows = records(spark, folder)
    before = F.col("header_bytes") + F.col("http_bytes")
    response = F.col("record_type") == "response"
    body = F.substring(F.col("record"), before + 1, F.octet_length("record") - before - 4)
    rows = rows.select("page_id", "record_type", "refers_to", "named_digest", F.when(response, F.octet_length("record") - before - 4).otherwise(F.col("n_bytes")).cast("long").alias("payload_bytes"), F.when(response, base32_sha1(body)).otherwise(F.col("named_digest")).alias("payload_digest"))
    right = F.when(F.col("payload_digest") == F.col("named_digest"), F.col("payload_digest")).otherwise(F.raise_error(F.lit("a header names another digest")))
    return rows.select("page_id", "payload_bytes", right.alias("payload_digest"), "record_type", "refers_to")


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_dir(spark, "warc")
    write(table(spark, sf_dir, "pages"), folder)
    return digests(spark, folder)


OP8_SQL = f"""
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex FROM pages
), k AS (
  SELECT page_id, strlen(html) AS n, min(page_id) OVER (PARTITION BY html) AS lead,
         array_to_string(list_transform(range(0, 32), lambda i: substr('{LETTERS}', 1 + CAST(
           (CAST('0x' || substr(hex, CAST(1 + 5 * (i // 4) AS BIGINT), 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS INTEGER)) & 31 AS BIGINT), 1)), '') AS digest
  FROM p
)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest,
       CASE WHEN page_id = lead THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> lead THEN lead END AS refers_to
FROM k
"""
