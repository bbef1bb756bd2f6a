"""A content-addressed WARC archive.

Payload bytes are stored once under their SHA-256; the exact head of each record (WARC header block and, with it, the
HTTP header of its block) is stored by itself. Reading verifies that each stored payload still has the digest it is
stored under and the one its records name; joins put the original records together again.

``<path>/payloads`` (sha256, payload) and ``<path>/heads`` (sha256, head) are Parquet tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, cut

MIN_BYTES = 0
#: The base32 alphabet, line end, and names of the WARC format.
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
CRLF = "\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Records carry one date, so that equal inputs make equal archives.
DATE = "2024-01-01T00:00:00Z"


def base32_sha1(payload: Column) -> Column:
    """Bare upper-case base32 of the SHA-1: 40 hex digits are 8 groups of 20 bits, of 4 letters each."""
    hexed, letters = F.sha1(payload), []
    for i in range(8):
        group = F.conv(F.substring(hexed, 5 * i + 1, 5), 16, 10).cast("int")
        letters += [F.substr(F.lit(BASE32), F.shiftright(group, s).bitwiseAND(31) + 1, F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(*letters)


def _record_id(page: Column) -> Column:
    return F.concat(F.lit("<urn:x-page:"), F.coalesce(page.cast("string"), F.lit("none")), F.lit(">"))


def _one_line(url: Column) -> Column:
    return F.regexp_replace(F.coalesce(url, F.lit("")), r"[\x00-\x20\x7F]+", "%20")


def heads(records: DataFrame) -> Column:
    """The bytes before the payload, from page_id, url, length, digest, record_type and refers_to."""
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("length").cast("string"), F.lit(2 * CRLF))
    is_response = F.col("record_type") == "response"
    block = F.octet_length(http) + F.when(is_response, F.col("length")).otherwise(0)
    revisit = F.concat(F.lit(f"WARC-Profile: {PROFILE}{CRLF}WARC-Refers-To: "), _record_id(F.col("refers_to")), F.lit(CRLF))
    return F.concat(
        F.lit(f"WARC/1.1{CRLF}WARC-Type: "), F.col("record_type"), F.lit(f"{CRLF}WARC-Record-ID: "), _record_id(F.col("page_id")),
        F.lit(f"{CRLF}WARC-Date: {DATE}{CRLF}WARC-Target-URI: "), _one_line(F.col("url")), F.lit(f"{CRLF}WARC-Payload-Digest: sha1:"), F.col("digest"), F.lit(CRLF),
        F.when(is_response, F.lit("")).otherwise(revisit), F.lit(f"Content-Type: application/http; msgtype=response{CRLF}Content-Length: "), block.cast("string"),
        F.lit(2 * CRLF), http,
    ).cast("binary")


def write_archive(pages: DataFrame, path: str, min_bytes: int = MIN_BYTES) -> None:
    """An archive of one record for each row of pages (page_id, url, html) in a new folder.

    The payload is html in UTF-8 (null: empty). Of records with equal payloads of min_bytes or more, that with the
    largest page_id is a response (if rows repeat that id, each of them is) and the others revisit it; a null id is the
    smallest. Smaller payloads are all responses. Null urls are empty; other columns are ignored.
    """
    payload = F.coalesce("html", F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", payload.alias("payload"), F.sha2(payload, 256).alias("sha256"))
    once = rows.groupBy("sha256").agg(F.first("payload").alias("payload"))
    once.write.option("compression", "zstd").parquet(f"{path}/payloads")
    facts = rows.select("page_id", "url", "sha256", F.octet_length("payload").cast("long").alias("length"), base32_sha1(F.col("payload")).alias("digest"))
    owners = facts.select("sha256", "page_id").groupBy("sha256").agg(F.max("page_id").alias("owner"))
    typed = facts.join(owners, "sha256")
    answers = (F.col("length") < min_bytes) | F.col("page_id").eqNullSafe(F.col("owner"))
    typed = typed.withColumn("record_type", F.when(answers, "response").otherwise("revisit")).withColumn("refers_to", F.when(~answers, F.col("owner")))
    typed.select("sha256", heads(typed).alias("head")).write.option("compression", "zstd").parquet(f"{path}/heads")


def payloads(spark: SparkSession, path: str) -> DataFrame:
    """sha256, payload, payload_bytes, payload_digest; reading fails at a payload that isn't what it is stored under."""
    stored = spark.read.parquet(f"{path}/payloads")
    sound = F.when(F.sha2("payload", 256) == F.col("sha256"), F.col("payload")).otherwise(F.raise_error(F.concat(F.lit("damaged payload "), F.col("sha256"))).cast("binary"))
    stored = stored.select("sha256", sound.alias("payload"))
    return stored.select("sha256", "payload", F.octet_length("payload").cast("long").alias("payload_bytes"), base32_sha1(F.col("payload")).alias("payload_digest"))


def _field(name: str, pattern: str = "([^\r]*)") -> Column:
    found = F.regexp_extract(F.col("head").cast("string"), rf"\r\n{name}: {pattern}\r\n", 1)
    return F.when(found != "", found)


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, url of each record, with sha256, head and payload.

    A record whose payload is missing, or has another digest than its head names, stops the reading.
    """
    page = "<urn:x-page:(-?[0-9]+)>"
    named = spark.read.parquet(f"{path}/heads").select(
        "sha256", "head", _field("WARC-Record-ID", page).cast("long").alias("page_id"), _field("WARC-Type").alias("record_type"),
        _field("WARC-Refers-To", page).cast("long").alias("refers_to"), _field("WARC-Target-URI").alias("url"), _field("WARC-Payload-Digest", "sha1:([A-Z2-7]{32})").alias("named"),
    )
    joined = named.join(payloads(spark, path), "sha256", "left")
    wrong = F.raise_error(F.concat(F.lit("no sound payload for "), F.col("sha256"))).cast("string")
    digest = F.when(F.col("payload_digest") == F.col("named"), F.col("payload_digest")).otherwise(wrong)
    return joined.select("page_id", "payload_bytes", digest.alias("payload_digest"), "record_type", "refers_to", "url", "sha256", "head", "payload")


def records(spark: SparkSession, path: str) -> DataFrame:
    """page_id and the bytes of each original record: head, payload (of responses), and two line ends."""
    whole = read_archive(spark, path)
    body = F.when(F.col("record_type") == "response", F.col("payload")).otherwise(F.lit(b""))
    return whole.select("page_id", F.concat("head", body, F.lit((2 * CRLF).encode())).alias("record"))


def archived(pages: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, as read back from an archive of pages."""
    spark = pages.sparkSession
    with Scratch(spark) as scratch:
        write_archive(pages, scratch.root, min_bytes)
        return cut(read_archive(spark, scratch.root).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"))
