"""A content-addressed archive of WARC records.

Payload bytes are stored once per SHA-256 in one table; a second table keeps each
record's exact header block and the digest of its payload. A join of the two gives
back the records byte for byte: a response is its header, its payload as the block, and two
line ends; a revisit has an empty block, and its payload is found by the digest that its header
declares. Reading back parses the bytes of each record by its Content-Length and
digests the payload anew, so a damaged store is found. The same records can be written to and
read from plain WARC files.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm._common import table
from brindle.session import table_path

VERSION, CRLF = "WARC/1.1", "\r\n"
#: Payloads below so many bytes are never made a revisit.
LEAST_REVISIT_BYTES = 100
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: All records of one archive run carry the same date, so that a retried task writes the same bytes.
DATE = "2024-01-01T00:00:00Z"


def _urn(page_id: Column, digest: Column, url: Column | None = None) -> Column:
    """By page_id; without one by the hashes of payload and url."""
    place = F.lit("") if url is None else F.hex(F.xxhash64(url))
    return F.concat(F.lit("<urn:brindle:page:"), F.coalesce(page_id.cast("string"), F.concat(F.lit("none-"), F.substring(digest, 1, 16), F.lit("-"), place)), F.lit(">"))


def _header(kind: Column, page_id: Column, first: Column, url: Column, digest: Column, n: Column) -> Column:
    """The exact header block, up to and with its empty line."""
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))
    clean = F.regexp_replace(url, r"[\r\n]+", " ")  # a header can't hold line ends
    revisit = F.concat(line("WARC-Refers-To", _urn(first, digest)), line("WARC-Profile", F.lit(PROFILE)))
    return F.concat(
        F.lit(f"{VERSION}{CRLF}"),
        line("WARC-Type", kind),
        line("WARC-Record-ID", _urn(page_id, digest, url)),
        line("WARC-Date", F.lit(DATE)),
        F.when(url.isNotNull(), line("WARC-Target-URI", clean)).otherwise(""),
        F.when(kind == "revisit", revisit).otherwise(""),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), digest)),
        line("Content-Type", F.lit("text/html")),
        line("Content-Length", F.when(kind == "revisit", "0").otherwise(n.cast("string"))),
        F.lit(CRLF),
    )


def write_archive(pages: DataFrame, path: str) -> None:
    """Writes ``path/payloads`` (digest, payload) and ``path/records`` (page_id, digest, header).

    A null html is an empty payload, a null url leaves its header line out. Of the
    records with equal payloads of at least LEAST_REVISIT_BYTES bytes those with the
    smallest page_id are responses (all of them, if a row is repeated), others revisits;
    a null page_id counts as larger than any. An empty table gives empty tables. Other
    columns, whatever their names, are ignored.
    """
    raw = pages.select("page_id", "url", F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload"))
    raw = raw.select("page_id", "url", "payload", F.sha2("payload", 256).alias("digest"), F.octet_length("payload").cast("long").alias("n"))
    firsts = raw.groupBy("digest").agg(F.min("page_id").alias("first"))
    records = raw.select("page_id", "url", "digest", "n").join(firsts, "digest")
    kind = F.when((F.col("n") < LEAST_REVISIT_BYTES) | F.col("page_id").eqNullSafe(F.col("first")), F.lit("response")).otherwise(F.lit("revisit"))
    header = _header(kind, F.col("page_id"), F.col("first"), F.col("url"), F.col("digest"), F.col("n"))
    records.select("page_id", "digest", header.alias("header")).write.option("compression", "zstd").parquet(f"{path}/records")
    # copies meet only after each task has dropped its own, so a hot payload is sent once per task; those that meet are compared by a second hash
    other = F.xxhash64("payload")
    stored = raw.select("digest", "payload", other.alias("a"), other.alias("z")).groupBy("digest").agg(F.any_value("payload").alias("payload"), F.min("a").alias("a"), F.max("z").alias("z"))
    same = F.when(F.col("a") == F.col("z"), F.col("payload")).otherwise(F.raise_error(F.concat(F.lit("different payloads of digest "), "digest")).cast("binary"))
    stored.select("digest", same.alias("payload")).write.option("compression", "zstd").parquet(f"{path}/payloads")


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """page_id, header and payload of every record, by joining both tables; a revisit's payload is that of its response."""
    records, payloads = spark.read.parquet(f"{path}/records"), spark.read.parquet(f"{path}/payloads")
    return records.join(payloads, "digest").select("page_id", "header", "payload")


def _record(header: Column, payload: Column) -> Column:
    block = F.when(F.contains(header, F.lit("\nWARC-Type: revisit\r\n")), F.lit(b"")).otherwise(payload)
    return F.concat(header.cast("binary"), block, F.lit(f"{CRLF}{CRLF}").cast("binary"))


def record_bytes(records: DataFrame) -> DataFrame:
    """page_id and the whole record as it stands in a WARC file."""
    return records.select("page_id", _record(F.col("header"), F.col("payload")).alias("record"))


def export_warc(records: DataFrame, path: str) -> None:
    """Plain .warc text files; each record ends with two line ends, one of them the writer's."""
    body = F.expr("substring(record, 1, octet_length(record) - 2)").cast("string")
    record_bytes(records).select(body.alias("value")).write.option("lineSep", CRLF).text(path)


def import_warc(spark: SparkSession, path: str) -> DataFrame:
    """(header, block, payload_digest) of the records of .warc files, read one after the other by their Content-Length; a file is one row, so it should be of moderate size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for value in batch.column(0):
                data, at, rows = value.as_buffer().to_pybytes(), 0, []
                while at < len(data):
                    end = data.index(b"\r\n\r\n", at) + 4
                    header = data[at:end]
                    stop = end + int(re.search(rb"\nContent-Length: (\d+)\r\n", header)[1])
                    if not header.startswith(VERSION.encode()) or data[stop : stop + 4] != b"\r\n\r\n":
                        raise ValueError(f"no record at byte {at}")
                    rows.append((header.decode(), data[end:stop], hashlib.sha256(data[end:stop]).hexdigest()))
                    at = stop + 4
                header, block, digest = zip(*rows, strict=True) if rows else ((), (), ())
                yield pa.RecordBatch.from_arrays([pa.array(header, pa.string()), pa.array(block, pa.binary()), pa.array(digest, pa.string())], ["header", "block", "payload_digest"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "part-*").load(path)
    return files.select("content").mapInArrow(run, "header string, block binary, payload_digest string")


def parsed(records: DataFrame) -> DataFrame:
    """Header fields and payload facts of records, parsed from their bytes; a block or payload that doesn't match its header is an error."""
    whole = records.select("page_id", "payload", _record(F.col("header"), F.col("payload")).alias("record"))
    whole = whole.withColumn("head", F.substring_index(F.col("record").cast("string"), f"{CRLF}{CRLF}", 1))
    field = lambda name: F.nullif(F.regexp_extract("head", rf"\n{name}: ([^\r\n]*)", 1), F.lit(""))
    number = lambda value: F.regexp_extract(value, r":page:(-?\d+)>$", 1)
    facts = whole.select(
        "page_id", "payload", "record",
        (F.octet_length("head") + 4).alias("at"),
        field("WARC-Type").alias("record_type"),
        F.nullif(number(field("WARC-Refers-To")), F.lit("")).cast("long").alias("refers_to"),
        F.regexp_replace(field("WARC-Payload-Digest"), "^sha256:", "").alias("declared"),
        field("Content-Length").cast("int").alias("length"),
    )
    block = F.expr("substring(record, at + 1, length)")
    ended = F.expr("substring(record, at + length + 1)") == F.lit(b"\r\n\r\n")
    body = F.when(F.col("record_type") == "revisit", F.col("payload")).otherwise(block)
    facts = facts.select("page_id", "record_type", "refers_to", "declared", ended.alias("ended"), F.octet_length(body).cast("long").alias("payload_bytes"), F.sha2(body, 256).alias("payload_digest"))
    checked = F.when((F.col("declared") == F.col("payload_digest")) & F.col("ended"), F.col("payload_digest")).otherwise(F.raise_error(F.concat(F.lit("payload doesn't match the header of page "), F.coalesce(F.col("page_id").cast("string"), F.lit("null")))))
    return facts.withColumn("payload_digest", checked).drop("ended", "declared")


def op10_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written to an archive and parsed from its records; odd rows and empty tables as in write_archive()."""
    path = table_path(spark, "warc")
    write_archive(table(spark, sf_dir, "pages"), path)
    return parsed(read_archive(spark, path)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP10_SQL = f"""
SELECT page_id, n AS payload_bytes, digest AS payload_digest,
       CASE WHEN n < {LEAST_REVISIT_BYTES} OR page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN n < {LEAST_REVISIT_BYTES} OR page_id = first THEN NULL ELSE first END AS refers_to
FROM (SELECT page_id, strlen(coalesce(html, '')) AS n, sha256(coalesce(html, '')) AS digest,
             min(page_id) OVER (PARTITION BY sha256(coalesce(html, ''))) AS first
      FROM pages)
"""
