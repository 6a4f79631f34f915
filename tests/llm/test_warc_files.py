"""Records through WARC files: byte for byte, and with payloads that look like records."""

import hashlib

import pytest
from pyspark.sql import functions as F

from brindle.llm import warc

LONG = "<p>" + "é" * 80


def test_files_hold_the_records(spark, tmp_path):
    rows = [(1, "u", LONG), (2, None, LONG), (3, "v", ""), (4, "w", None), (None, "x", LONG), (None, "y", "z" * 300), (7, "u", "a\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\n" * 9)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    warc.write_archive(pages, str(tmp_path / "a"))
    records = warc.read_archive(spark, str(tmp_path / "a"))
    warc.export_warc(records, str(tmp_path / "w"))
    got = warc.import_warc(spark, str(tmp_path / "w")).collect()
    whole = {bytes(r.record) for r in warc.record_bytes(records).collect()}
    assert {r.header.encode() + bytes(r.block) + b"\r\n\r\n" for r in got} == whole and len(got) == len(rows)
    for r in got:
        if "WARC-Type: revisit" in r.header:
            assert "\r\nContent-Length: 0\r\n" in r.header and not r.block and "WARC-Refers-To: <urn:brindle:page:1>" in r.header
        else:
            assert f"sha256:{r.payload_digest}\r\n" in r.header and r.payload_digest == hashlib.sha256(bytes(r.block)).hexdigest()
    ids = [x for r in got for x in r.header.split("\r\n") if x.startswith("WARC-Record-ID")]
    assert len(set(ids)) == len(rows)


def test_a_wrong_length_is_found(spark, tmp_path):
    warc.write_archive(spark.createDataFrame([(1, "u", LONG)], "page_id long, url string, html string"), str(tmp_path / "a"))
    short = warc.read_archive(spark, str(tmp_path / "a")).withColumn("header", F.regexp_replace("header", "Content-Length: .*", "Content-Length: 7"))
    with pytest.raises(Exception, match="doesn't match"):
        warc.parsed(short).collect()
