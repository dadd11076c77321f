"""Archives of others: ids as text, several records a member, corrupt stretches, long payloads."""

from __future__ import annotations

import hashlib

import pytest
from pyspark.sql import functions as F

from driftline.llm import warc
from driftline.llm.common import scratch_path


def foreign(i, body, kind="resource"):
    head = f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <urn:uuid:0000-{i}>\r\nContent-Type: text/plain\r\nContent-Length: {len(body)}\r\n\r\n"
    return head.encode() + body + b"\r\n\r\n"


def archive(spark, data):
    path = scratch_path(spark, "foreign").removeprefix("file:") + ".warc.gz"
    __import__("os").makedirs(path.rpartition("/")[0], exist_ok=True)
    with open(path, "wb") as f:
        f.write(data)
    return spark.createDataFrame([("file://" + path, len(data))], "path string, bytes long")


def test_foreign_ids_members_of_several_records_and_payloads(spark):
    bodies = [b"one", b"two\r\n\r\nhalves", b"", b"x" * 500_000]
    members = [warc.member(foreign(0, bodies[0]) + foreign(1, bodies[1])), warc.member(foreign(2, bodies[2])), warc.member(foreign(3, bodies[3]))]
    files = archive(spark, b"".join(members))
    for split in (50, 1000, 1 << 20):
        got = sorted(warc.read_warc(files, split=split, payloads=True, most=1000).collect(), key=lambda r: (r["offset"], r["part"]))
        assert [r["record_id"] for r in got] == [f"urn:uuid:0000-{i}" for i in range(4)]
        assert [r["part"] for r in got] == [0, 1, 0, 0] and got[0]["offset"] == got[1]["offset"] == 0
        assert [r["payload_digest"] for r in got] == [hashlib.sha256(b).hexdigest() for b in bodies]
        assert [r["payload_bytes"] for r in got] == list(map(len, bodies))
        assert [r["payload"] for r in got] == [*bodies[:3], None]


@pytest.mark.parametrize("split", [40, 700, 1 << 20])
def test_a_flipped_byte_is_told(spark, split):
    members = [warc.member(foreign(i, bytes(range(256)) * 3)) for i in range(5)]
    data = bytearray(b"".join(members))
    at = len(members[0]) + len(members[1])
    data[at + 30] ^= 0xFF
    files = archive(spark, bytes(data))
    got = warc.read_warc(files, split=split, errors="report").collect()
    assert sorted(r["record_id"][-1] for r in got if r["record_type"] != "corrupt") == ["0", "1", "3", "4"]
    assert [r["offset"] for r in got if r["record_type"] == "corrupt"] == [at]
    with pytest.raises(Exception, match="at byte"):
        warc.read_warc(files, split=split).collect()


def test_a_cut_archive_is_told(spark):
    data = b"".join(warc.member(foreign(i, b"body" * 100)) for i in range(3))
    got = warc.read_warc(archive(spark, data[:-5]), errors="report").collect()
    assert [r["record_type"] for r in got].count("corrupt") == 1 and len(got) == 3


def test_pages_with_clashing_columns_and_repeated_rows(spark):
    rows = [(1, "u", "p" * 200, "a"), (1, "u", "p" * 200, "a"), (2, "u", "p" * 200, "b"), (None, None, None, None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, digest string").withColumn("first", F.lit("clash"))
    got = sorted(((r["page_id"] or -1, r["record_type"], r["refers_to"]) for r in warc.warc_digest(df).collect()), key=str)
    assert got == sorted([(1, "response", None), (1, "response", None), (2, "revisit", 1), (-1, "response", None)], key=str)
