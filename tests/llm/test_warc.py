import gzip
import hashlib
import io

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from capforge.llm import common, warc

BIG = "<p>" + "long é " * 400
ROWS = [(1, "http://a/", "short"), (2, "http://b/", "short"), (3, "u", BIG), (9, "u", BIG), (5, None, BIG), (None, "u", BIG), (9, "u", BIG),
        (6, "x\r\ny", None), (7, "u", ""), (None, "u", BIG + "!"), (None, "u", BIG + "!"), (8, "u", "\x1f\x8b\x08 WARC/1.1\r\n\r\n" * 200), (10, "u", "y" * 999), (11, "u", "y" * 999)]


def pages(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, digest string, first int").coalesce(2)


def expected(rows):
    out = []
    for i, _, h in rows:
        body = (h or "").encode()
        same = [j for j, _, x in rows if (x or "") == (h or "") and j is not None]
        first = max(same, default=None) if len(body) >= 1000 else None
        revisit = first is not None and first != i
        out.append((i, len(body), hashlib.sha1(body).hexdigest(), "revisit" if revisit else "response", first if revisit else None))
    return sorted(out, key=repr)


@pytest.mark.parametrize("size", [64, 1000, 1 << 20])
def test_round_trip_over_any_ranges(spark, size):
    path = common.shared_path(spark, "warc-test")
    warc.write_warc(pages(spark, ROWS), path)
    out = warc.read_warc(spark, path, size).collect()
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in out), key=repr) == expected(ROWS)
    for r in out:
        if r.record_type == "response":
            assert hashlib.sha1(bytes(r.payload)).hexdigest() == r.payload_digest


def test_files_are_plain_gzip_members(spark):
    path = common.shared_path(spark, "warc-test")
    warc.write_warc(pages(spark, ROWS[:3]).coalesce(1), path)
    data = b"".join(bytes(r.content) for r in spark.read.format("binaryFile").load(path).collect())
    whole = gzip.decompress(data)
    assert whole.count(b"WARC/1.1\r\n") == 3 and whole.endswith(b"\r\n\r\n")


def test_empty_table(spark):
    path = common.shared_path(spark, "warc-test")
    warc.write_warc(pages(spark, ROWS).limit(0), path)
    assert warc.read_warc(spark, path).count() == 0


def test_long_record_ends_in_zero():
    data = warc.member(b"x" * (1 << 24)) + b"\0"
    assert gzip.decompress(data) == b"x" * (1 << 24)
    rec = warc.record(1, None, b"z" * (1 << 24), hashlib.sha1(b"z" * (1 << 24)).hexdigest(), None)
    stream = warc.member(rec) + b"\0" + warc.member(warc.record(2, "u", b"q", hashlib.sha1(b"q").hexdigest(), None)) + b"\0"
    assert [warc.parsed(r)[0] for r in warc.records(io.BytesIO(stream), 0, len(stream))] == [1, 2]


@settings(max_examples=40, deadline=None)
@given(st.lists(st.binary(max_size=300), max_size=6), st.lists(st.integers(1, 400), min_size=1, max_size=5))
def test_each_record_has_one_owner(payloads, cuts):
    recs = [warc.record(i, "u", p + warc.MAGIC, hashlib.sha1(p + warc.MAGIC).hexdigest(), None) for i, p in enumerate(payloads)]
    stream = b"".join(warc.member(r) + b"\0" for r in recs) + b"tail" + warc.MAGIC
    edges = sorted({0, len(stream), *(c for c in cuts if c < len(stream))})
    got = [r for a, b in zip(edges, edges[1:]) for r in warc.records(io.BytesIO(stream), a, b)]
    assert got == recs
