"""Archives: round trip, seeking, the seek table, revisits."""

import hashlib

import pytest
import zstandard
from pyspark.sql import functions as F

from provenspark.llm import warc as W

BIG = "<p>é</p>" * 200
ROWS = [(1, "http://a/x", BIG), (2, "http://b/\r\nevil: 1", BIG), (3, None, "small"), (4, "http://c", "small"), (5, "u", None), (6, "u", ""), (None, "n", BIG), (2, "again", BIG), (8, "long", "z" * 3_000_000)]


def pages(spark, rows=ROWS):
    return spark.createDataFrame([(i, u, h, "x", 1) for i, u, h in rows], "page_id long, url string, html string, digest string, bytes int")


def test_round_trip(spark):
    index = W.write_archives(pages(spark))
    rows = W.read_archives(index, with_payload=True).collect()
    assert len(rows) == len(ROWS)
    want = sorted((i is None, i or 0, (h or "").encode()) for i, _, h in ROWS)
    got = []
    by_id = {r.page_id: r for r in rows if r.record_type == "response"}
    for r in rows:
        body = bytes(r.payload) if r.record_type == "response" else bytes(by_id[r.refers_to].payload)
        assert hashlib.sha1(body).hexdigest() == r.payload_digest and len(body) == r.payload_bytes
        got.append((r.page_id is None, r.page_id or 0, body))
    assert sorted(got) == want
    kinds = sorted((r.page_id or 0, r.record_type, r.refers_to) for r in rows)
    assert kinds == sorted([(0, "response", None), (1, "revisit", 2), (2, "response", None), (2, "response", None), (3, "response", None), (4, "response", None), (5, "response", None), (6, "response", None), (8, "response", None)])


def test_seek_and_plain_decoding(spark):
    index = W.write_archives(pages(spark, [(i, f"u{i}", f"text {i} " * 4000) for i in range(120)]).coalesce(1))
    one = W.read_records(index, F.col("page_id") == 77).collect()
    assert len(one) == 1 and bytes(one[0].payload).decode() == "text 77 " * 4000
    uri = index.first()["bundle"]
    store, path = W._open(uri)
    with store.open_input_file(path) as f:
        table = W.seek_table(f)
        whole = f.read_at(f.size(), 0)
    assert len(table) > 2 and table[-1][0] + table[-1][1] < len(whole)
    plain = zstandard.ZstdDecompressor().stream_reader(whole, read_across_frames=True).read()
    assert len(list(W.parse(plain))) == 120 and len(plain) == sum(t[2] for t in table)


def test_edges(spark):
    assert W.archived(spark, pages(spark).limit(0)).count() == 0
    with pytest.raises(ValueError):
        list(W.parse(b"HTTP/1.1 200\r\n\r\n"))
