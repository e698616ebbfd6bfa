import base64
import gzip
import hashlib

import pytest

from joblode.llm import warc

SCHEMA = "page_id long, url string, html string, digest string"


def test_round_trip(spark):
    big = "<p>ñandú " + "x" * 70_000 + "</p>\r\n\r\nWARC/1.1\r\n"
    rows = [(1, "http://a/é b\r\n", "<p>one</p>"), (2, "http://b", big), (3, None, None), (4, "u", ""), (5, "http://b", big), (6, "u", "0\r\n\r\n"), (7, "u", "<p>one</p>"), (8, "u", "solo"), (7, "u", "<p>one</p>"), (9, "v", "y" * 40_000), (9, "v", "y" * 40_000)]
    got = warc.round_trip(spark.createDataFrame([(*r, "d") for r in rows], SCHEMA).repartition(3)).collect()
    raw = [(p, (h or "").encode()) for p, _, h in rows]
    keep = {}
    for p, b in raw:
        keep[b] = max(p, keep.get(b, p))
    want = [(p, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "response" if keep[b] == p else "revisit", None if keep[b] == p else keep[b]) for p, b in raw]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_small_payloads_are_all_responses(spark, tmp_path):
    rows = [(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcdef"), (4, "u", "abcdef"), (None, "u", "zz")]
    warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string"), str(tmp_path / "w"), least=3)
    got = warc.read_archives(spark, str(tmp_path / "w")).collect()
    assert sorted((r.page_id or 0, r.record_type) for r in got) == [(0, "response"), (1, "response"), (2, "response"), (3, "revisit"), (4, "response")]


def test_a_lost_response_fails_the_read(spark, tmp_path):
    rows = [(1, "u", "abcdef"), (2, "u", "abcdef"), (3, "u", "other")]
    path = tmp_path / "w"
    warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string"), str(path))
    lost = tmp_path / "lost"
    lost.mkdir()
    kept = []
    for f in sorted(path.rglob("*.gz")):
        data = gzip.decompress(f.read_bytes())
        parts = [b"WARC/1.1" + x for x in data.split(b"WARC/1.1")[1:]]
        kept += [x for x in parts if not (b"WARC-Type: response" in x and b"abcdef" in x)]
    assert len(kept) >= 2
    (lost / "a.warc.gz").write_bytes(gzip.compress(b"".join(kept)))
    with pytest.raises(Exception, match="no response"):
        warc.read_archives(spark, str(lost)).collect()


def test_segments_in_any_order_and_torn_ones():
    block = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n" + warc.chunked(b"hello world" * 1000)
    parts = [{"segment": i + 1, "total": None, "block": block[a : a + 500]} for i, a in enumerate(range(0, len(block), 500))]
    parts[-1]["total"] = len(block)
    assert warc.payload_of(warc.reassembled(parts[::-1])) == b"hello world" * 1000
    for bad in (parts[:-1], parts[1:], [*parts[:3], *parts[4:]]):
        with pytest.raises(ValueError):
            warc.reassembled(bad)


def test_framing():
    for payload in (b"", b"x", b"\r\n0\r\n\r\n" * 3, bytes(range(256)) * 40):
        assert warc.unchunked(warc.chunked(payload, 7)) == payload
    assert warc.unchunked(b"3;ext=1\r\nabc\r\n0\r\nTrailer: x\r\n\r\n") == b"abc"
    found = list(warc.parsed(b"".join(warc.records(5, "u", b"z" * 50_000, None))))
    assert [f["warc-type"] for f, _ in found] == ["response", *["continuation"] * 3]
    assert found[-1][0]["warc-segment-total-length"] == str(sum(len(b) for _, b in found))


def test_empty_table(spark):
    assert warc.round_trip(spark.createDataFrame([], SCHEMA)).collect() == []
