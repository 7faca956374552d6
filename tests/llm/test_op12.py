"""WARC bundles: round trips, random access, revisits, plain decoders."""

import hashlib
import io
import os

import duckdb
import numpy as np
import pytest
import zstandard
from tenantscope.llm import warc
from tenantscope.llm.warc import ORACLE, Bundle, BundleWriter, op12_warc, read_records, record_index, write_bundles

BIG = "long page é " * 20
ROWS = [(3, "http://a/3", BIG), (1, "http://a/1 x\r\nEvil: 1", BIG), (2, None, BIG), (4, "u4", "short"), (5, "u5", "short"), (6, "u6", None),
        (7, "u7", ""), (1, "again", BIG), (None, "null id", BIG), (None, "n2", "only null ids " * 20), (None, "n3", "only null ids " * 20),
        (8, "u8", "x" * 99), (9, "u9", "x" * 99), (10, "u10", "y" * 100), (11, "u11", "y" * 100), (-5, "é", "z" * 300_000), (12, "w", "\r\n\r\nWARC/1.1\r\n" * 20)]


def expected(rows):
    full = [(p, (h or "").encode()) for p, _, h in rows]
    least = {}
    for p, h in full:
        if len(h) >= 100 and p is not None:
            least[h] = min(p, least.get(h, p))
    return sorted(((p, len(h), hashlib.sha256(h).hexdigest(), *(("revisit", least[h]) if h in least and p != least[h] else ("response", None)))
                   for p, h in full), key=str)


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame([(*r, "mine") for r in ROWS], "page_id long, url string, html string, digest string").repartition(3)


def test_query_on_odd_rows(spark, pages):
    got = op12_warc(pages).collect()
    assert sorted((tuple(r) for r in got), key=str) == expected(ROWS)
    duckdb_rows = duckdb.connect()
    duckdb_rows.register("pages", pages.drop("digest").toArrow())
    assert sorted(duckdb_rows.sql(ORACLE).fetchall(), key=str) == expected(ROWS)
    assert not op12_warc(pages.limit(0)).collect()


@pytest.mark.parametrize("frame,bundle", [(1, 1), (2000, 1 << 20), (1 << 20, 1 << 26)])
def test_round_trip_and_random_access(spark, pages, tmp_path, frame, bundle):
    path = str(tmp_path / "w")
    bundles = write_bundles(pages, path, frame_bytes=frame, bundle_bytes=bundle)
    assert sorted(os.path.getsize(r.path) for r in bundles.collect()) == sorted(r.bytes for r in bundles.collect())
    assert sum(r.records for r in bundles.collect()) == len(ROWS)
    read = read_records(bundles).collect()
    stored = {hashlib.sha256(r.payload).hexdigest() for r in read if r.payload is not None}
    assert {r.payload_digest for r in read} == stored  # nothing is lost with the revisits
    want = sorted((h or "") for p, _, h in ROWS if (p, len((h or "").encode()), hashlib.sha256((h or "").encode()).hexdigest(), "response", None) in expected(ROWS))
    assert sorted(bytes(r.payload).decode() for r in read if r.record_type == "response") == want
    ids = {r.record_id for r in read}
    assert {r.refers_to_id for r in read if r.record_type == "revisit"} <= ids
    index = record_index(bundles).collect()
    assert {r.record_id for r in index} == ids and len(index) == len(ROWS)
    for r in index:
        b = Bundle(r.path)
        record = b.record(r.record_id)
        assert record.record_id == r.record_id
        assert warc.parse_record(b.frame(r.frame)[r.offset:r.offset + r.length]) .record_id == r.record_id
        with pytest.raises(KeyError):
            b.record("urn:x-page:77:none")
    if frame == 2000:
        assert max(r.frames for r in bundles.collect()) > 1


def test_plain_decoders_read_the_bundle(spark, pages, tmp_path):
    """Frames one after the other are one WARC file; skippable frames vanish."""
    path = write_bundles(pages.coalesce(1), str(tmp_path / "w"), frame_bytes=700).first().path
    plain = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(open(path, "rb").read()), read_across_frames=True).read()
    at, kinds = 0, []
    while at < len(plain):
        head, _, _ = plain[at:].partition(b"\r\n\r\n")
        lines = head.decode().split("\r\n")
        assert lines[0] == "WARC/1.1" and "Evil: 1" not in lines
        h = dict(x.split(": ", 1) for x in lines[1:])
        kinds.append(h["WARC-Type"])
        at += len(head) + 4 + int(h["Content-Length"])
        assert plain[at:at + 4] == b"\r\n\r\n"
        at += 4
    assert kinds[0] == "warcinfo" and len(kinds) == len(ROWS) + 1


def test_damage_is_noticed(tmp_path):
    path = str(tmp_path / "b")
    with open(path, "wb") as f:
        w = BundleWriter(f, 50)
        for i in range(9):
            w.write(*warc.page_record(i, "u", b"payload %d" % i, 9, "d", None))
        assert w.close() == 9
    b = Bundle(path)
    assert len(b.entries) == 10 and b.entries["plain"][-1] == 0 and b.starts[0] == 0
    data = bytearray(open(path, "rb").read())
    data[int(b.starts[4]) + 20] ^= 255
    open(path, "wb").write(data)
    with pytest.raises((ValueError, zstandard.ZstdError)):
        Bundle(path).frame(4)
    assert Bundle(path).record("urn:x-page:5:d").block.endswith(b"payload 5")
    open(path, "wb").write(data[:-1] + b"\0")
    with pytest.raises(ValueError):
        Bundle(path)


def test_whole_table(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    rows = [(r.page_id, r.url, r.html) for r in pages.collect()]
    assert sorted((tuple(r) for r in op12_warc(pages).collect()), key=str) == expected(rows)
    assert np.dtype(warc.ENTRY).itemsize == 12
