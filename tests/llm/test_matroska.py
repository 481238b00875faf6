import hashlib
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sheetlens.llm import matroska as mk


@settings(max_examples=40, deadline=None)
@given(st.binary(min_size=64, max_size=70_000))
def test_round_trip(data):
    media = mk.parse(mk.mux(data))
    assert mk.samples_of(mk.mux(data), media) == data
    assert media.doc_type == "matroska" and [p[1] for p in media.packets] == sorted(p[1] for p in media.packets)
    assert abs(media.duration - len(data) / 8) < 1e-9 and len(media.cues) == len(media.clusters)


def test_long_files_have_many_clusters_and_cues():
    data = bytes(range(256)) * 3000
    media = mk.parse(mk.mux(data))
    assert len(media.clusters) > 4 and mk.samples_of(mk.mux(data), media) == data
    assert [(t, p) for t, _, p in media.cues] == [(t, p) for p, t in media.clusters]
    assert media.packets[9][1] == 9 * 128_000_000


def test_other_writers_lacing_groups_and_unknown_sizes():
    xiph = b"\x81\0\x05\x02\x02" + b"\xff\x01" + b"\x02" + b"a" * 256 + b"bb" + b"ccc"
    ebml = b"\x81\0\x00\x06\x02" + b"\x83" + mk._signed_size(-1) + b"ddd" + b"ee" + b"f"
    cluster = mk._uint(mk.TIMECODE, 7) + mk._element(mk.SIMPLE_BLOCK, xiph) + mk._element(mk.BLOCK_GROUP, mk._element(mk.BLOCK, ebml))
    unknown = mk.CLUSTER.to_bytes(4, "big") + b"\x01" + b"\xff" * 7 + cluster
    second = mk._element(mk.CLUSTER, mk._uint(mk.TIMECODE, 9), mk._element(mk.SIMPLE_BLOCK, b"\x82\xff\xff\x80zz"))
    data = mk._HEADER + mk.SEGMENT.to_bytes(4, "big") + b"\x01" + b"\xff" * 7 + unknown + second
    media = mk.parse(data)
    assert [(t, ns // 10**6, data[o : o + n]) for t, ns, o, n, _ in media.packets] == [
        (1, 12, b"a" * 256), (1, 12, b"bb"), (1, 12, b"ccc"), (1, 7, b"ddd"), (1, 7, b"ee"), (1, 7, b"f"), (2, 8, b"zz")]


@pytest.mark.parametrize("cut", [3, 30, 150, -1])
def test_damaged_files_raise(cut):
    with pytest.raises((ValueError, IndexError)):
        mk.parse(mk.mux(bytes(5000))[:cut])


def test_digests_and_packets(spark):
    rows = [(1, None), (2, ""), (3, "x" * 64), (4, "é" * 33), (None, "long " * 60_000), (4, "é" * 33)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'clash' AS feature", "1 AS media")
    got = mk.digests(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        raw = next((t or "") for i, t in rows if i == r.doc_id).encode()
        pay = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(pay), hashlib.sha256(pay).hexdigest(), zlib.crc32(pay[-64:]))
        assert r.media_bytes == len(mk.mux(pay)) and r.media_sha256 == hashlib.sha256(mk.mux(pay)).hexdigest()
    assert len({tuple(r)[1:] for r in got if r.doc_id == 4}) == 1
    packets = mk.packet_table(mk.stored(docs), "doc_id", "media")
    sizes = {r.doc_id: r.n for r in packets.groupBy("doc_id").agg({"byte_length": "sum"}).toDF("doc_id", "n").collect()}
    assert sizes == {1: 64, 2: 64, 3: 64, 4: 256, None: 300_032}
    assert packets.filter("NOT cued OR track <> 1").count() == 0
    assert mk.digests(docs.filter("false")).count() == 0
