import base64
import hashlib
import os
import random
import zlib

import pytest
import zstandard

from quercus.llm import transport, warc
from quercus.llm.common import written

PAGES = [
    (1, "http://a/1", "<p>one</p>", "k"),
    (2, None, None, "k"),
    (3, "http://a/3\r\nX: y", "<p>one</p>", None),
    (4, "", "", "k"),
    (None, "http://a/5", "<p>one</p>", "k"),
    (6, "http://ü/6", "é" * 400_000, "k"),
    (7, "http://a/7", "alone\r\n\r\nWARC/1.1\r\n", "k"),
    (3, "http://a/3b", "<p>one</p>", "k"),
]


def pages(spark, rows=PAGES):
    return spark.createDataFrame(rows, "page_id bigint, url string, html string, record_id string").repartition(3)


def test_round_trip(spark):
    got = warc.round_trip(pages(spark)).select(warc.id_of("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", warc.id_of("refers_to_id").alias("refers_to")).collect()
    assert len(got) == len(PAGES)
    by_digest = {}
    for r in got:
        by_digest.setdefault(r.payload_digest, []).append(r)
    for text in {p[2] or "" for p in PAGES}:
        payload = text.encode()
        rows = by_digest.pop(base64.b32encode(hashlib.sha1(payload).digest()).decode())
        ids = sorted((p[0] for p in PAGES if (p[2] or "") == text), key=lambda i: (i is not None, i or 0))
        assert sorted((r.page_id for r in rows), key=lambda i: (i is not None, i or 0)) == ids
        assert {r.payload_bytes for r in rows} == {len(payload)}
        kept = [r for r in rows if r.record_type == "response"]
        assert len(kept) == 1 and kept[0].page_id == ids[-1] and kept[0].refers_to is None
        assert all(r.refers_to == ids[-1] and r.record_type == "revisit" for r in rows if r is not kept[0])
    assert not by_digest
    assert warc.round_trip(pages(spark, [])).count() == 0
    large = warc.read_back(warc.write(pages(spark), warc.scratch(spark, "t"), min_revisit_bytes=11)).collect()
    assert all(r.record_type == "response" for r in large)


def test_bundle_can_be_sought(tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "FRAME_BYTES", 1000)
    rng = random.Random(4)
    bundle = warc.Bundle(path := str(tmp_path / "x.warc.zst"))
    plain = []
    for i in range(50):
        payload = rng.randbytes(rng.choice([0, 10, 700, 5000]))
        data = warc.record(f"urn:page:{i}#{i}", f"http://a/{i}", payload, len(payload), warc.digest(payload), None)
        bundle.add(f"urn:page:{i}#{i}", data)
        plain.append((payload, data))
    bundle.close()
    reader = warc.BundleReader(path)
    assert len(reader.frames) > 10
    for i in (0, 7, 49):
        headers, block = reader.record(f"urn:page:{i}#{i}")
        assert headers["warc-type"] == "response" and block.endswith(plain[i][0])
    with pytest.raises(KeyError):
        reader.record("urn:page:99#99")
    whole = b"".join(d for _, d in plain)
    assert reader.read_at(900, 3000) == whole[900:3900]
    assert zstandard.ZstdDecompressor().stream_reader(open(path, "rb"), read_across_frames=True).read() == whole
    (tmp_path / "bad").write_bytes(b"0" * 100)
    with pytest.raises(ValueError, match="no seek table"):
        warc.BundleReader(str(tmp_path / "bad"))


def test_transport_round_trip():
    rng = random.Random(5)
    for n in [*range(0, 400), 16384, 16385, 16384 * 9 + 5]:
        payload = rng.randbytes(n)
        data = transport.mux(payload)
        found = transport.demux(data)
        assert len(data) % 188 == 0 and b"".join(u.data for u in found.units) == payload
        assert not (found.discontinuities or found.sync_errors or found.table_errors or found.cut_units)
        assert found.programs == {1: 0x1000} and found.streams == {0x100: 6}
    assert [u.pts for u in found.units] == [3600 * i for i in range(10)]
    assert [u.random_access for u in found.units] == [i % 8 == 0 for i in range(10)]


def test_transport_errors():
    data = transport.mux(bytes(50_000))
    lost = transport.demux(data[: 188 * 10] + data[188 * 11 :])
    assert lost.discontinuities == 1
    twice = transport.demux(data[: 188 * 11] + data[188 * 10 :])
    assert twice.discontinuities == 0 and b"".join(u.data for u in twice.units) == bytes(50_000)
    assert transport.demux(b"xx" + data).sync_errors == 1
    broken = bytearray(data)
    broken[10] ^= 1
    assert transport.demux(bytes(broken)).table_errors == 1
    assert transport.demux(b"").units == [] and transport.demux(b"no stream").units == []
    assert transport.crc32_mpeg(b"123456789") == 0x0376E6E7


def test_media_columns(spark):
    rows = [(1, "text", "m"), (2, None, None), (None, "", "m"), (4, "é" * 100_000, "m"), (1, "text", "m"), (5, "x" * 64, "m")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, feature string")
    got = transport.indexed(written(transport.stored(df), "media")).collect()
    assert len(got) == len(rows)
    for r in got:
        texts = [(t or "").encode() for i, t, _ in rows if i == r.doc_id]
        payload = texts[0] + bytes(-len(texts[0]) % 64 or (0 if texts[0] else 64))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(texts[0]), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert r.media_bytes == len(transport.mux(payload)) and r.media_sha256 == hashlib.sha256(transport.mux(payload)).hexdigest()
        assert r.feature.endswith("errors=0") and sum(u.n_bytes for u in r.units) == len(payload)
    same = {(r.media_sha256, r.feature) for r in got if r.doc_id == 1}
    assert len(same) == 1
    assert transport.indexed(transport.stored(df.limit(0))).count() == 0


def plain_stream(data):
    """A transport stream by the tables of ISO/IEC 13818-1, written apart from the operator's code: programme map, stream types, units (stamp, data, random access)."""

    def crc(section):
        c = 0xFFFFFFFF
        for byte in section:
            for bit in range(7, -1, -1):
                top = (c >> 31) ^ (byte >> bit & 1)
                c = (c << 1) & 0xFFFFFFFF
                if top:
                    c ^= 0x04C11DB7
        return c

    assert len(data) % 188 == 0
    maps, kinds, counters, parts, table = {}, {}, {}, [], {}
    for at in range(0, len(data), 188):
        packet = data[at : at + 188]
        bits = int.from_bytes(packet[:4], "big")
        assert bits >> 24 == 0x47 and not bits >> 23 & 1 and not bits >> 6 & 3  # in step, no error, not scrambled
        start, pid, control, counter = bits >> 22 & 1, bits >> 8 & 0x1FFF, bits >> 4 & 3, bits & 15
        body, access = packet[4:], False
        if control & 2:
            size = body[0]
            access = bool(size and body[1] & 0x40)
            if size and body[1] & 0x10:
                clock = int.from_bytes(body[2:8], "big")
                assert clock >> 9 & 0x3F == 0x3F
            body = body[1 + size :]
        if control & 1:
            assert counters.get(pid, (counter - 1) % 16) == (counter - 1) % 16
            counters[pid] = counter
        if pid == 0 or pid in maps.values():
            assert start
            section = body[1 + body[0] :]
            section = section[: 3 + (int.from_bytes(section[1:3], "big") & 0xFFF)]
            assert crc(section) == 0
            if pid == 0:
                assert section[0] == 0
                maps |= {int.from_bytes(section[i : i + 2], "big"): int.from_bytes(section[i + 2 : i + 4], "big") & 0x1FFF for i in range(8, len(section) - 4, 4)}
            else:
                assert section[0] == 2
                i = 12 + (int.from_bytes(section[10:12], "big") & 0xFFF)
                while i < len(section) - 4:
                    kinds[int.from_bytes(section[i + 1 : i + 3], "big") & 0x1FFF] = section[i]
                    i += 5 + (int.from_bytes(section[i + 3 : i + 5], "big") & 0xFFF)
        elif start:
            table[pid] = len(parts)
            parts.append([access, bytearray(body)])
        else:
            parts[table[pid]][1].extend(body)
    units = []
    for access, unit in parts:
        assert unit[:3] == b"\0\0\1"
        size = int.from_bytes(unit[4:6], "big")
        assert size in (0, len(unit) - 6) and unit[6] >> 6 == 2 and unit[7] >> 6 == 2
        b = unit[9:14]
        assert b[0] & 1 and b[2] & 1 and b[4] & 1
        units.append(((b[0] >> 1 & 7) << 30 | b[1] << 22 | (b[2] >> 1) << 15 | b[3] << 7 | b[4] >> 1, bytes(unit[9 + unit[8] :]), access))
    return maps, kinds, units


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="needs the test tables")
def test_media_query_equals_plain_parser(spark):
    """The query's figures against the stored streams as another parser reads them."""
    from quercus.llm import queries

    texts = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    got = queries.QUERIES["op9_transport_stream"](spark, "/root/testdata/sf0.001").collect()
    assert len(got) == len(texts)
    for r in got:
        data = texts[r.doc_id]
        payload = data + b"\0" * ((64 - len(data) % 64) % 64 if data else 64)
        media = transport.mux(payload)
        maps, kinds, units = plain_stream(media)
        assert maps == {1: 0x1000} and kinds == {0x100: 6} and b"".join(u[1] for u in units) == payload
        assert [u[0] for u in units] == [3600 * i for i in range(len(units))] and [u[2] for u in units] == [i % 8 == 0 for i in range(len(units))]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert (r.media_bytes, r.media_sha256) == (len(media), hashlib.sha256(media).hexdigest()) and f"units={len(units)};" in r.feature and f"packets={len(media) // 188};" in r.feature
