import hashlib
import zlib

import numpy as np
import pytest

from kiteloom.llm import mpegts, queries

from .conftest import by_id


@pytest.mark.parametrize("size", [*range(0, 400, 7), 8191, 8192, 8193, 65536, 200_000])
def test_round_trip(size):
    payload = np.random.default_rng(size).integers(0, 256, size, np.uint8).tobytes()
    stream = mpegts.mux(payload)
    read = mpegts.demux(stream)
    assert read.payload == payload and len(stream) % 188 == 0
    assert read.continuity_errors == 0 and read.broken == 0
    assert sum(read.sizes) == size
    if size:
        assert read.pid == mpegts.DATA_PID and read.random[0]
        assert read.pts == [i * mpegts.STEP for i in range(len(read.pts))]
        assert [i for i, r in enumerate(read.random) if r] == list(range(0, len(read.pts), mpegts.RANDOM_EVERY))


def packets(stream):
    return np.frombuffer(stream, np.uint8).reshape(-1, 188).copy()


def test_a_lost_packet_is_noticed():
    p = packets(mpegts.mux(bytes(50_000)))
    read = mpegts.demux(np.delete(p, 40, axis=0).tobytes())
    assert read.continuity_errors == 1 and read.broken == 1


def test_a_repeated_packet_is_skipped():
    payload = bytes(range(256)) * 100
    p = packets(mpegts.mux(payload))
    assert mpegts.demux(np.insert(p, 41, p[40], axis=0).tobytes()).payload == payload


def test_other_packets_are_ignored_and_damage_counted():
    payload = bytes(range(256)) * 100
    p = packets(mpegts.mux(payload))
    null = np.full((1, 188), 0xFF, np.uint8)
    null[0, :4] = 0x47, 0x1F, 0xFF, 0x10
    assert mpegts.demux(np.insert(p, 10, null, axis=0).tobytes()).payload == payload
    bad = p.copy()
    bad[30, 0] = 0
    assert mpegts.demux(bad.tobytes()).broken >= 1
    tables = p.copy()
    tables[0, 20] ^= 1 if tables[0, 20] != 0xFF else 0
    tables[0, 8] ^= 1
    assert mpegts.demux(tables[:30].tobytes()).pid is None
    assert mpegts.demux(mpegts.mux(b"x" * 500) + b"tail").broken == 1


def test_table_crc_is_the_published_check_value():
    assert mpegts._section_crc(b"123456789") == 0x0376E6E7


def test_time_stamps_keep_33_bits():
    for pts in (0, 1, (1 << 33) - 1, 123456789):
        assert mpegts._unstamp(mpegts._stamp(2, pts)) == pts


def test_query_columns(spark, sf_dir):
    rows = by_id(queries.op3_mpegts(spark, sf_dir))
    for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect():
        raw, got = (r.text or "").encode(), rows[r.doc_id]
        payload = raw + bytes(-len(raw) % 64 or (64 if not raw else 0))
        assert (got.n_bytes, got.payload_bytes) == (len(raw), len(payload))
        assert got.payload_sha256 == hashlib.sha256(payload).hexdigest()
        assert got.tail_crc32 == zlib.crc32(payload[-64:])
        stream = mpegts.mux(payload)
        assert (got.media_bytes, got.media_sha256) == (len(stream), hashlib.sha256(stream).hexdigest())
        assert got.feature.endswith("continuity_errors=0")


def test_odd_rows(odd_docs, no_docs, docs):
    assert mpegts.from_streams(mpegts.to_streams(no_docs)).count() == 0
    rows = mpegts.from_streams(mpegts.to_streams(odd_docs)).collect()
    assert len(rows) == 7 and all(len(r.payload) % 64 == 0 and r.payload for r in rows)
    with pytest.raises(ValueError):
        mpegts.from_streams(mpegts.to_streams(docs).withColumnRenamed("doc_id", "pid"))
