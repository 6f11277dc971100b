"""FLAC media columns: exact round trips, checksums, seeking and the query's digests."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from sparkloom.llm import flac
from sparkloom.llm.queries import op2_flac

rng = random.Random(3)
PAYLOADS = [
    b"", b"a", b"\xff" * 576, b"abc" * 192, b"q" * 577, bytes(rng.randrange(256) for _ in range(3000)),
    bytes(int(128 + 100 * ((i % 97) / 97 - 0.5)) for i in range(5000)), "Zürich, 東京 and 🙂. ".encode() * 400, b"\x00\xff" * 700,
]


def padded(p):
    return p + b"\xff" * (-len(p) % flac.BLOCK or (0 if p else flac.BLOCK))


def test_round_trip_is_exact():
    media = flac.encode(PAYLOADS)
    assert [d[0] for d in flac.decode(media)] == [padded(p) for p in PAYLOADS]
    assert all(m[:4] == b"fLaC" for m in media)
    assert flac.encode(PAYLOADS) == media and flac.encode([PAYLOADS[7]]) == [media[7]]
    assert len(media[7]) < len(padded(PAYLOADS[7])) * 1.1


def test_every_block_can_be_read_alone():
    p = PAYLOADS[5]
    media = flac.encode([p])[0]
    for sample in range(0, len(padded(p)), 500):
        block = sample // flac.BLOCK * flac.BLOCK
        assert flac.read_block(media, sample) == padded(p)[block : block + flac.BLOCK]


@pytest.mark.parametrize("back", [1, 2, 40, 300])
def test_a_changed_byte_is_found(back):
    media = bytearray(flac.encode([PAYLOADS[5]])[0])
    media[-back] ^= 4
    with pytest.raises(ValueError):
        flac.decode([bytes(media)])


def test_frame_bits_by_hand():
    """A constant frame, written out: header, number 0, CRC-8, subframe 0 with one sample, CRC-16."""
    frame = flac.encode_frames(flac.np.full((1, flac.BLOCK), 5, flac.np.int8), flac.np.array([0]))[0]
    assert frame[:5] == flac.HEAD + b"\0" and frame[6:8] == b"\0\x05" and len(frame) == 10

    def crc(data, polynomial, bits):
        c = 0
        for b in data:
            c ^= b << (bits - 8)
            for _ in range(8):
                c = (c << 1 ^ (polynomial if c >> (bits - 1) else 0)) & ((1 << bits) - 1)
        return c

    assert frame[5] == crc(frame[:5], 0x07, 8) and int.from_bytes(frame[8:], "big") == crc(frame[:8], 0x8005, 16)


def test_spark_columns(spark):
    rows = [(i, p) for i, p in enumerate([*PAYLOADS, None])] + [(1, PAYLOADS[1])]
    docs = spark.createDataFrame(rows, "doc_id long, data binary")
    stored = flac.write_flac(docs, "doc_id", F.col("data"))
    found = flac.read_flac(stored.withColumn("pcm", F.lit(1)).withColumn("id", F.lit("x"))).collect()
    assert sorted((r.doc_id, r.n_bytes, bytes(r.pcm)) for r in found) == sorted((i, len(p or b""), padded(p or b"")) for i, p in rows)
    assert all(r.sample_offsets == list(range(0, len(r.pcm), flac.BLOCK)) for r in found)
    assert flac.read_flac(flac.write_flac(docs.limit(0), "doc_id", F.col("data"))).count() == 0


def test_query_equals_digests_of_the_texts(spark, tmp_path):
    texts = [(1, "plain words"), (2, None), (3, ""), (4, "plain words"), (5, "é" * 300_000), (6, "x" * 576)]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in op2_flac(spark, str(tmp_path)).collect()}
    for i, t in texts:
        raw = (t or "").encode()
        p = padded(raw)
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]))
    assert got[1].media_sha256 == got[4].media_sha256 and got[1].feature == got[4].feature
