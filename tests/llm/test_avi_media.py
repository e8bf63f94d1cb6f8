import hashlib
import struct
import zlib

import numpy as np
import pytest

from caseloom.llm import avi_media as avi


@pytest.mark.parametrize("payload", [b"\0" * 64, bytes(range(256)) * 9, b"\xff" * 2048, b"\x7f\x80" * 640])
def test_payload_comes_back(payload):
    made = avi.write_avi(avi.encode_frames(payload), len(payload))
    read = avi.parse_avi(made)
    assert avi.decode_own(read.frames).tobytes()[: read.size] == payload


def test_general_decoder_agrees_with_the_fast_one():
    payload = np.random.RandomState(1).randint(0, 256, 2048).astype(np.uint8).tobytes()
    frames = avi.encode_frames(payload)
    units = avi.decode_own(frames)
    planes = avi.pixels_of(avi.units_to_coefs(units).reshape(-1, 64)).reshape(len(frames), 4, 4, 8, 8)
    # a restart resets prediction for every block, so the fast path needs no differences
    for f, p in zip(frames, planes):
        assert (avi.decode_frame(f) == p.transpose(0, 2, 1, 3).reshape(32, 32)).all()
    assert np.allclose(avi.histograms(frames, units), avi.histograms(frames, None))


def test_index_missing_or_counted_from_the_files_start():
    payload = bytes(range(200)) * 20
    frames = avi.encode_frames(payload)
    made = avi.write_avi(frames, len(payload))
    at = made.index(b"idx1")
    assert avi.parse_avi(made[:at]).frames == frames
    movi = made.index(b"movi")
    n = struct.unpack_from("<I", made, at + 4)[0]
    entries = [struct.unpack_from("<4sIII", made, at + 8 + i) for i in range(0, n, 16)]
    moved = b"".join(struct.pack("<4sIII", t, f, o + movi, k) for t, f, o, k in entries)
    assert avi.parse_avi(made[: at + 8] + moved).frames == frames
    with pytest.raises(ValueError):
        avi.parse_avi(b"RIFX" + made[4:])


def test_shots():
    a, b = np.eye(16)[[0] * 5], np.eye(16)[[9] * 4]
    assert avi.shots(np.concatenate([a, b, a])) == [(0, 5), (5, 9), (9, 14)]
    assert avi.shots(a[:1]) == [(0, 1)] and avi.shots(a[:0]) == []


def test_odd_rows(make_docs, odd_rows):
    rows = [r[:2] for r in odd_rows]
    got = avi.read_media(avi.store_texts(make_docs(rows, clashing=True))).collect()
    want = []
    for d, t in rows:
        raw = (t or "").encode()
        p = raw + b"\0" * (-len(raw) % 64 if raw else 64)
        want.append((d, len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:])))
    assert sorted(((r["doc_id"], r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) for r in got), key=repr) == sorted(want, key=repr)
    same = [r for r in got if r["doc_id"] == 5]
    assert same[0] == same[1]
    assert avi.read_media(avi.store_texts(make_docs([]))).count() == 0


def test_media_that_are_none(spark, make_docs):
    files = spark.createDataFrame([(1, 5, None), (2, 6, bytearray(b"junk"))], "doc_id long, n_bytes long, media binary")
    assert avi.clips(files).count() == 0
    a, b = sorted(avi.read_media(files).collect())
    assert tuple(a)[2:] == (None,) * 6 + ("null",)
    assert tuple(b)[2:] == (None,) * 3 + (4, hashlib.sha256(b"junk").hexdigest(), None, "not an AVI file")


def test_damaged_and_foreign_files(spark):
    frames = avi.encode_frames(bytes(range(64)) * 48)
    own = avi.write_avi(frames, 3072)
    wave = b"RIFF" + struct.pack("<I", 4) + b"WAVE"
    # another writer: no payload size, and frames with an application segment
    foreign = avi.write_avi([f[:2] + b"\xff\xe0\x00\x04zz" + f[2:] for f in frames], 0)
    vast = own.replace(b"\xff\xc0\x00\x0b\x08" + struct.pack(">HH", 32, 32), b"\xff\xc0\x00\x0b\x08" + b"\xff\xff\xff\xff")
    cases = [own, wave, foreign, own[:40], own[:400], own[: len(own) // 2], vast, b"RIFF", b"", own.replace(b"idx1", b"idxx")]
    files = spark.createDataFrame([(i, 0, bytearray(m)) for i, m in enumerate(cases)], "doc_id long, n_bytes long, media binary")
    got = {r["doc_id"]: r for r in avi.read_media(files).collect()}
    assert len(got) == len(cases) and got[0]["reason"] is None and got[9]["payload_sha256"] == got[0]["payload_sha256"]
    assert got[1]["reason"] == got[7]["reason"] == got[8]["reason"] == "not an AVI file"
    assert got[2]["reason"] == "no payload" and got[2]["feature"] == got[0]["feature"] and got[2]["payload_bytes"] is None
    assert all(got[i]["feature"] is None and got[i]["reason"].startswith("damaged") for i in (4, 5)) and got[3]["payload_bytes"] is None
    assert vast == own or got[6]["reason"].startswith("damaged")
    assert {r["key"] for r in avi.clips(files).collect()} >= {0, 2, 9}
    rng = np.random.RandomState(4)
    noisy = []
    for i in range(60):  # any byte may be wrong
        raw = bytearray(own)
        for at in rng.randint(0, len(raw), 3):
            raw[at] = rng.randint(0, 256)
        noisy.append((i, 0, raw))
    assert avi.read_media(spark.createDataFrame(noisy, "doc_id long, n_bytes long, media binary")).count() == 60


def test_clips_are_timed(spark):
    dark, light = b"\x00" * avi.FRAME_BYTES, bytes(range(128, 192)) * 16
    payload = dark * 3 + light * 2
    media = spark.createDataFrame([(7, bytearray(avi.write_avi(avi.encode_frames(payload), len(payload))))], "doc_id long, media binary")
    rows = avi.clips(media).orderBy("clip").collect()
    assert [(r["key"], r["first_frame"], r["end_frame"], r["start_us"], r["end_us"]) for r in rows] == [(7, 0, 3, 0, 120_000), (7, 3, 5, 120_000, 200_000)]
