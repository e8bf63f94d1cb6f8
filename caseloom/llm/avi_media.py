"""Media columns: AVI files of motion JPEG, written, indexed, decoded and cut into shots.

Storing. The unit of a JPEG frame is the quantised DCT coefficient. A payload byte b becomes one coefficient of size
category 8 (b itself from 128 on, else b - 255), whose 8 extra bits are b. The Huffman tables hold the one symbol
(run 0, size 8), coded as the bit 0, so a block of 64 coefficients is 576 bits; a restart interval of one block resets
DC prediction. Any baseline decoder reads these frames, and the payload comes back bit by bit, because quantised
coefficients are never rounded. A frame has 4 x 4 blocks (1,024 payload bytes); the payload's length is kept in the
stream's ``strd`` chunk, for the last frame is filled up with zero bytes.

Reading. :func:`parse_avi` follows the RIFF lists to ``avih``, ``strd`` and ``idx1``; frames are found by the index.
:func:`decode_frame` decodes an intra frame: frames in the layout above all at once with numpy, other baseline
sequential JPEG by table lookup. Pixels are the inverse DCT of the dequantised coefficients. :func:`shots` cuts where the
difference of two frames' histograms is beyond mean + 3 deviations of the differences in the current shot.

Edge cases: a null or empty payload is 64 zero bytes. No file ends the job: a null, bytes that are no AVI file, a file
that is cut off or damaged, and frames that are no baseline JPEG with its own tables or have over ``MAX_PIXELS`` give null
features, no clips, and the reason in a column of its own. A file of another writer has shots and clips but no payload. A
stream of one frame is one clip, one without frames none; repeated rows repeat; an empty table gives no rows; no other
columns are read.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import batches_of, texts_of, tune

SIDE = 4  # blocks in a row and in a column of a frame
BLOCKS, UNIT = SIDE * SIDE, 64
FRAME_BYTES = BLOCKS * UNIT
FPS = 25
BINS = 16
#: Larger frames are refused: a damaged header must not claim gigabytes.
MAX_PIXELS = 1 << 26
ZIGZAG = np.array([0, 1, 8, 16, 9, 2, 3, 10, 17, 24, 32, 25, 18, 11, 4, 5, 12, 19, 26, 33, 40, 48, 41, 34, 27, 20, 13, 6, 7, 14, 21, 28, 35, 42, 49, 56, 57, 50, 43, 36, 29, 22, 15, 23, 30, 37, 44, 51, 58, 59, 52, 45, 38, 31, 39, 46, 53, 60, 61, 54, 47, 55, 62, 63])


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


@lru_cache(1)
def frame_head() -> bytes:
    side = 8 * SIDE
    one_code = bytes([1] + [0] * 15 + [8])  # a single code of one bit, for symbol 0x08
    return (
        b"\xff\xd8"
        + _segment(0xDB, b"\x00" + b"\x01" * 64)
        + _segment(0xC0, struct.pack(">BHHB3B", 8, side, side, 1, 1, 0x11, 0))
        + _segment(0xC4, b"\x00" + one_code + b"\x10" + one_code)
        + _segment(0xDD, struct.pack(">H", 1))
        + _segment(0xDA, bytes([1, 1, 0, 0, 63, 0]))
    )


def encode_frames(payload: bytes) -> list[bytes]:
    """JPEG frames that hold ``payload``, the last one filled up with zeros."""
    n = -(-len(payload) // FRAME_BYTES)
    data = np.zeros(n * FRAME_BYTES, np.uint8)
    data[: len(payload)] = np.frombuffer(payload, np.uint8)
    bits = np.zeros((n * BLOCKS * UNIT, 9), np.uint8)
    bits[:, 1:] = np.unpackbits(data).reshape(-1, 8)
    blocks = np.empty((n * BLOCKS, 74), np.uint8)
    blocks[:, :72] = np.packbits(bits).reshape(-1, 72)
    blocks[:, 72] = 0xFF
    blocks[:, 73] = 0xD0 + (np.arange(n * BLOCKS) % BLOCKS) % 8
    flat = blocks.reshape(n, -1)
    stuffed = flat == 0xFF
    stuffed.reshape(n, BLOCKS, 74)[:, :, 72] = False
    head, out = frame_head(), []
    for frame, marks in zip(flat, stuffed.any(axis=1)):
        scan = frame[:-2]  # no restart after the last block
        raw = b"".join(b[:-2].tobytes().replace(b"\xff", b"\xff\x00") + b[-2:].tobytes() for b in frame.reshape(-1, 74))[:-2] if marks else scan.tobytes()
        out.append(head + raw + b"\xff\xd9")
    return out


def _chunk(tag: bytes, body: bytes) -> bytes:
    return tag + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2)


def write_avi(frames: list[bytes], size: int, width: int = 8 * SIDE, height: int = 8 * SIDE, fps: int = FPS) -> bytes:
    """An AVI 1.0 file with one MJPG stream and an idx1 index; ``size`` goes to the ``strd`` chunk."""
    most = max(map(len, frames), default=0)
    avih = struct.pack("<14I", 1_000_000 // fps, most * fps, 0, 0x10, len(frames), 0, 1, most, width, height, 0, 0, 0, 0)
    strh = b"vidsMJPG" + struct.pack("<IHHIIIIIIIIhhhh", 0, 0, 0, 0, 1, fps, 0, len(frames), most, 0xFFFFFFFF, 0, 0, 0, width, height)
    strf = struct.pack("<IiiHH4sIiiII", 40, width, height, 1, 24, b"MJPG", width * height * 3, 0, 0, 0, 0)
    strl = _chunk(b"LIST", b"strl" + _chunk(b"strh", strh) + _chunk(b"strf", strf) + _chunk(b"strd", struct.pack("<Q", size)))
    hdrl = _chunk(b"LIST", b"hdrl" + _chunk(b"avih", avih) + strl)
    movi, index, at = [b"movi"], [], 4
    for f in frames:
        c = _chunk(b"00dc", f)
        index.append(b"00dc" + struct.pack("<III", 0x10, at, len(f)))
        movi.append(c)
        at += len(c)
    return _chunk(b"RIFF", b"AVI " + hdrl + _chunk(b"LIST", b"".join(movi)) + _chunk(b"idx1", b"".join(index)))


@dataclass
class Avi:
    us_per_frame: int
    size: int | None
    frames: list[bytes]


def parse_avi(data: bytes) -> Avi:
    """Follow the lists of a RIFF file; frames by idx1, or by walking ``movi`` where there is no index."""
    if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    us, size, movi, index, walked = 1_000_000 // FPS, None, 0, None, []
    stack = [(12, min(len(data), 8 + struct.unpack_from("<I", data, 4)[0]))]
    while stack:
        at, end = stack.pop()
        while at + 8 <= end:
            tag, n = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
            body = at + 8
            if tag == b"LIST":
                if data[body : body + 4] == b"movi":
                    movi = body
                stack.append((body + 4, min(end, body + n)))
            elif tag == b"avih":
                us = struct.unpack_from("<I", data, body)[0] or us
            elif tag == b"strd" and n >= 8:
                size = struct.unpack_from("<Q", data, body)[0]
            elif tag == b"idx1":
                index = data[body : body + n]
            elif tag[2:] in (b"dc", b"db"):
                walked.append((body, n))
            at = body + n + n % 2
    if index is not None:
        entries = [struct.unpack_from("<4sIII", index, i) for i in range(0, len(index) - 15, 16)]
        entries = [e for e in entries if e[0][2:] in (b"dc", b"db")]
        # offsets count from the list's type, or from the file's start in some writers
        base = 0 if entries and entries[0][2] > movi and data[entries[0][2] : entries[0][2] + 4] == entries[0][0] else movi
        walked = [(base + off + 8, n) for _, _, off, n in entries]
    if any(a + n > len(data) for a, n in walked):
        raise ValueError("a frame lies beyond the file's end")
    return Avi(us, size, [data[a : a + n] for a, n in walked])


@lru_cache(1)
def _dct() -> np.ndarray:
    k, x = np.arange(8)[:, None], np.arange(8)[None]
    c = np.cos((2 * x + 1) * k * np.pi / 16) / 2
    c[0] /= np.sqrt(2)
    return c.astype(np.float32)


def pixels_of(coefs: np.ndarray) -> np.ndarray:
    """(n, 64) dequantised zigzag coefficients to (n, 8, 8) samples."""
    c = _dct()
    grid = np.empty((len(coefs), 64), np.float32)
    grid[:, ZIGZAG] = coefs
    rows = (grid.reshape(-1, 8) @ c).reshape(-1, 8, 8).transpose(0, 2, 1)  # along u, then the other axis
    out = (np.ascontiguousarray(rows).reshape(-1, 8) @ c).reshape(-1, 8, 8).transpose(0, 2, 1)
    return np.clip(np.rint(out) + 128, 0, 255).astype(np.uint8)


def decode_own(frames: list[bytes]) -> np.ndarray | None:
    """Payload bytes (n, 1024) of frames in this module's layout; None if any frame has another."""
    head, scan = frame_head(), []
    for f in frames:
        if not f.startswith(head) or f[-2:] != b"\xff\xd9":
            return None
        raw = f[len(head) : -2]
        if len(raw) != BLOCKS * 74 - 2:
            raw = raw.replace(b"\xff\x00", b"\xff")
        if len(raw) != BLOCKS * 74 - 2:
            return None
        scan.append(raw + b"\xff\xd7")
    blocks = np.frombuffer(b"".join(scan), np.uint8).reshape(-1, 74)
    if (blocks[:, 72] != 0xFF).any():
        return None
    bits = np.unpackbits(np.ascontiguousarray(blocks[:, :72])).reshape(-1, 9)
    if bits[:, 0].any():
        return None
    return np.packbits(np.ascontiguousarray(bits[:, 1:])).reshape(len(frames), FRAME_BYTES)


def units_to_coefs(units: np.ndarray) -> np.ndarray:
    v = units.astype(np.int16)
    return np.where(v >= 128, v, v - 255)


def decode_frame(jpeg: bytes) -> np.ndarray:
    """Luma samples (height, width) of any baseline sequential JPEG with Huffman coding."""
    quant: dict[int, np.ndarray] = {}
    tables: dict[int, dict[tuple[int, int], int]] = {}
    comps, restart, at, h, w = {}, 0, 2, 0, 0
    while True:
        while jpeg[at] != 0xFF or jpeg[at + 1] in (0, 0xFF):
            at += 1
        marker, n = jpeg[at + 1], struct.unpack_from(">H", jpeg, at + 2)[0]
        body = jpeg[at + 4 : at + 2 + n]
        at += 2 + n
        if marker == 0xDB:
            while body:
                wide = body[0] >> 4
                quant[body[0] & 15] = np.frombuffer(body[1 : 65 + 64 * wide], ">u2" if wide else "u1").astype(np.int32)
                body = body[65 + 64 * wide :]
        elif marker in (0xC0, 0xC1):
            h, w = struct.unpack_from(">HH", body, 1)
            if not 0 < h * w <= MAX_PIXELS:
                raise ValueError("no frame size")
            comps = {body[6 + 3 * i]: (body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(body[5])}
        elif marker == 0xC4:
            while body:
                counts, code, k, table = body[1:17], 0, 17, {}
                for length, count in enumerate(counts, 1):
                    for _ in range(count):
                        table[length, code] = body[k]
                        code, k = code + 1, k + 1
                    code <<= 1
                tables[body[0]] = table
                body = body[k:]
        elif marker == 0xDD:
            restart = struct.unpack(">H", body)[0]
        elif marker == 0xDA:
            order = [(body[1 + 2 * i], body[2 + 2 * i] >> 4, 16 + (body[2 + 2 * i] & 15)) for i in range(body[0])]
            break
        elif 0xC2 <= marker <= 0xCF and marker not in (0xC8, 0xCC):
            raise ValueError("not a baseline JPEG")
    bits = iter(())

    def take_bits(raw: bytes) -> Iterator[int]:
        for byte in raw.replace(b"\xff\x00", b"\xff"):
            for s in range(7, -1, -1):
                yield byte >> s & 1
        while True:
            yield 1

    parts, k = [], at
    start = at
    while k < len(jpeg) - 1:  # cut the scan at its markers
        if jpeg[k] == 0xFF and jpeg[k + 1] != 0:
            parts.append(jpeg[start:k])
            start = k + 2
            if not 0xD0 <= jpeg[k + 1] <= 0xD7:
                break
            k += 1
        k += 1
    else:
        parts.append(jpeg[start:])

    def number(n: int) -> int:
        v = 0
        for _ in range(n):
            v = v << 1 | next(bits)
        return v

    def symbol(table: dict[tuple[int, int], int]) -> int:
        code = 0
        for length in range(1, 17):
            code = code << 1 | next(bits)
            if (length, code) in table:
                return table[length, code]
        raise ValueError("bad Huffman code")

    def extend(v: int, s: int) -> int:
        return v if not s or v >= 1 << (s - 1) else v - (1 << s) + 1

    hmax, vmax = max(c[0] for c in comps.values()), max(c[1] for c in comps.values())
    single = len(order) == 1
    luma = order[0][0]
    lh, lv = (1, 1) if single else comps[luma][:2]
    across = -(-w // (8 * (1 if single else hmax)))
    down = -(-h // (8 * (1 if single else vmax)))
    plane = np.zeros((down * lv * 8, across * lh * 8), np.uint8)
    last, part = dict.fromkeys(comps, 0), 0
    for mcu in range(across * down):
        if mcu == 0 or restart and mcu % restart == 0:
            bits, part = take_bits(parts[part] if part < len(parts) else b""), part + 1
            last = dict.fromkeys(comps, 0)
        for c, dc, ac in order:
            ch, cv = (1, 1) if single else comps[c][:2]
            for v in range(cv):
                for u in range(ch):
                    block = np.zeros(64, np.int32)
                    s = symbol(tables[dc])
                    last[c] += extend(number(s), s)
                    block[0] = last[c]
                    i = 1
                    while i < 64:
                        rs = symbol(tables[ac])
                        run, s = rs >> 4, rs & 15
                        if s == 0 and run < 15:
                            break
                        i += run
                        if s:
                            block[i] = extend(number(s), s)
                        i += 1
                    if c == luma:
                        y, x = (mcu // across * lv + v) * 8, (mcu % across * lh + u) * 8
                        plane[y : y + 8, x : x + 8] = pixels_of((block * quant[comps[c][2]])[None])[0]
    return plane[:h, :w]


def histograms(frames: list[bytes], units: np.ndarray | None) -> np.ndarray:
    """(frames, BINS) shares of luma."""
    if not frames:
        return np.zeros((0, BINS))
    if units is None:
        planes = [decode_frame(f) for f in frames]
        return np.array([np.bincount(p.ravel() >> 4, minlength=BINS) / max(1, p.size) for p in planes])
    shade = pixels_of(units_to_coefs(units).reshape(-1, 64)).reshape(len(frames), -1) >> 4
    key = shade.astype(np.int64) + np.arange(len(frames))[:, None] * BINS
    return np.bincount(key.ravel(), minlength=len(frames) * BINS).reshape(-1, BINS) / shade.shape[1]


def shots(hist: np.ndarray, floor: float = 0.05, sigmas: float = 3.0) -> list[tuple[int, int]]:
    """[first, end) frame ranges: a cut where the histogram difference exceeds what the current shot has shown."""
    if not len(hist):
        return []
    diff = np.abs(np.diff(hist, axis=0)).sum(axis=1) / 2
    cuts, n, total, squares = [0], 0, 0.0, 0.0
    for i, d in enumerate(diff.tolist(), 1):
        mean = total / n if n else 0.0
        spread = max(0.0, squares / n - mean * mean) ** 0.5 if n else 0.0
        if d > floor + mean + sigmas * spread:
            cuts.append(i)
            n, total, squares = 0, 0.0, 0.0
        else:
            n, total, squares = n + 1, total + d, squares + d * d
    return list(zip(cuts, [*cuts[1:], len(hist)]))


_STORE = "n_bytes long, media binary"


@dataclass
class Film:
    """What a media value holds: its frames, payload units where it has this module's layout, histograms and shots."""

    avi: Avi
    units: np.ndarray | None
    hist: np.ndarray
    parts: list[tuple[int, int]]


def open_film(data: bytes | None) -> tuple[Film | None, str | None]:
    """(film, None), or (None, reason)."""
    if data is None:
        return None, "null"
    if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        return None, "not an AVI file"
    try:
        avi = parse_avi(data)
        units = decode_own(avi.frames) if avi.frames else None
        hist = histograms(avi.frames, units)
        return Film(avi, units, hist, shots(hist)), None
    except (ValueError, LookupError, TypeError, ArithmeticError, struct.error) as e:
        return None, f"damaged: {type(e).__name__}"


def _each(df: DataFrame, col: str, keep: list[str], ddl: str, make) -> DataFrame:
    """Map rows to rows over Arrow batches: ``make(values)`` gives one list per new column."""
    narrow = tune(df).select(*keep, col)
    added = narrow.sparkSession.createDataFrame([], ddl).schema
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in narrow.schema.fields[:-1])
    types = [{"bigint": pa.int64(), "binary": pa.binary(), "string": pa.string()}[f.dataType.simpleString()] for f in added.fields]
    names = [*keep, *added.names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches_of(batches, 4):
            made = [pa.array(x, t) for x, t in zip(make(b.columns[-1]), types)]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *made], names=names)

    return narrow.mapInArrow(run, f"{kept}, {ddl}" if kept else ddl)


def store_texts(docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, n_bytes and ``media``: each text as an AVI file (zero bytes up to a positive multiple of 64)."""

    def make(col: pa.Array) -> list[list]:
        sizes, files = [], []
        for t in texts_of(col):
            sizes.append(len(t))
            payload = t + b"\0" * (-len(t) % UNIT if t else UNIT)
            files.append(write_avi(encode_frames(payload), len(payload)))
        return [sizes, files]

    return _each(docs, text_col, list(keep), _STORE, make)


def read_media(media: DataFrame, media_col: str = "media", keep: tuple[str, ...] = ("doc_id", "n_bytes")) -> DataFrame:
    """``keep`` columns, the payload's size, digests and features as read back from the stored bytes.

    feature: frames, shots as first-end ranges, and each shot's mean histogram in hex (one digit a bin, share * 15).
    reason: why there is no feature or payload, else null.
    """

    def row(m: bytes | None) -> tuple:
        film, reason = open_film(m)
        size, digest = (None, None) if m is None else (len(m), hashlib.sha256(m).hexdigest())
        if film is None:
            return None, None, None, size, digest, None, reason
        shade = ["".join(f"{int(x * 15 + 0.5):x}" for x in film.hist[a:b].mean(axis=0)) for a, b in film.parts]
        feature = f"frames={len(film.avi.frames)};us={film.avi.us_per_frame};" + ";".join(f"{a}-{b}:{s}" for (a, b), s in zip(film.parts, shade))
        if film.units is None or film.avi.size is None:
            return None, None, None, size, digest, feature, "no payload"
        payload = film.units.tobytes()[: film.avi.size]
        return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), size, digest, feature, None

    def make(col: pa.Array) -> list[list]:
        return list(map(list, zip(*(row(m) for m in col.to_pylist())))) or [[] for _ in range(7)]

    return _each(media, media_col, list(keep), "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, reason string", make)


_CLIPS = pa.schema([("key", pa.int64()), ("clip", pa.int64()), ("first_frame", pa.int64()), ("end_frame", pa.int64()), ("start_us", pa.int64()), ("end_us", pa.int64()), ("histogram", pa.list_(pa.float64()))])


def clips(media: DataFrame, media_col: str = "media", id_col: str = "doc_id") -> DataFrame:
    """One row per shot: (key, clip, first_frame, end_frame, start_us, end_us, histogram)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches_of(batches, 4):
            rows = []
            for key, m in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                film, _ = open_film(m)
                if film is None:
                    continue
                us = film.avi.us_per_frame
                rows += [(key, i, a, z, a * us, z * us, film.hist[a:z].mean(axis=0).tolist()) for i, (a, z) in enumerate(film.parts)]
            cols = list(zip(*rows)) or [()] * len(_CLIPS)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _CLIPS)], schema=_CLIPS)

    return media.select(media[id_col].cast("long").alias("key"), media_col).mapInArrow(run, "key long, clip long, first_frame long, end_frame long, start_us long, end_us long, histogram array<double>")
