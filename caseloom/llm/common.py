"""Shared plumbing: Arrow text buffers as numpy arrays, byte kernels, durable lineage cuts."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Internal id of rows whose id is null: sorts below every real id.
NULL_ID = -(2**63)
#: Low 32 bits of a row key hold the row's place in its input partition.
MULT = np.uint64(0x9E3779B97F4A7C15)


#: Folders written by :func:`cut` in this process.
_CUTS: list[tuple[SparkSession, str]] = []
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Where that is unset, a folder under the warehouse serves a
    session of one machine; on a cluster it is an error, since other executors may not see the warehouse."""
    given = spark.conf.get("spark.checkpoint.dir", None)
    if not given and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return (given or spark.conf.get("spark.sql.warehouse.dir") + "/_caseloom").rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: lineage ends, any executor may be lost.

    The shuffle files of the write are deleted as it ends, for nothing else reads them. The folder goes with
    :func:`drop_cut`, or at the end of the driver's process.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/cut-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEAN, None)
    spark.conf.set(_CLEAN, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(_CLEAN) if before is None else spark.conf.set(_CLEAN, before)
    if not _CUTS:
        atexit.register(_drop_all)
    _CUTS.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(where, True)


def drop_cut(df: DataFrame) -> None:
    """Delete the files behind :func:`cut` once no plan reads them."""
    for f in df.inputFiles()[:1]:
        name = f.rsplit("/", 1)[0].rsplit("/", 1)[-1]
        for known in [c for c in _CUTS if c[1].endswith(name)]:
            _delete(*known)
            _CUTS.remove(known)


def _drop_all() -> None:
    for spark, path in _CUTS:
        if spark.sparkContext._jsc is None:  # stopped
            continue
        with contextlib.suppress(Exception):  # the driver is ending; what is left is left
            _delete(spark, path)


def tune(df: DataFrame) -> DataFrame:
    """Rows here are whole texts: let Arrow batches hold 1,000 of them, not the session's default of 10,000."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(df.sparkSession.conf.get(name)) == 10_000:
        df.sparkSession.conf.set(name, "1000")
    return df


def positional(df: DataFrame, *drop: str) -> DataFrame:
    """``df`` without ``drop``, its columns named c0, c1 and so on: names of the caller's cannot clash with an operator's."""
    df = df.drop(*drop)
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))])


def id_key(c: Column) -> Column:
    """bigint id with nulls replaced by the smallest value."""
    return F.coalesce(c.cast("bigint"), F.lit(NULL_ID))


def text_buffer(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; nulls become empty texts. No copy where Arrow allows."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("")
    if not pa.types.is_large_string(col.type):
        col = col.cast(pa.large_string())
    n = len(col)
    off = np.frombuffer(col.buffers()[1], dtype=np.int64)[col.offset : col.offset + n + 1]
    raw = col.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    return (data[off[0] : off[-1]] if n else data[:0]), off - (off[0] if n else 0)


def texts_of(col: pa.Array) -> list[bytes]:
    """The texts as UTF-8, nulls as b''."""
    data, off = text_buffer(col)
    raw = data.tobytes()
    o = off.tolist()
    return [raw[a:b] for a, b in zip(o, o[1:])]


def mix64(h: np.ndarray) -> np.ndarray:
    """Finalizer of a 64-bit hash, in place where possible."""
    h = h ^ (h >> np.uint64(33))
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(32)
    return h


_BASE = 0x5851F42D4C957F2D


def _grown(p: np.ndarray, base: int, n: int) -> np.ndarray:
    """``p``, grown by doubling to at least n powers of ``base`` modulo 2**64."""
    while len(p) < n:
        p = np.concatenate([p, p * np.uint64(pow(base, len(p), 1 << 64))])  # base**(i + len) = base**i * base**len
    return p


_powers = _inverse = np.ones(1, np.uint64)


def powers(n: int) -> np.ndarray:
    """P**0 to P**(n - 1) and beyond, one table per process."""
    global _powers
    _powers = _grown(_powers, _BASE, n)
    return _powers


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """H[i] = sum over j < i of (data[j] + 1) * P**j, so that a span's hash is (H[e] - H[s]) * P**(N - s)."""
    h = np.empty(len(data) + 1, np.uint64)
    h[0] = 0
    np.multiply(data.astype(np.uint64) + np.uint64(1), powers(len(data) + 1)[: len(data)], out=h[1:])
    np.cumsum(h[1:], out=h[1:])
    return h


def inverse_powers(n: int) -> np.ndarray:
    """P**-0 to P**-(n - 1) and beyond."""
    global _inverse
    _inverse = _grown(_inverse, pow(_BASE, -1, 1 << 64), n)
    return _inverse


def span_hash(h: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """Mixed 64-bit hash of data[s:e] for arrays of spans; depends on the content and length alone."""
    out = (h[e] - h[s]) * inverse_powers(len(h))[s]
    return mix64(out + (e - s).astype(np.uint64) * MULT)


#: A-Z to a-z, and the six ASCII spaces to 0x20.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True


def words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text number of every ``[^\\x20\\x09-\\x0D]+`` in a buffer of texts."""
    n = len(data)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, z
    ink = ~SPACE[data]
    begin = ink.copy()
    begin[1:] &= ~ink[:-1]
    cuts = off[1:-1]
    cuts = cuts[cuts < n]
    begin[cuts] = ink[cuts]
    stop = ink.copy()
    stop[:-1] &= ~ink[1:]
    ends = cuts[cuts > 0] - 1
    stop[ends] = ink[ends]
    s, e = np.flatnonzero(begin), np.flatnonzero(stop) + 1
    return s, e, np.searchsorted(off, s, side="right") - 1


def tidy() -> None:
    """Give freed memory back: Spark reuses a worker for later tasks, where it would count beside theirs."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library
        ctypes.CDLL(None).malloc_trim(0)


def batches_of(it, mb: float):
    """Cut Arrow batches so that none holds much more than ``mb`` MB (a single longer row stays whole); tidy at the end."""
    for b in it:
        step = max(1, int(b.num_rows * mb * 1e6 / max(1, b.nbytes)))
        for i in range(0, b.num_rows, step):
            yield b.slice(i, step)
    tidy()
