"""Line dedup: hashed lines range-partitioned and sorted by document and position, streamed once.

Plan: every text is split into lines; lines of enough code points become (hash, document, position) rows. The rows
are dealt by *range* of (hash, document descending), so one hot line spreads over as many tasks as its rows need, and
are sorted within tasks. A task streams its runs: the first document of a run is the keeper (the largest id) and loses
nothing, the others lose the line once the run has seen ``min_docs`` documents. Only a task's first and last run can go
on in its neighbours; rows of these two are left open and settled by a join with one summary row per task edge (two a
task). So are those of a run that would have a task hold more than ``HELD`` rows: few documents that repeat a line often.
The result is one compressed keep bitmap per document that loses lines; texts never travel with the hashes.

Edge cases: a null or empty text is one empty line; a null id counts as one id below all others; rows that repeat an
id count as one document of that id, each keeping its own bitmap (keyed by the text's hash as well); an empty table
gives no rows. Other columns are not read by :func:`line_bitmaps`; :func:`keep_lines` passes them on whatever their names,
except that those named as the columns it adds are replaced.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches_of, cut, id_key, positional, texts_of, tune

#: Rows of one run that a task holds before it knows the number of documents.
HELD = 10_000
BLANK = b" \t\n\x0b\x0c\r"
_LINES = pa.schema([("h1", pa.int64()), ("h2", pa.int64()), ("d", pa.int64()), ("t", pa.int64()), ("pos", pa.int32()), ("nl", pa.int32())])
_SEEN = pa.schema([("kind", pa.int8()), ("h1", pa.int64()), ("h2", pa.int64()), ("d", pa.int64()), ("t", pa.int64()), ("pos", pa.int32()), ("nl", pa.int32()), ("n", pa.int64())])


def _hashed_lines(min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches_of(batches, 4):
            d, t = b.column(0).to_pylist(), b.column(1).to_pylist()
            digests, ds, ts, pos, nls = [], [], [], [], []
            for di, ti, text in zip(d, t, texts_of(b.column(2))):
                lines = text.split(b"\n")
                for i, line in enumerate(lines):
                    if len(line) < min_chars:  # bytes >= code points
                        continue
                    key = line.strip(BLANK).lower()  # bytes: A-Z only
                    if len(key) < min_chars or (not key.isascii() and len(key.decode()) < min_chars):
                        continue
                    digests.append(hashlib.blake2b(key, digest_size=16).digest())
                    ds.append(di), ts.append(ti), pos.append(i), nls.append(len(lines))
            h = np.frombuffer(b"".join(digests), dtype=np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(h[:, 0]), pa.array(h[:, 1]), pa.array(ds, pa.int64()), pa.array(ts, pa.int64()), pa.array(pos, pa.int32()), pa.array(nls, pa.int32())], schema=_LINES)

    return run


def _stream(min_docs: int, hold: int = HELD):
    """Sorted rows in, decisions out. kind 0: dropped; 1: open; 2: summary of an open run (n documents, d the largest)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        held: list[tuple] = []
        key = keeper = last = None
        docs, first_run, open_run = 0, True, True

        def flush():
            cols = list(zip(*out)) or [()] * 8
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _SEEN)], schema=_SEEN)

        def close(at_end: bool) -> None:
            if key is None:
                return
            if at_end or open_run:
                out.extend((1, *r, 0) for r in held)
                out.append((2, *key, keeper, 0, 0, 0, docs))
            held.clear()

        for b in batches:
            for h1, h2, d, t, pos, nl in zip(*(c.to_pylist() for c in b.columns)):
                if (h1, h2) != key:
                    if key is not None:
                        close(False)
                        first_run = False
                    key, keeper, last, docs, open_run = (h1, h2), d, d, 1, first_run
                elif d != last:
                    last, docs = d, docs + 1
                row = (h1, h2, d, t, pos, nl)
                if first_run:  # may go on from the task before: nothing is known yet
                    out.append((1, *row, 0))
                elif d == keeper:
                    continue
                elif docs >= min_docs:
                    out.extend((0, *r, 0) for r in held)
                    held.clear()
                    out.append((0, *row, 0))
                else:
                    held.append(row)
                    if len(held) >= hold:
                        open_run = True
                        out.extend((1, *r, 0) for r in held)
                        held.clear()
                if len(out) >= 20000:
                    yield flush()
        close(True)
        yield flush()

    return run


def line_bitmaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 40, min_docs: int = 5, hold: int = HELD) -> DataFrame:
    """One row per document that loses lines: (d, t, n_lines, n_dropped, keep), ``keep`` a zlib-packed bitmap, bit i for line i.

    ``d`` is the id with null as the smallest bigint, ``t`` is xxhash64 of the text: together the key for :func:`keep_lines`.
    """
    rows = tune(docs).select(id_key(F.col(id_col)).alias("d"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("t"), F.col(text_col).alias("x"))
    lines = rows.mapInArrow(_hashed_lines(min_chars), "h1 long, h2 long, d long, t long, pos int, nl int")
    dealt = lines.repartitionByRange("h1", "h2", F.desc("d")).sortWithinPartitions("h1", "h2", F.desc("d"), "t", "pos")
    seen = cut(dealt.mapInArrow(_stream(min_docs, hold), "kind byte, h1 long, h2 long, d long, t long, pos int, nl int, n long"))
    # one row for each open run: two a task, and one for every ``hold`` rows at most; Spark broadcasts it by its size
    edges = seen.filter("kind = 2").groupBy("h1", "h2").agg(F.sum("n").alias("docs"), F.max("d").alias("keeper"))
    opened = seen.filter("kind = 1").join(edges.filter(F.col("docs") >= min_docs), ["h1", "h2"]).filter("d < keeper")
    gone = seen.filter("kind = 0").select("d", "t", "pos", "nl").unionByName(opened.select("d", "t", "pos", "nl"))
    each = gone.groupBy("d", "t").agg(F.max("nl").alias("n_lines"), F.collect_set("pos").alias("p"))
    return each.mapInArrow(_packed, "d long, t long, n_lines int, n_dropped int, keep binary")


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        nl, keeps, gone = b.column(2).to_pylist(), [], []
        for n, p in zip(nl, b.column(3).to_pylist()):
            mask = np.ones(n, np.uint8)
            mask[p] = 0
            keeps.append(zlib.compress(np.packbits(mask, bitorder="little").tobytes(), 1))
            gone.append(len(p))
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(nl, pa.int32()), pa.array(gone, pa.int32()), pa.array(keeps, pa.binary())], names=["d", "t", "n_lines", "n_dropped", "keep"])


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches_of(batches, 4):
        names = b.schema.names
        x, k = b.column(names.index("__text")), b.column(names.index("__keep")).to_pylist()
        kept, n_lines, n_dropped = [], [], []
        for text, keep in zip(texts_of(x), k):
            lines = text.split(b"\n")
            n_lines.append(len(lines))
            if keep is not None:
                mask = np.unpackbits(np.frombuffer(zlib.decompress(keep), np.uint8), bitorder="little", count=len(lines))
                lines = [lines[i] for i in np.flatnonzero(mask)]
                text = b"\n".join(lines)
            kept.append(text)
            n_dropped.append(n_lines[-1] - len(lines))
        made = {"__kept": pa.array(kept, pa.binary()).cast(pa.string()), "__n_lines": pa.array(n_lines, pa.int64()), "__n_dropped": pa.array(n_dropped, pa.int64())}
        rest = [n for n in names if n not in ("__text", "__keep")]
        yield pa.RecordBatch.from_arrays([*(b.column(names.index(n)) for n in rest), *made.values()], names=[*rest, *made])


def keep_lines(docs: DataFrame, bitmaps: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the dropped lines: its columns but the text, then __kept, __n_lines, __n_dropped."""
    docs = docs.drop("__kept", "__n_lines", "__n_dropped")
    names, inner = [c for c in docs.columns if c != text_col], positional(docs)
    key, text = (f"c{docs.columns.index(c)}" for c in (id_col, text_col))
    maps = bitmaps.select(F.col("d").alias("__d"), F.col("t").alias("__t"), F.col("keep").alias("__keep"))
    keyed = inner.withColumn("__d", id_key(F.col(key))).withColumn("__t", F.xxhash64(F.coalesce(F.col(text), F.lit("")))).withColumnRenamed(text, "__text")
    both = keyed.join(maps.hint("shuffle_hash"), ["__d", "__t"], "left").drop("__d", "__t")
    schema = [f for f in both.schema.fields if f.name not in ("__text", "__keep")]
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    made = both.mapInArrow(_kept, (ddl + ", " if ddl else "") + "__kept string, __n_lines long, __n_dropped long")
    return made.toDF(*names, "__kept", "__n_lines", "__n_dropped")


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """``docs`` with its own columns and order of columns, each text cut to the lines that stay."""
    inner = positional(docs)
    key, text = (f"c{docs.columns.index(c)}" for c in (id_col, text_col))
    kept = keep_lines(inner, line_bitmaps(inner, key, text, min_chars, min_docs), key, text)
    return kept.select(*["__kept" if c == text else c for c in inner.columns]).toDF(*docs.columns)
