"""Exact substring dedup: bytes covered by a string of ``LENGTH`` bytes that also starts in a document of a smaller id.

Sorting every suffix of the corpus would move LENGTH bytes for each byte. Instead suffixes are sorted where it matters:

1. Every window of LENGTH bytes has one anchor, the (leftmost) smallest hash among its grams of ``GRAM`` bytes: the same
   for equal windows, whatever surrounds them. The window starts that share an anchor form a run, and the run's context is
   the bytes its windows cover. Anchors go, by gram, to tasks that see which grams more than one document has: a run
   whose context equals that of a smaller document is covered as it stands; a run whose gram no other document has is
   not; the rest are open. About one anchor in 16 bytes travels, as 12 bytes.
2. Contexts of open runs go, by gram, to tasks that sort their suffixes deep-shallow: multikey quicksort on words of
   8 bytes to a shallow depth, then blind tries for small groups that are still tied, quicksort for large ones. Suffixes
   equal in their first LENGTH bytes are one string; starts in documents above its smallest are covered.
3. Covered intervals meet the texts again by id.

Tasks of step 1 and 2 take a share of gram hashes, their number growing with the bytes of the corpus.

Edge cases: null and empty texts, and texts under LENGTH bytes, lose nothing; matches never cross documents; a null id
is one id below all others; rows that repeat an id are the same document, so they take nothing from each other; an
empty table gives no rows; other columns are passed on, except that those named as the columns added are replaced.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import MULT, batches_of, cut, id_key, inverse_powers, mix64, positional, prefix_hash, span_hash, text_buffer, tune

LENGTH, GRAM = 50, 20
WINDOW = LENGTH - GRAM + 1
SHALLOW = 16  # bytes that quicksort alone looks at
BLIND = 64  # groups up to this size are ordered by a blind trie
TASK_BYTES = 12_000_000
NOTHING, COVERED, OPEN = 0, 1, 2


def runs(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, ...]:
    """(text, first start, last start, anchor, gram hash, context hash) of all runs of a buffer of texts, in order."""
    n = len(data)
    none = tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.int64, np.uint64, np.uint64))
    if n < LENGTH:
        return none
    h = prefix_hash(data)
    m = n - GRAM + 1
    gram = mix64((h[GRAM:] - h[:m]) * inverse_powers(n + 1)[:m])
    low = (gram & np.uint64(0xFFFFFFFF00000000)) | np.arange(m, dtype=np.uint64)
    span = 1
    while span * 2 <= WINDOW:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    rest = WINDOW - span
    low = np.minimum(low[: len(low) - rest], low[rest:]) if rest else low
    anchor = (low & np.uint64(0xFFFFFFFF)).astype(np.int64)  # of the window at each start, up to n - LENGTH
    del low
    valid = np.zeros(n + 1, np.int32)
    has = np.diff(off) >= LENGTH
    np.add.at(valid, off[:-1][has], 1)
    np.add.at(valid, off[1:][has] - LENGTH + 1, -1)
    valid = np.cumsum(valid[: len(anchor)]).astype(bool)
    change = np.ones(len(anchor), bool)
    change[1:] = (anchor[1:] != anchor[:-1]) | ~valid[:-1]
    s0 = np.flatnonzero(valid & change)
    if not len(s0):
        return none
    stop = np.ones(len(anchor), bool)
    stop[:-1] = (anchor[1:] != anchor[:-1]) | ~valid[1:]
    s1 = np.flatnonzero(valid & stop)
    a = anchor[s0]
    context = mix64(span_hash(h, s0, s1 + LENGTH) + (a - s0).astype(np.uint64) * MULT)
    return np.searchsorted(off, s0, side="right") - 1, s0, s1, a, gram[a], context


def _dealt(gram: np.ndarray, parts: int) -> np.ndarray:
    """The task of each gram, by bits that neither chose the anchor nor stand for it there."""
    return ((gram & np.uint64(0xFFFFFFFF)) % np.uint64(parts)).astype(np.int64)


def _share(parts: int):
    """Texts to (p, ids, counts, grams, contexts): the anchors of a batch that go to task p."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches_of(batches, 4):
            ids = b.column(0).to_numpy(zero_copy_only=False)
            doc, _, _, _, gram, context = runs(*text_buffer(b.column(1)))
            if not len(doc):
                continue
            p = _dealt(gram, parts)
            order = np.argsort(p, kind="stable")
            bounds = np.searchsorted(p[order], np.arange(parts + 1))
            g32 = (gram >> np.uint64(32)).astype(np.uint32)[order]
            doc, context = doc[order], context[order]
            out: list[list] = [[] for _ in range(5)]
            for k in np.flatnonzero(np.diff(bounds)).tolist():
                part = slice(bounds[k], bounds[k + 1])
                at = np.flatnonzero(np.diff(doc[part], prepend=-1))
                there = np.diff(np.append(at, part.stop - part.start))
                for o, v in zip(out, (k, ids[doc[part][at]].tobytes(), there.astype(np.uint32).tobytes(), g32[part].tobytes(), context[part].tobytes())):
                    o.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int32()), *(pa.array(o, pa.binary()) for o in out[1:])], names=["p", "ids", "counts", "grams", "contexts"])

    return run


def _firsts(*sorted_keys: np.ndarray) -> np.ndarray:
    """Places where any of the keys, sorted together, changes."""
    new = np.zeros(len(sorted_keys[0]), bool)
    new[:1] = True
    for k in sorted_keys:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


def _judge(pdf: pd.DataFrame) -> pd.DataFrame:
    """All anchors of task p to (d, p, codes): one code for each anchor of a document there, in order, if any is set."""
    read = lambda c, t: np.frombuffer(b"".join(pdf[c]), t)
    ids, counts = read("ids", np.int64), read("counts", np.uint32).astype(np.int64)
    gram, context = read("grams", np.uint32), read("contexts", np.uint64)
    did = np.repeat(ids, counts)
    order = np.lexsort((did, context, gram))
    g, c, d = gram[order], context[order], did[order]
    of_gram, of_context = _firsts(g), _firsts(g, c)
    size = np.diff(np.append(of_gram, len(g)))
    shared = np.repeat(np.minimum.reduceat(d, of_gram) != np.maximum.reduceat(d, of_gram), size)
    several = np.repeat(np.diff(np.searchsorted(of_context, np.append(of_gram, len(g)))) > 1, size)
    first = np.repeat(d[of_context], np.diff(np.append(of_context, len(g))))
    code = np.empty(len(g), np.uint8)
    code[order] = np.where(d > first, COVERED, np.where(shared & several, OPEN, NOTHING))
    at = np.concatenate([[0], np.cumsum(counts)])
    some = np.flatnonzero(np.add.reduceat(code, at[:-1], dtype=np.int64) > 0)
    raw = code.tobytes()
    return pd.DataFrame({"d": ids[some], "p": np.full(len(some), pdf["p"].iloc[0], np.int32), "codes": [raw[at[i] : at[i + 1]] for i in some]})


def _spans(s0: np.ndarray, s1: np.ndarray) -> bytes:
    return np.stack([s0, s1], axis=1).astype(np.int64).tobytes()


def _open(parts: int):
    """Texts with the codes of their anchors to rows of two kinds: (q null, d, covered intervals) of a document, and
    (q, null, meta, bytes): contexts of a batch for task q, meta holding (id, first start, number of starts) each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches_of(batches, 2):
            ids = b.column(0).to_numpy(zero_copy_only=False)
            data, off = text_buffer(b.column(1))
            doc, s0, s1, _, gram, _ = runs(data, off)
            if not len(doc):
                continue
            p = _dealt(gram, parts)
            order = np.lexsort((p, doc))  # stable: runs stay in order within (text, task)
            key = (doc * parts + p)[order]
            firsts = _firsts(key)
            col = b.column(2)
            entry_doc = np.repeat(np.arange(b.num_rows), np.diff(col.offsets.to_numpy()))
            inner = col.flatten()
            entry_key = entry_doc * parts + inner.field("p").to_numpy(zero_copy_only=False)
            where = np.searchsorted(key[firsts], entry_key)
            code, sizes = np.zeros(len(key), np.uint8), np.diff(np.append(firsts, len(key)))
            given = inner.field("codes").to_pylist()
            starts = firsts[where]
            lens = sizes[where]
            place = np.repeat(starts - np.concatenate([[0], np.cumsum(lens)[:-1]]), lens) + np.arange(int(lens.sum())) if len(lens) else np.zeros(0, np.int64)
            code[place] = np.frombuffer(b"".join(given), np.uint8)
            back = np.empty(len(key), np.uint8)
            back[order] = code
            q, d, meta, raw = [], [], [], []
            hit = np.flatnonzero(back == COVERED)
            cuts = np.searchsorted(doc[hit], np.arange(b.num_rows + 1))
            for i in np.flatnonzero(np.diff(cuts)).tolist():
                r = hit[cuts[i] : cuts[i + 1]]
                q.append(None), d.append(int(ids[i])), meta.append(_spans(s0[r] - off[i], s1[r] - off[i] + LENGTH)), raw.append(b"")
            hit = np.flatnonzero(back == OPEN)
            hit = hit[np.argsort(p[hit], kind="stable")]
            cuts = np.searchsorted(p[hit], np.arange(parts + 1))
            for k in np.flatnonzero(np.diff(cuts)).tolist():
                r = hit[cuts[k] : cuts[k + 1]]
                q.append(k), d.append(None)
                meta.append(np.stack([ids[doc[r]], s0[r] - off[doc[r]], s1[r] - s0[r] + 1], axis=1).astype(np.int64).tobytes())
                raw.append(b"".join([data[x : y + LENGTH].tobytes() for x, y in zip(s0[r].tolist(), s1[r].tolist())]))
            yield pa.RecordBatch.from_arrays([pa.array(q, pa.int32()), pa.array(d, pa.int64()), pa.array(meta, pa.binary()), pa.array(raw, pa.binary())], names=["q", "d", "meta", "raw"])

    return run


class BlindTrie:
    """Order of a few strings with long common prefixes: inner nodes keep only the depth and the branching bytes.

    A string is first led down by the branching bytes alone, then compared once with the leaf reached; the depth of the
    first difference says where on that path it belongs.
    """

    def __init__(self) -> None:
        self.root: list | None = None

    def insert(self, s: bytes, item: int) -> None:
        if self.root is None:
            self.root = [-1, s, [item]]
            return
        node = self.root
        while node[0] >= 0:
            node = node[1].get(s[node[0]]) or next(iter(node[1].values()))
        other = node[1]
        if other == s:
            node[2].append(item)
            return
        depth = next(i for i, (a, b) in enumerate(zip(s, other)) if a != b)
        above, node = None, self.root
        while 0 <= node[0] < depth:
            above, node = node, node[1][s[node[0]]]
        leaf = [-1, s, [item]]
        if node[0] == depth:
            node[1][s[depth]] = leaf
            return
        inner = [depth, {s[depth]: leaf, other[depth]: node}]
        if above is None:
            self.root = inner
        else:
            above[1][s[above[0]]] = inner

    def classes(self) -> Iterator[list[int]]:
        """Items of equal strings, in order of the strings."""
        stack = [self.root] if self.root is not None else []
        while stack:
            node = stack.pop()
            if node[0] < 0:
                yield node[2]
            else:
                stack.extend(node[1][c] for c in sorted(node[1], reverse=True))


def deep_shallow(buf: np.ndarray, pos: np.ndarray, did: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sort the suffixes at ``pos`` by their first LENGTH bytes: (order, class number of each in that order).

    Suffixes that no suffix of another document can equal are left out on the way. Equal classes are equal strings.
    """
    words = np.zeros(len(buf), np.uint64)
    padded = np.concatenate([buf, np.zeros(8, np.uint8)]).astype(np.uint64)
    for j in range(8):
        words = (words << np.uint64(8)) | padded[j : j + len(buf)]
    tail = np.uint64(0xFFFF << 48)  # of the last word, the 2 bytes up to LENGTH
    live, group = np.arange(len(pos)), np.zeros(len(pos), np.int64)
    done_items, done_class, base = [], [], 0
    depth = 0
    while len(live) and depth < LENGTH:
        key = words[pos[live] + depth]
        if depth + 8 > LENGTH:
            key = key & tail
        order = np.lexsort((key, group))
        live, key, group = live[order], key[order], group[order]
        first = _firsts(group, key)
        size = np.diff(np.append(first, len(live)))
        d = did[live]
        mixed = np.minimum.reduceat(d, first) != np.maximum.reduceat(d, first)
        group = np.repeat(np.arange(len(first)), size)
        keep = np.repeat(mixed, size)
        depth += 8
        if depth >= SHALLOW and depth < LENGTH:
            small = mixed & (size <= BLIND)
            for g in np.flatnonzero(small).tolist():
                trie = BlindTrie()
                for i in live[first[g] : first[g] + size[g]].tolist():
                    at = int(pos[i])
                    trie.insert(buf[at + depth : at + LENGTH].tobytes(), i)
                for items in trie.classes():
                    done_items.append(np.array(items))
                    done_class.append(np.full(len(items), base))
                    base += 1
            keep &= np.repeat(size > BLIND, size)
        live, group = live[keep], group[keep]
    if len(live):
        done_items.append(live)
        done_class.append(base + group)
    none = np.zeros(0, np.int64)
    return (np.concatenate(done_items), np.concatenate(done_class)) if done_items else (none, none)


def _sorted(pdf: pd.DataFrame) -> pd.DataFrame:
    """All contexts of task q to (d, covered intervals)."""
    meta = np.frombuffer(b"".join(pdf["meta"]), np.int64).reshape(-1, 3)
    buf = np.frombuffer(b"".join(pdf["raw"]), np.uint8)
    n = meta[:, 2]
    begin = np.concatenate([[0], np.cumsum(n + LENGTH - 1)[:-1]])
    which = np.repeat(np.arange(len(n)), n)
    step = np.arange(len(which)) - np.repeat(np.concatenate([[0], np.cumsum(n)[:-1]]), n)
    did = meta[which, 0]
    items, cls = deep_shallow(buf, begin[which] + step, did)
    order = np.argsort(cls, kind="stable")
    items, cls = items[order], cls[order]
    first = _firsts(cls) if len(cls) else np.zeros(0, np.int64)
    least = np.repeat(np.minimum.reduceat(did[items], first), np.diff(np.append(first, len(cls)))) if len(cls) else did[items]
    items = items[did[items] > least]
    d, at = did[items], meta[which[items], 1] + step[items]
    order = np.lexsort((at, d))
    d, at = d[order], at[order]
    out_d, out_s = [], []
    for i, j in zip(*(lambda f: (f.tolist(), [*f[1:].tolist(), len(d)]))(_firsts(d) if len(d) else np.zeros(0, np.int64))):
        s = np.unique(at[i:j])
        gap = np.flatnonzero(np.diff(s) > 1)
        out_d.append(int(d[i]))
        out_s.append(_spans(s[np.append(0, gap + 1)], s[np.append(gap, len(s) - 1)] + LENGTH))
    return pd.DataFrame({"d": np.array(out_d, np.int64), "spans": out_s})


def covered(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(d, spans): for documents that lose bytes, lists of intervals [from, to) as pairs of int64, overlaps included."""
    rows = tune(docs).select(id_key(F.col(id_col)).alias("d"), F.col(text_col).alias("x"))
    total = rows.agg(F.sum(F.octet_length("x"))).first()[0] or 0
    parts = max(24, math.ceil(total / TASK_BYTES))
    shared = rows.mapInArrow(_share(parts), "p int, ids binary, counts binary, grams binary, contexts binary")
    codes = shared.groupBy("p").applyInPandas(_judge, "d long, p int, codes binary").groupBy("d").agg(F.collect_list(F.struct("p", "codes")).alias("st"))
    known = rows.join(codes.hint("shuffle_hash"), "d").select("d", "x", "st")
    opened = cut(known.mapInArrow(_open(parts), "q int, d long, meta binary, raw binary"))
    found = opened.filter("q is not null").select("q", "meta", "raw").groupBy("q").applyInPandas(_sorted, "d long, spans binary")
    return opened.filter("q is null").select("d", F.col("meta").alias("spans")).unionByName(found).groupBy("d").agg(F.collect_list("spans").alias("spans"))


def _removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches_of(batches, 4):
        names = b.schema.names
        x, spans = b.column(names.index("__x")), b.column(names.index("__spans")).to_pylist()
        data, off = text_buffer(x)
        kept, n_removed, n_spans = [], [], []
        o = off.tolist()
        for i, s in enumerate(spans):
            text = data[o[i] : o[i + 1]]
            if not s:
                kept.append(text.tobytes()), n_removed.append(0), n_spans.append(0)
                continue
            pairs = np.frombuffer(b"".join(s), np.int64).reshape(-1, 2)
            edge = np.zeros(len(text) + 1, np.int32)
            np.add.at(edge, pairs[:, 0], 1)
            np.add.at(edge, pairs[:, 1], -1)
            gone = np.cumsum(edge[:-1]) > 0
            kept.append(text[~gone].tobytes())
            n_removed.append(int(gone.sum()))
            n_spans.append(int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()))
        rest = [n for n in names if n not in ("__x", "__spans")]
        made = [pa.array(np.diff(off)), pa.array(n_removed, pa.int64()), pa.array(n_spans, pa.int64()), pa.array(kept, pa.binary())]
        yield pa.RecordBatch.from_arrays([*(b.column(names.index(n)) for n in rest), *made], names=[*rest, "__n_bytes", "__n_removed", "__n_spans", "__kept"])


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the text, and __n_bytes, __n_removed, __n_spans and __kept: the bytes that stay, which may split
    a character where a repeat begins or ends within one."""
    spans = covered(docs, id_col, text_col).select(F.col("d").alias("__d"), F.col("spans").alias("__spans"))
    added = ["__n_bytes", "__n_removed", "__n_spans", "__kept"]
    docs = docs.drop(*added)
    key, text = (f"c{docs.columns.index(c)}" for c in (id_col, text_col))
    keyed = positional(docs).withColumn("__d", id_key(F.col(key))).withColumnRenamed(text, "__x")
    both = keyed.join(spans.hint("shuffle_hash"), "__d", "left").drop("__d")
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in both.schema.fields if f.name not in ("__x", "__spans"))
    made = both.mapInArrow(_removed, f"{ddl}, __n_bytes long, __n_removed long, __n_spans long, __kept binary")
    return made.toDF(*[c for c in docs.columns if c != text_col], *added)
