"""MinHash near-duplicate detection with sequential Bayesian verification.

1. Rows of one shingle set form a class: copies are linked by the class and never meet in pairs. Sets are the same if a
   128-bit BLAKE2 digest of the whole set, its shingles in order, is; a class is a node of its own, named by a hash of
   that digest, and document ids play no part until components are named.
2. Classes get ``bands * rows`` minhashes of their shingles, 16 bits each; equal bands make candidates. Every bucket is
   reduced to its smallest node with partial aggregation, and its members are compared with that pivot only: a bucket of
   m members gives m - 1 pairs, not m squared.
3. A pair's signatures are compared in batches of ``rows`` hashes. Under a uniform prior on similarity the posterior
   after m of n agreements is Beta(m + 1, n - m + 1); a pair is pruned as soon as the chance that its similarity
   reaches the threshold is below ``miss``. Survivors are verified exactly on their full shingle sets.
4. Confirmed links give components. A bucket whose members are then still in several takes new pivots, another one in each
   bucket and round, for the members of other components than the pivot's: still m - 1 pairs at most.
5. In buckets that stay open, members outside the largest component meet, in blocks and inside workers, every member of
   another component: once by signatures alone, which says who has a partner left at all, and then those, pruned and
   verified as above, on the spot, with their texts, compressed until they are read. Two nodes that share several buckets
   meet in that of their first common band alone. So no link between candidates is lost, no pairs are written, groups
   that pivots have joined cost nothing more, and texts travel only where signatures allow a link.

Banding misses a pair of similarity 0.8 with chance (1 - 0.8**5)**32 < 4e-6, and pruning one with chance ``miss`` a
batch at most. There is no cap on buckets, partners or candidates. Signatures and texts meet by joins on nodes; a bitmap of
fixed size keeps most texts that nobody asked for from moving at all.

Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased; a document with fewer words than a shingle has its whole sequence
as one shingle. Edge cases: null or empty texts, and texts without words, have no shingles and link with nothing, not
even each other; a null id is one id below all others; rows that repeat an id are rows of one document if their texts
give the same set, else each links on its own and they share the id's component; an empty table gives no rows; other
columns are not read, and :func:`drop_near_duplicates` passes them on whatever their names.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import LOWER, batches_of, cut, drop_cut, id_key, mix64, positional, prefix_hash, span_hash, text_buffer, texts_of, tune, words

BANDS, ROWS = 32, 5
BLOCK = 512
#: Rounds of new pivots for open buckets.
PIVOT_ROUNDS = 1
#: Longs of the bitmap that says which texts are wanted: 2**24 bits, broadcast as rows (word, bits).
FILTER_WORDS = 2**18
#: Rounds after which stars that still move are an error; they settle in about the logarithm of the longest chain.
MAX_ROUNDS = 64


def shingle_hashes(data: np.ndarray, off: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text number) of all k-word shingles of a buffer of texts, in order; shorter texts give their sequence."""
    low = LOWER[data]
    s, e, d = words(low, off)
    h = span_hash(prefix_hash(low), s, e)
    n = len(h)
    if not n:
        return h, d
    count = np.bincount(d, minlength=len(off) - 1)
    first = np.concatenate([[0], np.cumsum(count)])
    out = h.copy()
    for j in range(1, k):
        nxt = np.zeros(n, np.uint64)
        nxt[: n - j] = h[j:]
        inside = np.arange(n) + j < first[d + 1]
        out = np.where(inside, out * np.uint64(0x9E3779B97F4A7C15) + nxt * np.uint64(2 * j + 1), out)
    place = np.arange(n) - first[d]
    keep = (place + k <= count[d]) | (place == 0)  # the first position stands for a short text's whole sequence
    return mix64(out[keep]), d[keep]


def shingle_set(text: bytes, k: int) -> set[bytes]:
    """The shingles themselves, for exact verification."""
    w = text.lower().split()  # bytes: A-Z, and the six ASCII spaces
    if not w:
        return set()
    return {b" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))}


def set_digest(text: bytes, k: int, first: np.ndarray) -> bytes:
    """16 bytes that stand for the whole set, read at the ``first`` places of its shingles in an order that depends on the
    shingles alone; they hold no line end, so the joint text is the set's own."""
    w = text.lower().split()
    return hashlib.blake2b(b"\n".join([b" ".join(w[i : i + k]) for i in first.tolist()]), digest_size=16).digest()


def similar(a: set, b: set, percent: int) -> bool:
    both = len(a & b)
    return 100 * both >= percent * (len(a) + len(b) - both) and both > 0


def _permutations() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.RandomState(20240607)
    n = BANDS * ROWS
    return rng.randint(0, 2**32, n, dtype=np.uint64).astype(np.uint32) | np.uint32(1), rng.randint(0, 2**32, n, dtype=np.uint64).astype(np.uint32)


def signature(h: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Minhashes of one set: min over its members of (a * x + b) mod 2**32, in chunks of bounded size; of each the low 16
    bits, as unlike hashes agree in these once in 65,536 times only."""
    x, out = (h >> np.uint64(32)).astype(np.uint32) ^ h.astype(np.uint32), None
    for i in range(0, len(x), 1024):
        m = (a[:, None] * x[None, i : i + 1024] + b[:, None]).min(axis=1)
        out = m if out is None else np.minimum(out, m)
    return out.astype(np.uint16)


def _sketch(k: int):
    """(d, t, digest of the set in two longs, number of shingles, signature): one pass over the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = _permutations()
        for batch in batches_of(batches, 2):
            data, off = text_buffer(batch.column(2))
            h, d = shingle_hashes(data, off, k)
            n = batch.num_rows
            cuts = np.searchsorted(d, np.arange(n + 1))
            raw, o = data.tobytes(), off.tolist()
            sizes, digests, sigs = np.zeros(n, np.int64), [], []
            for i in range(n):
                u, first = np.unique(h[cuts[i] : cuts[i + 1]], return_index=True)
                sizes[i] = len(u)
                if len(u):
                    digests.append(set_digest(raw[o[i] : o[i + 1]], k, first))
                    sigs.append(signature(u, a, b).tobytes())
                else:
                    digests.append(bytes(16))
                    sigs.append(b"")
            s = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(s[:, 0]), pa.array(s[:, 1]), pa.array(sizes), pa.array(sigs, pa.binary())], names=["d", "t", "s1", "s2", "n", "sig"])

    return run


def _band_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    salt = np.arange(BANDS, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    for b in batches_of(batches, 4):
        if not b.num_rows:
            continue
        sig = np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint16).reshape(-1, BANDS, ROWS).astype(np.uint64)
        key = np.zeros(sig.shape[:2], np.uint64) + salt
        for j in range(ROWS):
            key = mix64(key ^ sig[:, :, j]) * np.uint64(0x9E3779B97F4A7C15)
        # the band is the key's remainder, so that buckets of two bands never fall together
        key = key // np.uint64(BANDS) * np.uint64(BANDS) + np.arange(BANDS, dtype=np.uint64)
        ids = np.repeat(b.column(0).to_numpy(), BANDS)
        yield pa.RecordBatch.from_arrays([pa.array(key.ravel().view(np.int64)), pa.array(ids)], names=["key", "d"])


def least_matches(percent: int, miss: float) -> np.ndarray:
    """least[i]: agreements needed after i + 1 batches for P(similarity >= percent) >= miss under Beta posteriors."""
    t, least = percent / 100, []
    for i in range(1, BANDS + 1):
        n = i * ROWS

        def tail(m: int, n: int = n) -> float:
            # P(Beta(m + 1, n - m + 1) >= t) = P(Binomial(n + 1, t) <= m)
            return sum(math.comb(n + 1, j) * t**j * (1 - t) ** (n + 1 - j) for j in range(m + 1))

        least.append(next(m for m in range(n + 1) if tail(m) >= miss))
    return np.array(least)


def survive(a: np.ndarray, b: np.ndarray, least: np.ndarray) -> np.ndarray:
    """Row-wise sequential test of signature pairs: indices that no batch prunes."""
    alive, got = np.arange(len(a)), np.zeros(len(a), np.int64)
    for i, need in enumerate(least):
        if not len(alive):
            break
        part = slice(i * ROWS, (i + 1) * ROWS)
        got = got + (a[alive, part] == b[alive, part]).sum(axis=1)
        ok = got >= need
        alive, got = alive[ok], got[ok]
    return alive


def first_met(sig: np.ndarray, i: int, j: np.ndarray, key: int) -> np.ndarray:
    """Those of ``j`` whose first band in common with ``i`` is that of the bucket ``key``."""
    band = key % BANDS
    same = (sig[j, : band * ROWS] == sig[i, : band * ROWS]).reshape(len(j), band, ROWS).all(axis=2)
    return j[~same.any(axis=1)]


def _prune(least: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint16).reshape(b.num_rows, -1) for c in (2, 3))
            at = pa.array(survive(x, y, least))
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at)], names=["a", "b"])

    return run


def _verify(k: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[int, set] = {}
        for batch in batches_of(batches, 2):
            a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            left, right = batch.column(2), batch.column(3)
            ok, unpack = [], zstandard.ZstdDecompressor().decompress
            for i, pivot in enumerate(a):
                if pivot not in kept:
                    kept = {pivot: shingle_set(unpack(left[i].as_py()), k)}  # rows come grouped by pivot mostly
                ok.append(similar(kept[pivot], shingle_set(unpack(right[i].as_py()), k), percent))
            at = pa.array(np.flatnonzero(ok))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()).take(at), pa.array(b, pa.int64()).take(at)], names=["a", "b"])

    return run


def _sides(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(rows of the left block, of the right one, signatures, components as numbers); a block alone is both sides."""
    left, right = (np.flatnonzero(pdf.side.to_numpy() == i) for i in (0, 1))
    sig = np.frombuffer(b"".join(pdf.sig), np.uint16).reshape(len(pdf), -1)
    _, comp = np.unique(pdf.comp.to_numpy(), return_inverse=True)
    return left, right, sig, comp


def _hopeful(least: np.ndarray):
    """Members of one bucket's block pair that the sequential test leaves a partner of another component: (key, d)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        left, right, sig, comp = _sides(pdf)
        key = int(pdf.key.iloc[0])
        has = np.zeros(len(pdf), bool)
        for at, i in enumerate(left.tolist()):
            j = right if len(right) else left[at + 1 :]
            j = j[(comp[j] != comp[i]) & ~(has[i] & has[j])]
            j = j[survive(np.broadcast_to(sig[i], (len(j), sig.shape[1])), sig[j], least)] if len(j) else j
            j = first_met(sig, i, j, key)
            if len(j):
                has[i] = True
                has[j] = True
        return pdf.loc[has, ["key", "d"]]

    return run


def _dealt(members: DataFrame) -> DataFrame:
    """(key, d, comp) of open buckets to (key, d, comp, p, q, side): blocks of about BLOCK members outside a bucket's largest
    component, each with itself, with each later one, and with the largest component's members, which are dealt in
    blocks too, but never with each other."""
    sizes = members.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("n"))
    of = sizes.groupBy("key").agg(F.max(F.struct("n", "comp")).alias("top"), F.sum("n").alias("all")).select("key", F.col("top.comp").alias("main"), F.ceil((F.col("all") - F.col("top.n")) / BLOCK).cast("int").alias("few"), F.ceil(F.col("top.n") / BLOCK).cast("int").alias("many"))
    placed = members.join(of, "key").withColumn("h", F.xxhash64("d", F.lit(2)))
    own = F.pmod(F.col("h"), F.col("few")).cast("int")
    # block i as the left side of (i, j >= i) and the right side of (j < i, i); then as the left side of all main blocks
    small = placed.filter("comp <> main").select("key", "d", "comp", own.alias("i"), F.explode(F.sequence(F.lit(0), F.col("few") + F.col("many") - 1)).alias("j"))
    small = small.select("key", "d", "comp", F.least("i", "j").alias("p"), F.greatest("i", "j").alias("q"), F.when(F.col("i") <= F.col("j"), 0).otherwise(1).alias("side"))
    main = placed.filter("comp = main").select("key", "d", "comp", F.explode(F.sequence(F.lit(0), F.col("few") - 1)).alias("p"), (F.col("few") + F.pmod(F.col("h"), F.col("many"))).cast("int").alias("q"), F.lit(1).alias("side"))
    return small.unionByName(main)


def _blocks(least: np.ndarray, k: int, percent: int):
    """Members of one bucket's block pair: links between components, tested in sequence and then on the full sets.

    Components that a link joins here count as one from then on, so at most one link fewer than components comes out.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        left, right, sig, comp = _sides(pdf)
        d, texts, key = pdf.d.to_numpy(), pdf.x.tolist(), int(pdf.key.iloc[0])
        unpack = zstandard.ZstdDecompressor().decompress
        vocabulary: dict[bytes, int] = {}
        sets: dict[int, np.ndarray] = {}

        def members(i: int) -> np.ndarray:
            if i not in sets:
                found = shingle_set(unpack(texts[i]), k)
                sets[i] = np.array([vocabulary.setdefault(g, len(vocabulary)) for g in found], np.int64)
            return sets[i]

        out = []
        for at, i in enumerate(left.tolist()):
            j = right if len(right) else left[at + 1 :]
            j = j[comp[j] != comp[i]]
            j = j[survive(np.broadcast_to(sig[i], (len(j), sig.shape[1])), sig[j], least)] if len(j) else j
            j = first_met(sig, i, j, key)
            if not len(j):
                continue
            own = members(i)
            theirs = [members(x) for x in j.tolist()]
            mark = np.zeros(len(vocabulary), bool)
            mark[own] = True
            size = np.array([len(t) for t in theirs])
            both = np.add.reduceat(mark[np.concatenate(theirs)], np.concatenate([[0], np.cumsum(size)[:-1]]), dtype=np.int64)
            for x in j[100 * both >= percent * (len(own) + size - both)].tolist():
                if comp[x] != comp[i]:
                    out.append((min(d[i], d[x]), max(d[i], d[x])))
                    comp[comp == comp[x]] = comp[i]
        pairs = np.array(out, np.int64).reshape(-1, 2)
        return pd.DataFrame({"a": pairs[:, 0], "b": pairs[:, 1]})

    return run


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(d, comp) for every node: the smallest node reachable over edges (a, b). Alternating large and small stars.

    Both star steps are partial aggregations followed by joins, so a hot node's neighbours stay spread; every round is
    written to the shared folder.
    """
    e = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())
    for _ in range(MAX_ROUNDS):
        # large star: every neighbour above u points to the least of u and its neighbours
        both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        # small star: u and its neighbours below point to the least of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        new = cut(small.filter("u <> v").distinct())
        same = new.count() == e.count() and new.join(e, ["u", "v"], "left_anti").isEmpty()
        drop_cut(e)
        e = new
        if same:
            return nodes.join(e.select(F.col("u").alias("d"), F.col("v").alias("comp")), "d", "left").select("d", F.coalesce("comp", "d").alias("comp"))
    raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    pack = zstandard.ZstdCompressor().compress
    for b in batches_of(batches, 2):
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([pack(t) for t in texts_of(b.column(2))], pa.binary())], names=["id", "t", "x"])


def _perhaps(rows: DataFrame, wanted: DataFrame, on: list[str]) -> DataFrame:
    """``rows`` without most of those whose keys ``on`` are not in ``wanted``, and with all of those whose are.

    Hashed keys are bits of at most FILTER_WORDS longs, so what is broadcast has that many rows at any size of the data.
    Beyond about as many keys as bits, more other rows pass; an exact join has to follow.
    """
    hashed = lambda df: df.withColumn("__h", F.xxhash64(*on, F.lit(3)))
    word = F.pmod(F.shiftrightunsigned("__h", 6), F.lit(FILTER_WORDS)).alias("__word")
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("__h").bitwiseAND(63).cast("int"))
    bits = hashed(wanted).select(word, bit.alias("__bit")).groupBy("__word").agg(F.bit_or("__bit").alias("__bits"))
    placed = hashed(rows).select(*rows.columns, word, bit.alias("__bit"))
    return placed.join(F.broadcast(bits), "__word").filter(F.col("__bits").bitwiseAND(F.col("__bit")) != 0).select(*rows.columns)


def _bodies(texts: DataFrame, sigs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(d, x): a text of each of ``nodes`` (distinct d), compressed, written out. Other texts mostly do not move."""
    wanted = cut(sigs.select("d", "id", "t").join(nodes, "d"))
    packed = _perhaps(texts.select("id", "t", "x"), wanted, ["id", "t"]).mapInArrow(_packed, "id long, t long, x binary")
    bodies = cut(packed.join(wanted, ["id", "t"]).select("d", "x").dropDuplicates(["d"]))
    drop_cut(wanted)
    return bodies


def _confirm(pairs: DataFrame, sigs: DataFrame, texts: DataFrame, least: np.ndarray, k: int, percent: int) -> DataFrame:
    """Pairs (a, b) that pass the sequential test and then hold on the full shingle sets."""
    of = lambda c, s: sigs.select(F.col("d").alias(c), F.col("sig").alias(s))
    passed = cut(pairs.join(of("b", "sb"), "b").join(of("a", "sa"), "a").select("a", "b", "sa", "sb").mapInArrow(_prune(least), "a long, b long"))
    bodies = _bodies(texts, sigs, passed.select(F.col("a").alias("d")).union(passed.select("b")).distinct())
    both = passed.join(bodies.select(F.col("d").alias("b"), F.col("x").alias("xb")), "b").join(bodies.select(F.col("d").alias("a"), F.col("x").alias("xa")), "a")
    links = cut(both.select("a", "b", "xa", "xb").mapInArrow(_verify(k, percent), "a long, b long").distinct())
    drop_cut(bodies)
    drop_cut(passed)
    return links


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80, miss: float = 1e-6) -> DataFrame:
    """(d, t, n, component) per row: ``d`` the id (null as the smallest bigint), ``t`` xxhash64 of the text, n its number
    of shingles, component the smallest id reachable over links (its own where it has none)."""
    rows = tune(docs).select(id_key(F.col(id_col)).alias("d"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("t"), F.col(text_col).alias("x"))
    sketched = cut(rows.mapInArrow(_sketch(k), "d long, t long, s1 long, s2 long, n long, sig binary"))
    # a class is read from one of its rows, that of the smallest (id, text hash), whatever other texts the id has; rows of
    # one set have one signature
    classes = cut(sketched.filter("n > 0").groupBy("s1", "s2", "n").agg(F.min(F.struct("d", "t")).alias("r"), F.min("sig").alias("sig")).select("s1", "s2", "n", F.xxhash64("s1", "s2", "n").alias("node"), F.col("r.d").alias("rep"), F.col("r.t").alias("rt"), "sig"))
    sigs = classes.select(F.col("node").alias("d"), "sig", F.col("rep").alias("id"), F.col("rt").alias("t"))
    whole, sketched = sketched, cut(sketched.drop("sig"))
    drop_cut(whole)
    texts, least = rows.select(F.col("d").alias("id"), "t", "x"), least_matches(percent, miss)
    # the sets of one id are linked by it, as a star
    of_id = sketched.filter("n > 0").select("d", F.xxhash64("s1", "s2", "n").alias("b"))
    several = cut(of_id.groupBy("d").agg(F.min("b").alias("a"), F.max("b").alias("top")).filter("a < top").select("d", "a"))
    same_id = cut(of_id.join(several, "d").filter("a <> b").select("a", "b").distinct())

    keys = cut(sigs.select("d", "sig").mapInArrow(_band_keys, "key long, d long"))
    shared = keys.groupBy("key").agg(F.min("d").alias("pivot"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("key", "pivot")
    members = cut(keys.join(shared, "key").select("key", "pivot", "d"))
    drop_cut(keys)
    # only nodes that share a bucket are compared from here on
    every = sigs.select("d")
    sigs = cut(sigs.join(members.select("d").distinct(), "d", "left_semi"))
    links = _confirm(members.filter("d <> pivot").select(F.col("pivot").alias("a"), F.col("d").alias("b")).distinct(), sigs, texts, least, k, percent).unionByName(same_id)
    comp = components(every, links)

    # buckets of three and more members (of two, both have met) that links have not joined
    for turn in range(PIVOT_ROUNDS):
        now = members.join(comp, "d")
        other = F.min(F.struct(F.xxhash64("key", "d", F.lit(turn)).alias("h"), "d", "comp")).alias("m")
        mixed = now.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count(F.lit(1)).alias("size"), other).filter("lo < hi and size > 2").select("key", F.col("m.d").alias("to"), F.col("m.comp").alias("of"))
        pairs = now.join(mixed, "key").filter("comp <> of and d <> pivot and to <> pivot").select(F.least("d", "to").alias("a"), F.greatest("d", "to").alias("b")).distinct()
        links = links.unionByName(_confirm(pairs, sigs, texts, least, k, percent))
        comp = cut(components(every, links))
    # what is open still, each set of members once
    mixed = members.join(comp, "d")
    apart = mixed.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("size"), F.sum(F.shiftright(F.xxhash64("d"), 20)).alias("h1"), F.bit_xor(F.xxhash64("d", F.lit(1))).alias("h2")).filter("lo < hi and size > 2")
    once = apart.groupBy("size", "h1", "h2").agg(F.min(F.struct(F.pmod("key", F.lit(BANDS)), "key")).alias("m")).select("m.key")  # the first band's, where its members first meet
    open_ = cut(mixed.join(once, "key").select("key", "d", "comp"))
    of_sig = sigs.select("d", "sig")
    hopeful = cut(_dealt(open_).join(of_sig, "d").groupBy("key", "p", "q").applyInPandas(_hopeful(least), "key long, d long").distinct())
    if not hopeful.isEmpty():
        bodies = _bodies(texts, sigs, hopeful.select("d").distinct())
        crossed = _dealt(open_.join(hopeful, ["key", "d"])).join(of_sig, "d").join(bodies, "d").groupBy("key", "p", "q").applyInPandas(_blocks(least, k, percent), "a long, b long")
        comp = components(every, links.unionByName(cut(crossed.distinct())))
    drop_cut(members)
    of_class = classes.select("s1", "s2", "n", "rep", F.col("node").alias("d")).join(comp, "d")
    name = of_class.groupBy("comp").agg(F.min("rep").alias("component"))
    of_class = cut(of_class.join(name, "comp").select("s1", "s2", "n", "component"))
    return sketched.select("d", "t", "s1", "s2", "n").join(of_class, ["s1", "s2", "n"], "left").select("d", "t", "n", F.coalesce("component", "d").alias("component"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """``docs`` with one document of each component: the smallest id, and of its repeated rows one."""
    inner = positional(docs)
    key, text = (f"c{docs.columns.index(c)}" for c in (id_col, text_col))
    kept = near_duplicates(inner, key, text, **how).filter("d = component").select(F.col("d").alias("__d"), F.col("t").alias("__t")).distinct()
    keyed = inner.withColumn("__d", id_key(F.col(key))).withColumn("__t", F.xxhash64(F.coalesce(F.col(text), F.lit(""))))
    first = Window.partitionBy("__d", "__t").orderBy(F.lit(0))
    both = keyed.join(kept.hint("shuffle_hash"), ["__d", "__t"]).withColumn("__r", F.row_number().over(first))
    return both.filter("__r = 1").select(*inner.columns).toDF(*docs.columns)
