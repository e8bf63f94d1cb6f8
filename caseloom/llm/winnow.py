"""Document fingerprints by winnowing, in DataFrame functions only.

A text becomes tokens with 31-bit hashes: runs of up to ``TOKEN`` non-space characters, as they stand, and the single
characters of longer runs and of scripts written without spaces, so that what stands before a passage never moves its
tokens. Hashes of all k-token grams roll out of them by doubling: a gram of 2m tokens is (gram at i) * B**m + (gram at
i + m) modulo a prime, so log2(k) passes over an array give every gram. Each gram's place is packed below its mixed
hash, and the minimum of every window of ``w`` grams, by the same doubling, is the smallest hash with the rightmost place
among ties. The distinct minima are the fingerprint: hashes with their positions.

Guarantee: texts that share a run of w + k - 1 tokens share a fingerprint hash, and no run under k tokens is seen. A
text of fewer than k tokens has one gram, its whole token sequence; one of fewer than w grams has one window.

The next document in descending id is found without a global sort: rows are cut into about 4 * sqrt(rows) ranges of (id, text
hash), whose first rows a range exchange of these two numbers gives; a window orders each range, and the first row of the
next range stands at its end as a guest. Only the bounds come to the driver, two numbers a range, and every row finds its
range by binary search in them; no text is broadcast. Ranges and bounds both grow with the square root of the rows.

Edge cases: null and empty texts, and texts of white space alone, have an empty fingerprint; two empty fingerprints have
likeness 1, an empty and a non-empty one 0; rows that repeat an id are ordered by the 64-bit hash of their text, then by
the text, and spread over ranges unless the texts are equal too; null ids come last; an only row is its own next
document; an empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, id_key

K, W = 4, 8
TOKEN = 24
#: Characters that are tokens by themselves: Thai, Lao, Myanmar, Khmer, Kana and Han. Spaces are the six of ASCII.
UNSPACED = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff"
SPACES = r"\x20\x09-\x0D"
WORDS = rf"(?<![^{SPACES}{UNSPACED}])[^{SPACES}{UNSPACED}]{{1,{TOKEN}}}(?![^{SPACES}{UNSPACED}])|[^{SPACES}]"
PRIME, BASE = 2_147_483_647, 911_382_323
#: Bits for a gram's place in its text. Places beyond wrap around; hashes never do.
AT = 28


def _after(a: str, by: int) -> Column:
    """a[i + by] at i, for those i where it exists."""
    return F.slice(F.col(a), F.lit(by + 1), F.greatest(F.lit(0), F.size(a) - by))


def _upto(a: Column, n: Column) -> Column:
    return F.slice(a, F.lit(1), F.greatest(F.lit(0), n))


def _roll(power: int):
    return lambda x, y: (x * power + y) % PRIME


def fingerprint(df: DataFrame, text_col: str, out: str, k: int = K, w: int = W) -> DataFrame:
    """``df`` with ``out``: array of (mixed hash << AT) + (2**AT - 1 - place) in text order; k and w are powers of two.

    One projection a step: an array that several expressions read is a column, never an expression repeated.
    """
    a, t = f"__{out}_a", f"__{out}_t"
    words = F.regexp_extract_all(F.coalesce(F.col(text_col), F.lit("")), F.lit(WORDS), F.lit(0))
    df = df.withColumn(t, F.transform(words, lambda x: F.crc32(x) % PRIME + 1))
    df = df.withColumn(a, F.col(t))
    power, m = BASE, 1
    while m < k:  # grams of m tokens to grams of 2 * m
        df = df.withColumn(a, F.zip_with(_upto(F.col(a), F.size(a) - m), _after(a, m), _roll(power)))
        power, m = power * power % PRIME, 2 * m
    whole = F.aggregate(t, F.lit(0).cast("bigint"), lambda s, x: (s * BASE + x) % PRIME)
    df = df.withColumn(a, F.when(F.size(t) >= k, F.col(a)).when(F.size(t) > 0, F.array(whole)).otherwise(F.slice(F.col(a), 1, 0)))
    last = (1 << AT) - 1
    df = df.withColumn(a, F.transform(a, lambda x, i: F.shiftleft((x * 1_103_515_245 + 12_345) % PRIME, AT) + (last - i % (1 << AT))))
    df = df.withColumn(t, F.when(F.size(a) > 0, F.array(F.array_min(a))).otherwise(F.slice(F.col(a), 1, 0)))
    m = 1
    while m < w:  # minima of m grams to minima of 2 * m
        df = df.withColumn(a, F.zip_with(_upto(F.col(a), F.size(a) - m), _after(a, m), lambda x, y: F.least(x, y)))
        m *= 2
    return df.withColumn(out, F.array_distinct(F.when(F.size(a) > 0, F.col(a)).otherwise(F.col(t)))).drop(a, t)


def hashes(fp: str) -> Column:
    """The distinct hashes of a fingerprint, without places."""
    return F.array_distinct(F.transform(fp, lambda x: F.shiftright(x, AT)))


def likeness(a: str, b: str, both: Column) -> Column:
    """Jaccard similarity of two arrays of distinct hashes, ``both`` being the size of their intersection."""
    union = F.size(a) + F.size(b) - both
    return F.when(union == 0, F.lit(1.0)).otherwise(both / union)


def shown(fp: str) -> Column:
    """A fingerprint as text: hexadecimal numbers, place within the low AT bits."""
    return F.array_join(F.transform(fp, lambda x: F.hex(x)), " ")


def ranges(rows: DataFrame) -> list[tuple[int, int]]:
    """The first (e, h) of each of about 4 * sqrt(rows) ranges of the rows in order of (e, h)."""
    keys = cut(rows.select("e", "h"))
    count = keys.count()
    if count < 2:
        return []
    n = math.ceil(4 * math.sqrt(count))
    dealt = keys.repartitionByRange(n, "e", "h").select(F.spark_partition_id().alias("p"), "e", "h")
    firsts = dealt.groupBy("p").agg(F.min(F.struct("e", "h")).alias("first")).select("first.*").collect()  # n rows
    return sorted((r["e"], r["h"]) for r in firsts)


def range_of(bounds: list[tuple[int, int]]) -> Column:
    """The number of the range that holds (e, h): binary search for the last bound that is not above."""
    n = len(bounds)
    if n < 2:
        return F.lit(0)
    es, hs = (F.lit(np.array([b[i] for b in bounds], np.int64)) for i in (0, 1))

    def step(at: Column, half: Column) -> Column:
        to = at + half
        e, h = (F.get(x, F.least(to, F.lit(n - 1))) for x in (es, hs))
        return F.when((to < n) & ((e < F.col("e")) | ((e == F.col("e")) & (h <= F.col("h")))), to).otherwise(at)

    halves = F.lit(np.array([1 << i for i in reversed(range((n - 1).bit_length()))], np.int32))
    return F.aggregate(halves, F.lit(0), step)


def with_guests(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, Window]:
    """(rows id, x, e, h, bucket, guest; the window that orders a bucket): of every bucket, the row that follows its last
    one is there too, as a guest."""
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("x"))
    # ascending order of the complement is descending order of the id, and has no overflow
    rows = rows.withColumn("e", F.bitwise_not(id_key(F.col("id")))).withColumn("h", F.xxhash64("x"))
    bounds = ranges(rows)
    n = max(1, len(bounds))
    rows = rows.withColumn("bucket", range_of(bounds))
    if bounds:
        heads = docs.sparkSession.createDataFrame(bounds, "fe long, fh long")  # n rows of two numbers
        first = rows.join(F.broadcast(heads), (F.col("e") == F.col("fe")) & (F.col("h") == F.col("fh")))
    else:
        first = rows  # one row at most
    guests = first.groupBy("bucket", "e", "h").agg(F.min("x").alias("x")).select(F.lit(None).cast(rows.schema["id"].dataType).alias("id"), "x", "e", "h", F.pmod(F.col("bucket") + (n - 1), F.lit(n)).alias("bucket"), F.lit(True).alias("guest"))
    every = rows.withColumn("guest", F.lit(False)).unionByName(guests)
    return every, Window.partitionBy("bucket").orderBy("guest", "e", "h", "x")


def compare_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, w: int = W) -> DataFrame:
    """(id, n_chars, edited, fp, fp_edited, near_edited, near_next) per row: every text beside its edit, whose last half
    is the beginning of the next document, and beside the next document."""
    rows, inside = with_guests(docs, id_col, text_col)
    df = rows.withColumn("next", F.lead("x").over(inside))
    df = fingerprint(df, "x", "fp", k, w).withColumn("hs", hashes("fp"))
    df = df.withColumn("hn", F.lead("hs").over(inside)).filter("not guest")
    df = df.withColumn("n_chars", F.length("x").cast("bigint"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    df = df.withColumn("edited", F.concat(F.substring(F.col("x"), F.lit(1), F.col("n_chars").cast("int") - half), F.substring(F.col("next"), F.lit(1), half)))
    df = fingerprint(df, "edited", "fe", k, w).withColumn("he", hashes("fe"))
    df = df.withColumn("be", F.size(F.array_intersect("hs", "he"))).withColumn("bn", F.size(F.array_intersect("hs", "hn")))
    return df.select("id", "n_chars", "edited", "fp", F.col("fe").alias("fp_edited"), likeness("hs", "he", F.col("be")).alias("near_edited"), likeness("hs", "hn", F.col("bn")).alias("near_next"))
