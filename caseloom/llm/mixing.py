"""Mixing sources to target weights by weighted fair queueing.

Every document gets a place in its source's shuffle (md5 of its id, so reruns agree). A source whose target is beyond
its size is queued again, pass after pass, up to ``max_repeats`` passes. Documents stand in the queue as packets of at
most ``PACKET`` words, so that a very long one does not hold its source up. Every packet has a virtual finish time: the
words of its source up to its end, all passes counted, divided by the source's target. One queue serves all sources:
packets are range-sorted by finish time, their words are added up along that order, and the mix is what lies within the
total budget, the words of all targets. The one packet in which the budget ends is cut there.

As targets add up to the budget, the queue ends about where every source has reached finish time 1: a source's words are
below its target by less than a packet, and above it by less than a packet of every source.

Sums over an order are taken in two levels, never in one task. Within sources the shuffle key is cut into equal ranges,
about sqrt(rows) of them; along the queue finish times are, for a piece of virtual time serves the same words wherever it
lies. Small sums per range are added up in range order, and only rows of one range are ordered together. A hot source so
spreads over as many groups as its ranges. Texts are read once, for their sizes; only numbers are sorted.

Edge cases: null or empty text has size 0 and takes 0; a null source is a source, last in the order; rows with a null id
are placed by their text and number, so that many of them spread; repeated rows are rows like any other (equal places in
the shuffle are told apart by id, text hash, then the row's number in the table as read); an empty table gives no rows;
other columns are not read, so their names cannot clash.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, positional

#: Words of a document that are queued together.
PACKET = 512
WORD = r"[^\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def source_targets(sizes: DataFrame, weights: Sequence[float], share: float, max_repeats: int) -> DataFrame:
    """(source, source_size) to (source, source_size, target): water-filling under caps of ``max_repeats`` sizes.

    Sources in code-point order, null last, take ``weights`` in turn. target = min(cap, level * weight), the level set
    so that targets add up to ``share`` of all sizes. With sources in order of cap / weight, the level that shares what
    the capped ones leave among the rest rises up to the first source it does not fill, and falls after it.
    """
    named = Window.partitionBy().orderBy(F.col("source").asc_nulls_last())
    turn = ((F.row_number().over(named) - 1) % len(weights) + 1).cast("int")
    fill = Window.partitionBy().orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    return (
        sizes.withColumn("w", F.element_at(F.array(*[F.lit(float(x)) for x in weights]), turn))
        .withColumn("cap", (F.col("source_size") * max_repeats).cast("double"))
        .withColumn("budget", F.sum("source_size").over(everything) * F.lit(float(share)))
        .withColumn("spent", F.coalesce(F.sum("cap").over(fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("level", (F.col("budget") - F.col("spent")) / F.sum("w").over(fill.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
        .withColumn("level", F.max("level").over(everything))
        .select("source", "source_size", F.least(F.col("cap"), F.col("level") * F.col("w")).alias("target"))
    )


def _ahead(rows: DataFrame, group: list[str], bin_: str, amount: str, order: list, out: str) -> DataFrame:
    """``rows`` with ``out``: the amounts of the rows before it in its group, in order of ``bin_`` and then ``order``."""
    sums = rows.groupBy(*group, bin_).agg(F.sum(amount).alias("__s"))
    earlier = Window.partitionBy(*group).orderBy(bin_).rowsBetween(Window.unboundedPreceding, -1)
    names = {c: f"__{c}" for c in [*group, bin_]}
    before = sums.select(*[F.col(c).alias(n) for c, n in names.items()], F.coalesce(F.sum("__s").over(earlier), F.lit(0)).alias("__before"))
    within = Window.partitionBy(*group, bin_).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    inner = rows.withColumn("__inner", F.coalesce(F.sum(amount).over(within), F.lit(0)))
    match = [F.col(c).eqNullSafe(F.col(n)) for c, n in names.items()]
    joined = inner.join(before, match[0] if len(match) == 1 else match[0] & match[1])
    return joined.withColumn(out, F.col("__before") + F.col("__inner")).drop("__inner", "__before", *names.values())


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[float] = (3, 1, 2), share: float = 1.5, max_repeats: int = 2) -> DataFrame:
    """(id, text_hash, row, source, size, source_size, target, taken, copies, finish) per row, range-sorted by finish time.

    ``taken``: words of the document that the mix takes, repeats counted. ``copies``: passes in which it is taken at
    least in part. ``finish``: virtual finish time of its first pass, null where its source has no target. ``row``: the
    row's number, distinct but with gaps.
    """
    text_hash, row = F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))), F.monotonically_increasing_id()
    named = F.coalesce(F.col(id_col).cast("string"), F.concat_ws(" ", text_hash, row))
    place = F.conv(F.substring(F.md5(named), 1, 12), 16, 10).cast("bigint")
    rows = cut(docs.select(F.col(id_col).alias("id"), text_hash.alias("text_hash"), row.alias("row"), F.col(source_col).alias("source"), n_words(F.col(text_col)).alias("size"), place.alias("u")))
    n = max(1, rows.count())
    bins = max(10, math.ceil(math.log2(n) / 2))  # as a power of 2
    order = ["u", F.col("id").asc_nulls_first(), "text_hash", "row"]
    rows = _ahead(rows.withColumn("bin", F.shiftright("u", 48 - bins)), ["source"], "bin", "size", order, "start")

    targets = cut(source_targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, max_repeats))
    budget = targets.agg(F.floor(F.sum("target") + F.lit(1e-6)).alias("budget"))  # one row
    targets = targets.withColumnRenamed("source", "src")
    rows = cut(rows.join(targets, F.col("source").eqNullSafe(F.col("src"))).select("id", "text_hash", "row", "source", "size", "source_size", "target", "start"))

    # a row for each packet: (pass, the words of the document up to its end)
    passes = F.explode(F.sequence(F.lit(0), F.lit(max_repeats - 1))).alias("pass")
    queue = rows.filter("target > 0 and size > 0").select("row", "source", "id", "text_hash", "size", "start", "source_size", "target", passes)
    upto = F.explode(F.transform(F.sequence(F.lit(1).cast("bigint"), F.ceil(F.col("size") / PACKET)), lambda j: F.least(F.col("size"), j * PACKET))).alias("upto")
    queue = queue.select("*", upto).select("row", "source", "id", "text_hash", "pass", "upto", ((F.col("upto") - 1) % PACKET + 1).alias("words"), ((F.col("start") + F.col("source_size") * F.col("pass") + F.col("upto")) / F.col("target")).alias("f"))
    queue = queue.withColumn("piece", F.floor(F.col("f") * (1 << bins)).cast("bigint"))
    served = _ahead(queue, [], "piece", "words", ["f", F.col("source").asc_nulls_last(), F.col("id").asc_nulls_first(), "text_hash", "row", "pass", "upto"], "before")
    got = served.crossJoin(F.broadcast(budget)).select("row", (F.col("upto") == F.col("words")).alias("head"), F.greatest(F.lit(0), F.least(F.col("words"), F.col("budget") - F.col("before"))).alias("got"))
    taken = got.filter("got > 0").groupBy("row").agg(F.sum("got").alias("taken"), F.count_if("head").alias("copies"))
    out = rows.join(taken, "row", "left").select(
        "id", "text_hash", "row", "source", "size", "source_size", "target",
        F.coalesce("taken", F.lit(0)).cast("bigint").alias("taken"),
        F.coalesce("copies", F.lit(0)).cast("int").alias("copies"),
        F.when(F.col("target") > 0, (F.col("start") + F.col("size")) / F.col("target")).alias("finish"),
    )
    return out.orderBy(F.col("finish").asc_nulls_last(), F.col("source").asc_nulls_last(), F.col("id").asc_nulls_first(), "text_hash", "row")


def take_mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **how) -> DataFrame:
    """``docs`` as mixed: each document as many times as it is taken, at least in part (whole each time)."""
    inner = positional(docs)
    key, text, source = (f"c{docs.columns.index(c)}" for c in (id_col, text_col, source_col))
    taken = mix(inner, key, text, source, **how).select(F.col("id").alias("__id"), F.col("text_hash").alias("__h"), F.col("copies").alias("__n")).groupBy("__id", "__h").agg(F.max("__n").alias("__n")).filter("__n > 0")
    keyed = inner.withColumn("__h2", F.xxhash64(F.coalesce(F.col(text), F.lit(""))))
    both = keyed.join(taken.hint("shuffle_hash"), F.col(key).eqNullSafe(F.col("__id")) & (F.col("__h2") == F.col("__h")))
    return both.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__n")))).select(*inner.columns).toDF(*docs.columns)
