"""Readings, decisions, reviews and samples: the offline halves of the model tier.

A model can only narrow or label. Its answers are tables here, and its scripted stand-ins are phrase tables; with none
of them the results are those of the engine alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SIGNAL, GATE, SCREEN, MARGIN = 0.25, 0.40, 0.35, 1.5


def scripted(text: Column, rules: list[tuple[str, str]]) -> Column:
    """The label of the first rule (phrase, label) whose phrase the text has, else null."""
    low, out = F.lower(text), F.lit(None).cast("string")
    for phrase, label in reversed(rules):
        out = F.when(low.contains(phrase.lower()), F.lit(label)).otherwise(out)
    return out


def relabel(action: Column, table: dict[str, str], reading: Column | None = None) -> Column:
    """A record's own reading, else the verb map, else the verb."""
    m = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[action] if table else F.lit(None).cast("string")
    return F.coalesce(*([reading] if reading is not None else []), m, action)


def process_vote(readings: DataFrame) -> DataFrame:
    """(case_id, process, votes): the plurality of each case's readings, the earliest among equals. Columns: case_id,
    process, seq."""
    g = readings.filter("process is not null").groupBy("case_id", "process").agg(F.count(F.lit(1)).alias("votes"), F.min("seq").alias("first"))
    return g.groupBy("case_id").agg(F.max_by(F.struct("process", "votes"), F.struct("votes", -F.col("first"))).alias("m")).select("case_id", "m.process", "m.votes")


def lonely_steps(readings: DataFrame, min_runs: int = 3) -> DataFrame:
    """(process, step, runs): steps of a process in enough runs that never share a run with another of its steps."""
    pairs = readings.select("process", "step", "case_id").distinct()
    n = pairs.groupBy("process", "case_id").agg(F.count(F.lit(1)).alias("siblings"))
    j = pairs.join(n, ["process", "case_id"])
    g = j.groupBy("process", "step").agg(F.count(F.lit(1)).alias("runs"), F.max("siblings").alias("most"))
    return g.filter((F.col("runs") >= min_runs) & (F.col("most") == 1)).select("process", "step", "runs")


def even_stride(df: DataFrame, order: str, n: int, ranges: int = 256) -> DataFrame:
    """``n`` rows spread evenly over ``order`` (any type that sorts, distinct values), all of them if there are no more.

    Ranks are counted in two levels, so no task sees all rows: rows are range-partitioned, counted by range, and numbered
    within their range, whatever the values' spread.
    """
    from .graph import materialise

    if n <= 0:
        return df.limit(0)
    dealt = materialise(df.repartitionByRange(ranges, order).withColumn("__b", F.spark_partition_id()))
    sums = dealt.groupBy("__b").agg(F.count(F.lit(1)).alias("__c"))
    ahead = sums.withColumn("__a", F.coalesce(F.sum("__c").over(Window.partitionBy().orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("__t", F.sum("__c").over(Window.partitionBy())).drop("__c")
    r = dealt.join(F.broadcast(ahead), "__b").withColumn("__i", F.col("__a") + F.row_number().over(Window.partitionBy("__b").orderBy(order)) - 1)  # one row a range
    # row i is taken if some k has floor(k * total / n) = i
    k = F.ceil(F.col("__i") * n / F.col("__t"))
    taken = (F.col("__t") <= n) | ((F.floor(k * F.col("__t") / n) == F.col("__i")) & (k < n))
    return r.filter(taken).drop("__b", "__a", "__t", "__i")


def cap_per_case(df: DataFrame, case: str, order: list[str], n: int) -> DataFrame:
    w = Window.partitionBy(case).orderBy(*order)
    return df.withColumn("__k", F.row_number().over(w)).filter(F.col("__k") <= n).drop("__k")


def separation(scores: DataFrame) -> DataFrame:
    """(record, best, score, second, ambiguous): the best option of each record against the next one."""
    w = Window.partitionBy("record").orderBy(F.desc("score"), "option")
    r = scores.withColumn("k", F.row_number().over(w)).filter("k <= 2")
    g = r.groupBy("record").agg(F.max(F.when(F.col("k") == 1, F.col("option"))).alias("best"), F.max(F.when(F.col("k") == 1, F.col("score"))).alias("score"), F.max(F.when(F.col("k") == 2, F.col("score"))).alias("second"))
    return g.withColumn("ambiguous", F.coalesce(F.col("score") < MARGIN * F.col("second"), F.lit(False)))


def screen(scopes: dict[str, Column], bar: float = SCREEN) -> Column:
    """The first scope whose answer is below the bar; no answer cannot fail."""
    out = F.lit(None).cast("string")
    for name, p in reversed(list(scopes.items())):
        out = F.when(F.coalesce(p < bar, F.lit(False)), F.lit(name)).otherwise(out)
    return out


def worth_reading(p: Column) -> Column:
    """Unknown is always worth reading."""
    return F.coalesce(p >= SIGNAL, F.lit(True))


def geometric_mean(ps: Column) -> Column:
    return F.exp(F.aggregate(ps, F.lit(0.0), lambda s, x: s + F.log(F.greatest(x, F.lit(1e-9)))) / F.size(ps))


def repeatability(df: DataFrame, key: str, value: str) -> DataFrame:
    """(key, n, mean, deviation, flips): population deviation, and how often answers at 0.5 change."""
    return df.groupBy(key).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("deviation"), (F.countDistinct(F.col(value) >= 0.5) - 1).alias("flips"))


def last_answers(answers: DataFrame) -> DataFrame:
    """The last valid answer of each claim, by position."""
    ok = answers.filter(F.col("answer").isin("confirmed", "disputed"))
    return ok.groupBy("claim").agg(F.max_by("answer", "position").alias("answer"))


def reconcile(claims: DataFrame, answers: DataFrame) -> DataFrame:
    """(claim, status): confirmed, disputed, open (a claim without an answer), unmatched (an answer without a claim)."""
    c, a = claims.select("claim").distinct().withColumn("__c", F.lit(True)), last_answers(answers)
    both = c.join(a, "claim", "full_outer")
    return both.select("claim", F.when(F.col("__c").isNull(), "unmatched").otherwise(F.coalesce("answer", F.lit("open"))).alias("status"))
