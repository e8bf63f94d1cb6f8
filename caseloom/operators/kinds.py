"""Kinds of runs: structural clusters, their features, splits by process, and look-alikes to reject."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PROJECT_STEPS, MIN_RUNS, MIN_SHARE = 3, 3, 0.02


def automated(actor: Column, is_bot: Column) -> Column:
    """Aggregate: a machine acted and no person did; an unrecorded actor is neither."""
    known = actor.isNotNull()
    return F.coalesce(F.bool_or(known & is_bot), F.lit(False)) & ~F.coalesce(F.bool_or(known & ~is_bot), F.lit(False))


def clusters(cases: DataFrame, key: list[str]) -> DataFrame:
    return cases.groupBy(*key).agg(F.count(F.lit(1)).alias("cases"))


def number(clusters_: DataFrame, ties: list[str]) -> DataFrame:
    """Kinds numbered by size, largest first. One row a kind: small."""
    w = Window.partitionBy().orderBy(F.desc("cases"), *ties)
    return clusters_.withColumn("kind", F.row_number().over(w).cast("bigint"))


def top_actions(log: DataFrame, kind: list[str], n: int) -> DataFrame:
    g = log.groupBy(*kind, "activity").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(*kind).orderBy(F.desc("n"), "activity")
    top = g.withColumn("k", F.row_number().over(w)).filter(F.col("k") <= n)
    return top.groupBy(*kind).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "activity"))), lambda x: x["activity"]), ",").alias("top_actions"), F.sum("n").alias("top_events"))


def reject(clusters_: DataFrame) -> DataFrame:
    """Clusters that only machines drive, again and again, are flagged, never dropped."""
    return clusters_.withColumn("rejected", F.col("automated") & (F.col("cases") > 1))


def split_by_process(cases: DataFrame) -> DataFrame:
    """(kind, process, cases, placed): a process needs max(3, 2 %) runs of its cluster; below, a run of three different
    steps makes a project; else its runs stay with the parent."""
    bar = cases.groupBy("kind").agg(F.greatest(F.lit(MIN_RUNS), F.bround(F.lit(MIN_SHARE) * F.count(F.lit(1)))).cast("bigint").alias("bar"))
    g = cases.filter("process is not null").groupBy("kind", "process").agg(F.count(F.lit(1)).alias("cases"), F.max("steps").alias("most"))
    placed = F.when(F.col("cases") >= F.col("bar"), "process").when(F.col("most") >= PROJECT_STEPS, "project").otherwise("parent")
    return g.join(bar, "kind").select("kind", "process", "cases", placed.alias("placed"))


def disambiguate(names: DataFrame, name: str, order: str) -> DataFrame:
    """Equal names get a number from the second on."""
    k = F.row_number().over(Window.partitionBy(name).orderBy(order))
    return names.withColumn(name, F.when(k == 1, F.col(name)).otherwise(F.concat_ws(" ", name, k.cast("string"))))
