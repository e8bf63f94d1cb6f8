"""Counts and labels over runs: catalogues, merges, deviations, path labels, flow, support, systems, ratios, searches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import performance as P

RATIO, RATIO_RUNS = 2.0, 10


def activity_catalogue(log: DataFrame, sample: str = "seq") -> DataFrame:
    """(activity, n, actors, sample) of (activity, actor, sample): its events, its distinct actors, its first record."""
    return log.groupBy("activity").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("actor").alias("actors"), F.min(sample).alias("sample"))


def same_activity_merges(log: DataFrame) -> DataFrame:
    """(entity, action, ts, records, actors): moments at which several actors did the same to one thing."""
    g = log.groupBy("entity", "action", "ts").agg(F.count(F.lit(1)).alias("records"), F.countDistinct("actor").alias("actors"))
    return g.filter("actors >= 2")


def deviations(runs: DataFrame, kind: list[str], automated: Column) -> DataFrame:
    """``runs`` with deviation: automated, missing (a usual step before its latest one is absent), ended (without the usual
    end), usual, or other, the first that holds."""
    usual = P.usual_shape(runs, kind)
    gone = P.missing_steps(runs, P.canonical_path(runs, kind), kind).select("key").distinct().withColumn("__gone", F.lit(True))
    r = runs.join(F.broadcast(usual), kind, "left").join(gone, "key", "left")  # one path a kind
    said = F.when(automated, "automated").when(F.col("__gone"), "missing").when(~F.array_contains("shape", F.element_at("canon", -1)), "ended").when(F.col("shape") == F.col("canon"), "usual").otherwise("other")
    return r.select(*runs.columns, said.alias("deviation"))


def path_labels(runs: DataFrame, kind: list[str]) -> DataFrame:
    """``runs`` with label: how a run's path differs from its kind's most common one."""
    r = runs.join(F.broadcast(P.usual_shape(runs, kind)), kind)  # one path a kind
    gone = F.array_except("canon", "shape")
    begun = F.slice("canon", F.lit(1), F.size("shape")) == F.col("shape")
    label = F.when(F.col("shape") == F.col("canon"), "most common").when(begun, F.concat(F.lit("ended at "), F.element_at("shape", -1))).when(F.size(gone) == 1, F.concat(F.lit("no "), F.element_at(gone, 1), F.lit(" step"))).when(F.size(gone) > 1, "fewer steps").otherwise("different order")
    return r.select(*runs.columns, label.alias("label"))


def kind_flow(runs: DataFrame, kind: list[str]) -> DataFrame:
    """(kind, step, place): a step's mean place between 0 and 1 in runs of two steps and more; after all others if it is in none."""
    e = runs.select(*kind, F.size("shape").alias("n"), F.posexplode("shape").alias("i", "step"))
    return e.groupBy(*kind, "step").agg(F.coalesce(F.avg(F.when(F.col("n") >= 2, F.col("i") / (F.col("n") - 1))), F.lit(1.1)).alias("place"))


def step_support(runs: DataFrame, kind: list[str]) -> DataFrame:
    """(kind, step, found, runs): a step is found in so many of the kind's runs."""
    n = runs.groupBy(*kind).agg(F.count(F.lit(1)).alias("runs"))
    return runs.select(*kind, F.explode("shape").alias("step")).groupBy(*kind, "step").agg(F.count(F.lit(1)).alias("found")).join(n, kind)


def transport_ratio(log: DataFrame, by: list[str]) -> DataFrame:
    """(by, runs, median_ratio, needs_reading): records for each distinct activity in runs of several records. A corpus whose
    median is 2 and more over 10 runs and more says how records travel, not what was done."""
    r = log.groupBy(*by, "case_id").agg((F.count(F.lit(1)) / F.countDistinct("activity")).alias("ratio"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    return r.groupBy(*by).agg(F.count(F.lit(1)).alias("runs"), F.median("ratio").alias("median_ratio")).withColumn("needs_reading", (F.col("runs") >= RATIO_RUNS) & (F.col("median_ratio") >= RATIO))


def flow_waits(runs: DataFrame, kind: list[str]) -> DataFrame:
    """(kind, from_step, to_step, median_s, measured): the waits between steps that follow one another on the usual path."""
    path = P.canonical_path(runs, kind).select(*kind, "step", "place")
    following = F.lead("step").over(Window.partitionBy(*kind).orderBy("place"))
    pairs = path.select(*kind, F.col("step").alias("from_step"), following.alias("to_step")).filter("to_step is not null")
    return pairs.join(P.wait_times(runs, kind), [*kind, "from_step", "to_step"], "left").select(*kind, "from_step", "to_step", "median_s", "measured")


def facets(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(facet, value, n): how many rows have each value of each column."""
    parts = [rows.groupBy(F.lit(c).alias("facet"), F.col(c).cast("string").alias("value")).agg(F.count(F.lit(1)).alias("n")) for c in columns]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def search(rows: DataFrame, text: str, columns: list[str]) -> DataFrame:
    """Rows that have ``text`` in any of the columns, whatever its case."""
    return rows.filter(F.contains(F.lower(F.concat_ws(" ", *columns)), F.lit(text.lower())))


def leftovers(records: DataFrame, placed: DataFrame, key: str, reason: Column) -> DataFrame:
    """(reason, n): records that nothing placed, by reason, the most frequent first."""
    left = records.join(placed.select(key).distinct(), key, "left_anti")
    return left.groupBy(reason.alias("reason")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "reason")


def ledger(decisions: DataFrame) -> DataFrame:
    """(kind, outcome, n): decisions by what was asked and what came of it."""
    return decisions.groupBy("kind", "outcome").agg(F.count(F.lit(1)).alias("n"))


def stats(log: DataFrame) -> DataFrame:
    """(kind, activity, events, cases) for every kind, every activity and the whole log, in one pass."""
    return log.groupingSets([["kind"], ["activity"], []], "kind", "activity").agg(F.count(F.lit(1)).alias("events"), F.countDistinct("case_id").alias("cases"))
