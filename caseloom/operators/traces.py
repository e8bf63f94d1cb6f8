"""Traces of runs: sessions, order, collapse, shape, variants and directly-follows graphs.

A log has one row per event: case_id, activity, ts (nullable), seq, and what else the caller keeps. A trace table has one
row per case. Per-case work is one aggregation into a sorted array and array functions on it: one shuffle per log.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, END = "__start__", "__end__"
#: Order of actions that share an instant: what one commit does first.
#: Fixed values that results depend on.
RANKS = {"authored": 0, "co-authored": 0, "reviewed": 1, "committed": 2, "merged": 3, "reverted": 3, "released": 4, "closed": 5}


def micros(ts: Column) -> Column:
    """Microseconds since the epoch of a timestamp with or without a zone."""
    return F.unix_micros(ts.cast("timestamp"))


def action_rank(action: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in RANKS.items() for x in kv])
    return F.coalesce(table[action], F.lit(9))


def split_sessions(df: DataFrame, keys: list[str], ts: str, seq: str, gap_seconds: float, out: str = "session") -> DataFrame:
    """Number the sessions of each key: a new one starts after a silence longer than ``gap_seconds``."""
    w = Window.partitionBy(*keys).orderBy(ts, seq)
    silence = (micros(F.col(ts)) - micros(F.lag(ts).over(w))) / 1e6
    fresh = F.when(silence.isNull() | (silence > gap_seconds), 1).otherwise(0)
    return df.withColumn("__fresh", fresh).withColumn(out, F.sum("__fresh").over(w)).drop("__fresh")


def split_quiet(df: DataFrame, keys: list[str], ts: str, seq: str, floor_days: int = 30, multiple: int = 10, out: str = "session") -> DataFrame:
    """Sessions by each key's own rhythm: the bar is max(floor, multiple * median of the gaps within the floor), in whole
    days; a key with an undated row, or a single one, stays whole."""
    w, whole = Window.partitionBy(*keys).orderBy(ts, seq), Window.partitionBy(*keys)
    gap = F.floor((micros(F.col(ts)) - micros(F.lag(ts).over(w))) / 86_400_000_000)
    df = df.withColumn("__gap", gap).withColumn("__dated", F.min(F.col(ts).isNotNull()).over(whole))
    rhythm = F.coalesce(F.median(F.when(F.col("__gap") <= floor_days, F.col("__gap"))).over(whole), F.lit(0.0))
    df = df.withColumn("__bar", F.greatest(F.lit(float(floor_days)), rhythm * multiple))
    cut = F.when(F.col("__dated") & (F.col("__gap") > F.col("__bar")), 1).otherwise(0)
    df = df.withColumn("__cut", cut).withColumn(out, F.sum("__cut").over(w) + 1)
    return df.drop("__gap", "__dated", "__bar", "__cut")


def build_traces(log: DataFrame, case: str = "case_id", extra: list[Column] | None = None) -> DataFrame:
    """(case, steps, order_status, ...): steps are structs (undated, ts, rank, seq, activity, actor) in trace order.

    Timed events by (ts, rank of the action, seq), untimed ones appended in emission order.
    """
    actor = F.col("actor") if "actor" in log.columns else F.lit(None).cast("string")
    step = F.struct(F.col("ts").isNull().alias("undated"), "ts", F.when(F.col("ts").isNull(), 0).otherwise(action_rank(F.col("activity"))).alias("rank"), "seq", "activity", actor.cast("string").alias("actor"))
    status = order_status(F.count("ts"), F.count(F.lit(1)))
    return log.groupBy(case).agg(F.array_sort(F.collect_list(step)).alias("steps"), status.alias("order_status"), *(extra or []))


def order_status(timed: Column, events: Column) -> Column:
    return F.when(timed == 0, "unknown").when(timed < events, "partial").otherwise("ordered")


def collapse(steps: str = "steps") -> Column:
    """Steps without those whose (activity, ts) equals that of the step before: simultaneous twins count once."""
    s = F.col(steps)
    return F.filter(s, lambda x, i: (i == 0) | ~(x["activity"].eqNullSafe(F.get(s, i - 1)["activity"]) & x["ts"].eqNullSafe(F.get(s, i - 1)["ts"])))


def fold(steps: str = "steps") -> Column:
    """The first step of each block of consecutive equal activities."""
    s = F.col(steps)
    return F.filter(s, lambda x, i: (i == 0) | ~x["activity"].eqNullSafe(F.get(s, i - 1)["activity"]))


def activities(steps: Column | str) -> Column:
    return F.transform(steps, lambda x: x["activity"])


def shape(trace: Column | str) -> Column:
    """Distinct steps in order of first occurrence."""
    return F.array_distinct(trace)


def text(trace: Column | str) -> Column:
    return F.array_join(trace, ">")


def variants(traces: DataFrame, kind: list[str], case: str = "case_id") -> DataFrame:
    """(kind..., shape, length, frequency, exact_traces, first_case, role); traces need ``trace`` and the kind columns.

    The top shape is the most frequent, shortest among equals, then first by text. Roles: reverted, or repeated but not
    top: exception; top and repeated: common; seen once: one-off.
    """
    t = traces.withColumn("shape", text(shape("trace"))).withColumn("exact", text("trace")).withColumn("length", F.size(shape("trace")))
    # two levels, so that no list of a shape's traces is gathered for counting them
    exact = t.groupBy(*kind, "shape", "length", "exact").agg(F.count(F.lit(1)).alias("n"), F.min(case).alias("c"))
    v = exact.groupBy(*kind, "shape", "length").agg(F.sum("n").alias("frequency"), F.count(F.lit(1)).alias("exact_traces"), F.min("c").alias("first_case"))
    w = Window.partitionBy(*kind).orderBy(F.desc("frequency"), "length", "shape")
    v = v.withColumn("__top", F.row_number().over(w) == 1)
    reverted = F.array_contains(F.split("shape", ">"), "reverted")
    role = F.when(reverted | ((F.col("frequency") > 1) & ~F.col("__top")), "exception").when(F.col("__top") & (F.col("frequency") > 1), "common").when(F.col("frequency") == 1, "one-off").otherwise("common")
    return v.withColumn("role", role).drop("__top")


def exact_traces(traces: DataFrame, kind: list[str]) -> DataFrame:
    """(kind..., shape, trace, frequency): the exact traces kept inside each variant."""
    return traces.groupBy(*kind, text(shape("trace")).alias("shape"), text("trace").alias("trace")).agg(F.count(F.lit(1)).alias("frequency"))


def dfg_edges(traces: DataFrame, kind: list[str]) -> DataFrame:
    """(kind..., from_activity, to_activity, n) with start and end marks; empty traces give nothing."""
    full = F.concat(F.array(F.lit(START)), F.col("trace"), F.array(F.lit(END)))
    pairs = F.arrays_zip(F.slice(full, F.lit(1), F.size(full) - 1).alias("a"), F.slice(full, F.lit(2), F.size(full) - 1).alias("b"))
    e = traces.filter(F.size("trace") > 0).select(*kind, F.explode(pairs).alias("e"))
    return e.groupBy(*kind, F.col("e.a").alias("from_activity"), F.col("e.b").alias("to_activity")).agg(F.count(F.lit(1)).alias("n"))


def dfg_nodes(traces: DataFrame, kind: list[str]) -> DataFrame:
    return traces.select(*kind, F.explode("trace").alias("activity")).groupBy(*kind, "activity").agg(F.count(F.lit(1)).alias("n"))


def order_observations(obs: DataFrame, cases_with_events: DataFrame) -> DataFrame:
    """(case_id, ordered ids, order_status) of cases made of observations alone: dated ones by time, then the others."""
    alone = obs.filter(F.col("case_id").isNotNull()).join(cases_with_events.select("case_id").distinct(), "case_id", "left_anti")
    step = F.struct(F.col("seen_at").isNull().alias("undated"), "seen_at", "seq", "obs_id")
    g = alone.groupBy("case_id").agg(F.array_sort(F.collect_list(step)).alias("s"), F.count("seen_at").alias("timed"), F.count(F.lit(1)).alias("n"))
    return g.select("case_id", F.transform("s", lambda x: x["obs_id"]).alias("ordered_ids"), order_status(F.col("timed"), F.col("n")).alias("order_status"))
