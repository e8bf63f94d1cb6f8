"""Performance of a process: cycle times, waits, route, rework and the one headline.

Input is a run table: kind columns, ``key``, and ``steps`` (structs with activity and ts, consecutive equals folded).
Figures that need order statistics are computed by grouped aggregation on the exploded waits, never on the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import traces as T

MIN_RUNS = 5
BOTTLENECK, EXCEPTION, REWORK = 30, 15, 10  # per cent


def seconds(ts: Column) -> Column:
    return T.micros(ts) / 1e6


def pct(n: Column, total: Column) -> Column:
    """Per cent rounded half to even, 0 of nothing."""
    return F.when(total > 0, F.bround(100.0 * n / total)).otherwise(0).cast("bigint")


def cycles(runs: DataFrame) -> DataFrame:
    """``runs`` with cycle_s: seconds from the first to the last dated step; null under two dated steps or if negative."""
    dated = F.filter("steps", lambda x: x["ts"].isNotNull())
    span = seconds(F.element_at(dated, -1)["ts"]) - seconds(F.element_at(dated, 1)["ts"])
    return runs.withColumn("cycle_s", F.when((F.size(dated) >= 2) & (span >= 0), span))


def nearest_rank(values: Column, share: float) -> Column:
    """Value at round-half-even(share * (n - 1)) of the sorted array."""
    n = F.size(values)
    return F.element_at(F.array_sort(values), (F.bround((n - 1) * F.lit(share)).cast("int") + 1))


def cycle_time(runs: DataFrame, kind: list[str]) -> DataFrame:
    """(kind..., of, measured, coverage_pct, median_s, slow_s): slow is the nearest rank at 90 %.

    The rank is found by numbering distinct cycle times with running counts, so no list of all values is gathered.
    """
    c = cycles(runs)
    tot = c.groupBy(*kind).agg(F.count(F.lit(1)).alias("of"), F.count("cycle_s").alias("measured"), F.median("cycle_s").alias("median_s"))
    values = c.filter("cycle_s is not null").groupBy(*kind, "cycle_s").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(*kind).orderBy("cycle_s")
    upto = values.withColumn("upto", F.sum("n").over(w))
    tk, uk = tot.alias("t"), upto.alias("u")
    on = [F.col(f"t.{k}").eqNullSafe(F.col(f"u.{k}")) for k in kind]
    rank = F.bround((F.col("measured") - 1) * F.lit(0.9)).cast("bigint") + 1
    hit = tk.join(uk, on, "left").groupBy(*[F.col(f"t.{k}").alias(k) for k in kind], "of", "measured", "median_s").agg(F.min(F.when(F.col("upto") >= rank, F.col("cycle_s"))).alias("slow_s"))
    return hit.withColumn("coverage_pct", pct(F.col("measured"), F.col("of")))


def waits(runs: DataFrame, kind: list[str]) -> DataFrame:
    """One row per run and pair of consecutive, dated, different steps: the first such wait, in seconds, if not negative."""
    c = cycles(runs).filter("cycle_s is not null")
    n = F.size("steps") - 1
    pair = F.transform(F.sequence(F.lit(1), n), lambda i: F.struct(i.alias("i"), F.element_at("steps", i).alias("a"), F.element_at("steps", i + 1).alias("b")))
    e = c.filter(F.size("steps") >= 2).select(*kind, "key", F.explode(pair).alias("p"))
    e = e.select(*kind, "key", F.col("p.i").alias("i"), F.col("p.a.activity").alias("from_step"), F.col("p.b.activity").alias("to_step"), (seconds(F.col("p.b.ts")) - seconds(F.col("p.a.ts"))).alias("wait_s"))
    e = e.filter((F.col("from_step") != F.col("to_step")) & (F.col("wait_s") >= 0))
    return e.groupBy(*kind, "key", "from_step", "to_step").agg(F.min_by("wait_s", "i").alias("wait_s"))


def wait_times(runs: DataFrame, kind: list[str], min_runs: int = MIN_RUNS) -> DataFrame:
    """(kind..., from_step, to_step, measured, median_s, total_s, share_pct) of waits in enough runs."""
    per = waits(runs, kind).groupBy(*kind, "from_step", "to_step").agg(F.count(F.lit(1)).alias("measured"), F.median("wait_s").alias("median_s"), F.sum("wait_s").alias("total_s"))
    everything = cycles(runs).groupBy(*kind).agg(F.sum("cycle_s").alias("all_s"))
    p, a = per.filter(F.col("measured") >= min_runs).alias("p"), everything.alias("a")
    both = p.join(F.broadcast(a) if not kind else a, [F.col(f"p.{k}").eqNullSafe(F.col(f"a.{k}")) for k in kind] or F.lit(True))
    return both.select(*[F.col(f"p.{k}").alias(k) for k in kind], "from_step", "to_step", "measured", "median_s", "total_s", F.when(F.col("all_s") > 0, F.bround(100 * F.col("total_s") / F.col("all_s"))).otherwise(0).cast("bigint").alias("share_pct"))


def canonical_path(runs: DataFrame, kind: list[str], share: float = 0.5) -> DataFrame:
    """(kind..., step, place, runs_with, runs): steps in more than ``share`` of the runs, in order of mean normalised
    place of first occurrence; kinds with fewer than two such steps have no path. Runs need ``shape`` (array)."""
    s = runs.filter(F.size("shape") > 0)
    total = s.groupBy(*kind).agg(F.count(F.lit(1)).alias("runs"))
    span = F.greatest(F.lit(1), F.size("shape") - 1)
    e = s.select(*kind, span.alias("span"), F.posexplode("shape").alias("i", "step")).groupBy(*kind, "step").agg(F.count(F.lit(1)).alias("runs_with"), F.round(F.avg(F.col("i") / F.col("span")), 9).alias("mean_place"))
    both = e.join(total, kind) if kind else e.crossJoin(F.broadcast(total))
    w = Window.partitionBy(*kind)
    kept = both.filter(F.col("runs_with") > F.col("runs") * share).withColumn("__n", F.count(F.lit(1)).over(w)).filter("__n >= 2")
    return kept.withColumn("place", F.row_number().over(w.orderBy("mean_place", "step"))).drop("__n")


def missing_steps(runs: DataFrame, path: DataFrame, kind: list[str]) -> DataFrame:
    """(kind..., key, missing, reached): expected steps that a run lacks though it reached a later one."""
    p = path.groupBy(*kind).agg(F.array_sort(F.collect_list(F.struct("place", "step"))).alias("path"))  # at most a vocabulary
    both = runs.join(p, kind) if kind else runs.crossJoin(F.broadcast(p))
    there = F.filter("path", lambda x: F.array_contains("shape", x["step"]))
    latest = F.element_at(there, -1)
    both = both.withColumn("latest", F.when(F.size(there) > 0, latest))
    gone = F.filter("path", lambda x: (x["place"] < F.col("latest.place")) & ~F.array_contains("shape", x["step"]))
    return both.filter("latest is not null").select(*kind, "key", F.col("latest.step").alias("reached"), F.explode(gone).alias("g")).select(*kind, "key", F.col("g.step").alias("missing"), "reached")


def usual_shape(runs: DataFrame, kind: list[str]) -> DataFrame:
    """(kind..., canon array): the most frequent shape, longest among equals, then by text; where at least four runs
    have all different shapes there is none; with fewer, all different, the shortest."""
    g = runs.groupBy(*kind, "shape").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(*kind)
    g = g.withColumn("runs", F.sum("n").over(w)).withColumn("most", F.max("n").over(w))
    long_first, short_first = (w.orderBy(F.desc("n"), o(F.size("shape")), T.text("shape")) for o in (F.desc, F.asc))
    g = g.withColumn("r", F.when(F.col("most") > 1, F.row_number().over(long_first)).when(F.col("runs") < 4, F.row_number().over(short_first)))
    return g.filter("r = 1").select(*kind, F.col("shape").alias("canon"))


def route(runs: DataFrame, canon: DataFrame, kind: list[str]) -> DataFrame:
    """(kind..., of, off_route, off_pct, final_step, not_completed, open_pct) against the usual shape."""
    r = runs.join(canon, kind) if kind else runs.crossJoin(F.broadcast(canon))
    last = F.element_at("canon", -1)
    g = r.groupBy(*kind, last.alias("final_step")).agg(F.count(F.lit(1)).alias("of"), F.count_if(F.col("shape") != F.col("canon")).alias("off_route"), F.count_if(~F.array_contains("shape", last)).alias("not_completed"))
    return g.withColumn("off_pct", pct(F.col("off_route"), F.col("of"))).withColumn("open_pct", pct(F.col("not_completed"), F.col("of")))


def skipped(runs: DataFrame, canon: DataFrame, kind: list[str]) -> DataFrame:
    """(kind..., step, n): usual steps that off-route runs lack."""
    r = runs.join(canon, kind) if kind else runs.crossJoin(F.broadcast(canon))
    e = r.filter(F.col("shape") != F.col("canon")).select(*kind, F.explode(F.array_except("canon", "shape")).alias("step"))
    return e.groupBy(*kind, "step").agg(F.count(F.lit(1)).alias("n"))


def rework(runs: DataFrame, kind: list[str]) -> DataFrame:
    """(kind..., of, rework, rework_pct): runs in which a step comes again after something else. Needs folded ``trace``."""
    g = runs.groupBy(*kind).agg(F.count(F.lit(1)).alias("of"), F.count_if(F.size("trace") != F.size("shape")).alias("rework"))
    return g.withColumn("rework_pct", pct(F.col("rework"), F.col("of")))


def redone(runs: DataFrame, kind: list[str]) -> DataFrame:
    """(kind..., step, n): in how many runs each step comes more than once."""
    again = F.filter("shape", lambda x: F.size(F.filter("trace", lambda y: y == x)) > 1)
    return runs.filter(F.size("trace") != F.size("shape")).select(*kind, F.explode(again).alias("step")).groupBy(*kind, "step").agg(F.count(F.lit(1)).alias("n"))


def headline(runs: DataFrame, canon: DataFrame, kind: list[str]) -> DataFrame:
    """(kind..., headline): insufficient, bottleneck, exception, rework or steady, by fixed rules in that order."""
    n = runs.groupBy(*kind).agg(F.count(F.lit(1)).alias("of"))
    w = wait_times(runs, kind).groupBy(*kind).agg(F.count(F.lit(1)).alias("n_waits"), F.max_by("share_pct", F.struct("total_s", "median_s")).alias("share"))
    out = n.join(w, kind, "left").join(route(runs, canon, kind).select(*kind, "off_pct"), kind, "left").join(rework(runs, kind).select(*kind, "rework_pct"), kind, "left")
    text = F.when(F.col("of") < MIN_RUNS, "insufficient").when((F.col("n_waits") >= 2) & (F.col("share") >= BOTTLENECK), "bottleneck").when(F.col("off_pct") >= EXCEPTION, "exception").when(F.col("rework_pct") >= REWORK, "rework").otherwise("steady")
    return out.select(*kind, text.alias("headline"))


def human_duration(s: Column, precise: Column) -> Column:
    """A duration in words: same day, hours, days (one decimal under ten), rounded half to even."""
    days, hours = s / 86400, s / 3600
    h = F.bround(hours).cast("bigint")
    d = F.when(days < 10, F.bround(days, 1)).otherwise(F.bround(days))
    number = F.when(d == F.floor(d), d.cast("bigint").cast("string")).otherwise(F.format_string("%.1f", d))
    return (
        F.when((days < 1) & ~precise, "same day")
        .when((days < 1) & (hours < 1), "under an hour")
        .when(days < 1, F.concat(h.cast("string"), F.when(h != 1, " hours").otherwise(" hour")))
        .otherwise(F.concat(number, F.when(d != 1, " days").otherwise(" day")))
    )
