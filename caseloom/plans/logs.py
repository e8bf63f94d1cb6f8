"""The driver's tables as event logs, and the same as SQL common table expressions for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import traces as T

GAP = 12 * 3600
#: For questions about the usual path: sessions long enough to have one.
LONG_GAP = 36 * 3600


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def event_log(spark: SparkSession, sf: str, gap: float = GAP) -> DataFrame:
    """EV: events cut into sessions per user; a run's kind is whether a machine drove it (every tenth user is one)."""
    e = table(spark, sf, "events").select("event_id", "user_id", "ts", F.col("event_type").alias("activity"), "value")
    s = T.split_sessions(e, ["user_id"], "ts", "event_id", gap)
    return s.select(F.concat_ws("#", "user_id", "session").alias("case_id"), "activity", "ts", F.col("event_id").alias("seq"), F.col("user_id").cast("string").alias("actor"), "user_id", "value", F.when(F.col("user_id") % 10 == 0, "automated").otherwise("human").alias("kind"))


def event_runs(spark: SparkSession, sf: str, gap: float = GAP) -> DataFrame:
    """(kind, key, steps folded, trace, shape) of EV."""
    t = T.build_traces(event_log(spark, sf, gap), extra=[F.first("kind").alias("kind")])
    t = t.select("kind", F.col("case_id").alias("key"), T.fold("steps").alias("steps"))
    t = t.withColumn("trace", T.activities("steps"))
    return t.withColumn("shape", T.shape("trace"))


def event_traces(spark: SparkSession, sf: str) -> DataFrame:
    """(kind, case_id, trace) of EV, simultaneous twins collapsed."""
    t = T.build_traces(event_log(spark, sf), extra=[F.first("kind").alias("kind")])
    return t.select("kind", "case_id", T.activities(T.collapse("steps")).alias("trace"), "order_status")


#: e: the log, ordered within runs by (ts, seq), rank being 9 for all of its actions.
EV = """ev0 AS (SELECT event_id, user_id, ts, event_type AS activity, value, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events),
ev1 AS (SELECT *, sum(CASE WHEN p IS NULL OR epoch_us(ts) - epoch_us(p) > 43200000000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM ev0),
ev AS (SELECT user_id || '#' || session AS case_id, activity, ts, event_id AS seq, user_id, value, CASE WHEN user_id % 10 = 0 THEN 'automated' ELSE 'human' END AS kind FROM ev1)"""

#: c: collapsed steps with place i; tr: one row a run with its trace; sh: with its shape.
TRACES = EV + """,
c0 AS (SELECT *, lag(activity) OVER w AS pa, lag(ts) OVER w AS pt FROM ev WINDOW w AS (PARTITION BY case_id ORDER BY ts, seq)),
c AS (SELECT kind, case_id, activity, ts, row_number() OVER (PARTITION BY case_id ORDER BY ts, seq) AS i FROM c0 WHERE pa IS NULL OR pa <> activity OR pt <> ts),
f AS (SELECT case_id, activity, min(i) AS i FROM c GROUP BY ALL),
sh0 AS (SELECT case_id, string_agg(activity, '>' ORDER BY i) AS shape, count(*) AS length FROM f GROUP BY case_id),
tr AS (SELECT kind, case_id, string_agg(activity, '>' ORDER BY i) AS trace FROM c GROUP BY kind, case_id),
sh AS (SELECT tr.kind, tr.case_id, tr.trace, sh0.shape, sh0.length FROM tr JOIN sh0 USING (case_id))"""

#: b: folded steps (one a block of equal activities) with place i; rn: one row a run; bf: first place of each step.
RUNS = EV + """,
b0 AS (SELECT *, lag(activity) OVER (PARTITION BY case_id ORDER BY ts, seq) AS pa FROM ev),
b AS (SELECT kind, case_id AS key, activity, ts, row_number() OVER (PARTITION BY case_id ORDER BY ts, seq) AS i FROM b0 WHERE pa IS NULL OR pa <> activity),
bf0 AS (SELECT kind, key, activity, min(i) AS i0, count(*) AS times FROM b GROUP BY ALL),
bf AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY i0) AS i FROM bf0),
rn AS (SELECT kind, key, string_agg(activity, '>' ORDER BY i) AS shape, count(*) AS length, sum(times) AS blocks FROM bf GROUP BY kind, key)"""

LONG_RUNS = RUNS.replace(str(GAP * 10**6), str(LONG_GAP * 10**6))


def order_log(spark: SparkSession, sf: str) -> DataFrame:
    """OL: orders as a tracker with their lines as a second sheet that refers to them."""
    o = table(spark, sf, "orders").select(F.concat(F.lit("order:"), F.col("o_orderkey").cast("string")).alias("case_id"), F.lit("ordered").alias("activity"), F.col("o_orderdate").alias("ts"), F.lit(0).cast("bigint").alias("seq"))
    l = table(spark, sf, "lineitem").select(F.concat(F.lit("order:"), F.col("l_orderkey").cast("string")).alias("case_id"), F.lit("shipped").alias("activity"), F.col("l_shipdate").alias("ts"), F.col("l_linenumber").cast("bigint").alias("seq"))
    return o.unionByName(l)


OL = """ol AS (SELECT 'order:' || o_orderkey AS case_id, 'ordered' AS activity, o_orderdate AS ts, 0 AS seq FROM orders
UNION ALL SELECT 'order:' || l_orderkey, 'shipped', l_shipdate, l_linenumber FROM lineitem)"""


def conversation_log(spark: SparkSession, sf: str) -> DataFrame:
    """CV: turns in order, without times."""
    return table(spark, sf, "conversations").select(F.concat(F.lit("conv:"), F.col("conv_id").cast("string")).alias("case_id"), F.col("role").alias("activity"), F.lit(None).cast("timestamp").alias("ts"), F.col("turn").alias("seq"), "text")
