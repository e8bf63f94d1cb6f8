"""Queries over traces, variants, graphs and performance."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import performance as P
from ..operators import summaries as U
from ..operators import traces as T
from .logs import EV, LONG_GAP, LONG_RUNS, OL, RUNS, TRACES, conversation_log, event_log, event_runs, event_traces, order_log, table
from .register import query

KIND = ["kind"]


@query("long_log_events", "SELECT 'user:' || user_id AS entity_id, 'ev:' || event_id AS event_id, event_type AS action, ts, user_id::VARCHAR AS actor FROM events")
def long_log_events(spark, sf) -> DataFrame:
    return table(spark, sf, "events").select(F.concat(F.lit("user:"), F.col("user_id").cast("string")).alias("entity_id"), F.concat(F.lit("ev:"), F.col("event_id").cast("string")).alias("event_id"), F.col("event_type").alias("action"), "ts", F.col("user_id").cast("string").alias("actor"))


@query("session_split", f"WITH {EV} SELECT case_id, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts FROM ev GROUP BY case_id")
def session_split(spark, sf) -> DataFrame:
    return event_log(spark, sf).groupBy("case_id").agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


@query(
    "session_adaptive",
    """WITH g AS (SELECT user_id, event_id, ts, floor((epoch_us(ts) - epoch_us(lag(ts) OVER w)) / 86400000000.0) AS gap FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
r AS (SELECT user_id, greatest(1.0, coalesce(median(gap) FILTER (WHERE gap <= 1), 0) * 10) AS bar FROM g GROUP BY user_id),
s AS (SELECT g.user_id, g.event_id, 1 + sum((coalesce(gap, 0) > bar)::INT) OVER (PARTITION BY g.user_id ORDER BY ts, event_id) AS session FROM g JOIN r USING (user_id))
SELECT user_id, session::BIGINT AS session, count(*) AS n FROM s GROUP BY ALL""",
)
def session_adaptive(spark, sf) -> DataFrame:
    s = T.split_quiet(table(spark, sf, "events"), ["user_id"], "ts", "event_id", floor_days=1)
    return s.groupBy("user_id", F.col("session").cast("bigint").alias("session")).agg(F.count(F.lit(1)).alias("n"))


@query("trace_order", "SELECT user_id, string_agg(event_type, '>' ORDER BY ts, event_id) AS trace FROM events GROUP BY user_id")
def trace_order(spark, sf) -> DataFrame:
    e = table(spark, sf, "events").select(F.col("user_id"), F.col("event_type").alias("activity"), "ts", F.col("event_id").alias("seq"))
    return T.build_traces(e, "user_id").select("user_id", T.text(T.activities("steps")).alias("trace"))


@query(
    "trace_collapse",
    """WITH d AS (SELECT user_id, event_type AS a, date_trunc('day', ts) AS d, event_id FROM events),
l AS (SELECT *, lag(a) OVER w AS pa, lag(d) OVER w AS pd FROM d WINDOW w AS (PARTITION BY user_id ORDER BY d, event_id))
SELECT user_id, count(*) AS steps, string_agg(a, '>' ORDER BY d, event_id) AS trace FROM l WHERE pa IS NULL OR a <> pa OR d <> pd GROUP BY user_id""",
)
def trace_collapse(spark, sf) -> DataFrame:
    e = table(spark, sf, "events").select("user_id", F.col("event_type").alias("activity"), F.date_trunc("day", "ts").alias("ts"), F.col("event_id").alias("seq"))
    t = T.build_traces(e, "user_id").withColumn("steps", T.collapse("steps"))
    return t.select("user_id", F.size("steps").cast("bigint").alias("steps"), T.text(T.activities("steps")).alias("trace"))


@query("activity_fold", f"WITH {RUNS} SELECT kind, key, string_agg(activity, '>' ORDER BY i) AS trace, count(*) AS blocks FROM b GROUP BY kind, key")
def activity_fold(spark, sf) -> DataFrame:
    return event_runs(spark, sf).select("kind", "key", T.text("trace").alias("trace"), F.size("trace").cast("bigint").alias("blocks"))


@query("trace_shape", f"WITH {TRACES} SELECT case_id, shape, length FROM sh")
def trace_shape(spark, sf) -> DataFrame:
    t = event_traces(spark, sf).withColumn("s", T.shape("trace"))
    return t.select("case_id", T.text("s").alias("shape"), F.size("s").cast("bigint").alias("length"))


@query(
    "order_status",
    f"""WITH {OL}, a AS (SELECT case_id, ts FROM ol UNION ALL SELECT 'conv:' || conv_id, NULL FROM conversations)
SELECT CASE WHEN count(ts) = 0 THEN 'unknown' WHEN count(ts) < count(*) THEN 'partial' ELSE 'ordered' END AS order_status, case_id FROM a GROUP BY case_id""",
)
def order_status(spark, sf) -> DataFrame:
    log = order_log(spark, sf).select("case_id", "ts").unionByName(conversation_log(spark, sf).select("case_id", "ts"))
    return log.groupBy("case_id").agg(T.order_status(F.count("ts"), F.count(F.lit(1))).alias("order_status"))


_VARIANTS = f"""WITH {TRACES}, v AS (SELECT kind, shape, length, count(*) AS frequency, count(DISTINCT trace) AS exact_traces, min(case_id) AS first_case FROM sh GROUP BY ALL),
t AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY frequency DESC, length, shape) = 1 AS top FROM v)
SELECT kind, shape, length, frequency, exact_traces, first_case, CASE WHEN list_contains(string_split(shape, '>'), 'reverted') OR (frequency > 1 AND NOT top) THEN 'exception'
 WHEN top AND frequency > 1 THEN 'common' WHEN frequency = 1 THEN 'one-off' ELSE 'common' END AS role FROM t"""


@query("variants", _VARIANTS)
def variants(spark, sf) -> DataFrame:
    return T.variants(event_traces(spark, sf), KIND).withColumn("length", F.col("length").cast("bigint"))


@query("variant_roles", f"SELECT kind, role, count(*) AS variants, sum(frequency)::BIGINT AS runs FROM ({_VARIANTS}) GROUP BY kind, role")
def variant_roles(spark, sf) -> DataFrame:
    return T.variants(event_traces(spark, sf), KIND).groupBy("kind", "role").agg(F.count(F.lit(1)).alias("variants"), F.sum("frequency").alias("runs"))


@query("variant_exact_traces", f"WITH {TRACES} SELECT kind, shape, trace, count(*) AS frequency FROM sh GROUP BY ALL")
def variant_exact_traces(spark, sf) -> DataFrame:
    return T.exact_traces(event_traces(spark, sf), KIND)


@query("dfg_nodes", f"WITH {TRACES} SELECT kind, activity, count(*) AS n FROM c GROUP BY ALL")
def dfg_nodes(spark, sf) -> DataFrame:
    return T.dfg_nodes(event_traces(spark, sf), KIND)


@query(
    "dfg_edges",
    f"""WITH {TRACES}, e AS (SELECT kind, coalesce(lag(activity) OVER w, '__start__') AS from_activity, activity AS to_activity FROM c WINDOW w AS (PARTITION BY case_id ORDER BY i)
UNION ALL SELECT kind, last(activity ORDER BY i), '__end__' FROM c GROUP BY kind, case_id) SELECT kind, from_activity, to_activity, count(*) AS n FROM e GROUP BY ALL""",
)
def dfg_edges(spark, sf) -> DataFrame:
    return T.dfg_edges(event_traces(spark, sf), KIND)


@query("activity_catalogue", "SELECT event_type AS activity, count(*) AS n, count(DISTINCT user_id) AS actors, min(event_id) AS sample FROM events GROUP BY event_type")
def activity_catalogue(spark, sf) -> DataFrame:
    e = table(spark, sf, "events").select(F.col("event_type").alias("activity"), F.col("user_id").alias("actor"), "event_id")
    return U.activity_catalogue(e, "event_id")


@query("same_activity_merge", "SELECT l_orderkey AS entity, l_returnflag AS action, l_shipdate AS ts, count(*) AS records, count(DISTINCT l_suppkey) AS actors FROM lineitem GROUP BY ALL HAVING count(DISTINCT l_suppkey) >= 2")
def same_activity_merge(spark, sf) -> DataFrame:
    l = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("entity"), F.col("l_returnflag").alias("action"), F.col("l_shipdate").alias("ts"), F.col("l_suppkey").alias("actor"))
    return U.same_activity_merges(l)


_CANON = """q AS (SELECT kind, activity AS step, count(*) AS runs_with, round(avg((i - 1) / greatest(1, length - 1)), 9) AS mean_place FROM bf JOIN rn USING (kind, key) GROUP BY ALL),
qn AS (SELECT kind, count(*) AS runs FROM rn GROUP BY kind),
q2 AS (SELECT q.*, qn.runs, count(*) OVER (PARTITION BY kind) AS k FROM q JOIN qn USING (kind) WHERE runs_with > runs * 0.5),
canon AS (SELECT kind, step, runs_with, runs, mean_place, row_number() OVER (PARTITION BY kind ORDER BY mean_place, step) AS place FROM q2 WHERE k >= 2)"""


@query("canonical_path", f"WITH {LONG_RUNS}, {_CANON} SELECT kind, step, place, runs_with, runs, mean_place FROM canon")
def canonical_path(spark, sf) -> DataFrame:
    return P.canonical_path(event_runs(spark, sf, LONG_GAP), KIND).withColumn("place", F.col("place").cast("bigint"))


@query(
    "missing_step_gaps",
    f"""WITH {LONG_RUNS}, {_CANON}, r AS (SELECT rn.kind, rn.key, max(place) AS latest FROM rn JOIN bf USING (kind, key) JOIN canon ON canon.kind = rn.kind AND canon.step = bf.activity GROUP BY ALL)
SELECT r.kind, r.key, c.step AS missing, l.step AS reached FROM r JOIN canon c ON c.kind = r.kind AND c.place < r.latest JOIN canon l ON l.kind = r.kind AND l.place = r.latest
WHERE NOT EXISTS (SELECT 1 FROM bf WHERE bf.key = r.key AND bf.activity = c.step)""",
)
def missing_step_gaps(spark, sf) -> DataFrame:
    runs = event_runs(spark, sf, LONG_GAP)
    return P.missing_steps(runs, P.canonical_path(runs, KIND), KIND)


_CYCLE = """cy0 AS (SELECT kind, key, (epoch_us(last(ts ORDER BY i)) - epoch_us(first(ts ORDER BY i))) / 1e6 AS s, count(*) AS n FROM b GROUP BY kind, key),
cy AS (SELECT kind, key, CASE WHEN n >= 2 AND s >= 0 THEN s END AS cycle_s FROM cy0)"""
_WAITS = """w0 AS (SELECT kind, key, i, activity AS a, lead(activity) OVER w AS z, (epoch_us(lead(ts) OVER w) - epoch_us(ts)) / 1e6 AS s FROM b WINDOW w AS (PARTITION BY key ORDER BY i)),
w1 AS (SELECT kind, key, a AS from_step, z AS to_step, arg_min(s, i) AS wait_s FROM w0 WHERE a <> z AND s >= 0 GROUP BY ALL),
w2 AS (SELECT kind, from_step, to_step, count(*) AS measured, median(wait_s) AS median_s, sum(wait_s) AS total_s FROM w1 GROUP BY ALL HAVING count(*) >= 5),
wt AS (SELECT w2.*, round_even(100 * total_s / all_s, 0)::BIGINT AS share_pct FROM w2 JOIN (SELECT kind, sum(cycle_s) AS all_s FROM cy GROUP BY kind) USING (kind))"""


@query(
    "cycle_time",
    f"""WITH {RUNS}, {_CYCLE}, g AS (SELECT kind, count(*) AS "of", count(cycle_s) AS measured, median(cycle_s) AS median_s, list_sort(list(cycle_s) FILTER (WHERE cycle_s IS NOT NULL)) AS v FROM cy GROUP BY kind)
SELECT kind, "of", measured, round_even(100.0 * measured / "of", 0)::BIGINT AS coverage_pct, round(median_s, 3) AS median_s, round(v[(round_even((measured - 1) * 0.9, 0) + 1)::INT], 3) AS slow_s FROM g""",
)
def cycle_time(spark, sf) -> DataFrame:
    return P.cycle_time(event_runs(spark, sf), KIND).withColumns({c: F.round(c, 3) for c in ("median_s", "slow_s")})


@query("wait_times", f"WITH {RUNS}, {_CYCLE}, {_WAITS} SELECT kind, from_step, to_step, measured, round(median_s, 3) AS median_s, round(total_s, 3) AS total_s, share_pct FROM wt")
def wait_times(spark, sf) -> DataFrame:
    return P.wait_times(event_runs(spark, sf), KIND).withColumns({c: F.round(c, 3) for c in ("median_s", "total_s")})


_USUAL = """u0 AS (SELECT kind, shape, length, count(*) AS n FROM rn GROUP BY ALL),
u1 AS (SELECT *, sum(n) OVER p AS runs, max(n) OVER p AS most, row_number() OVER (PARTITION BY kind ORDER BY n DESC, length DESC, shape) AS rl, row_number() OVER (PARTITION BY kind ORDER BY n DESC, length, shape) AS rs FROM u0 WINDOW p AS (PARTITION BY kind)),
usual AS (SELECT kind, shape AS canon FROM u1 WHERE CASE WHEN most > 1 THEN rl WHEN runs < 4 THEN rs END = 1)"""
_ROUTE = f"""{_USUAL}, rt AS (SELECT kind, string_split(canon, '>')[-1] AS final_step, count(*) AS "of", count(*) FILTER (WHERE shape <> canon) AS off_route,
count(*) FILTER (WHERE NOT list_contains(string_split(shape, '>'), string_split(canon, '>')[-1])) AS not_completed FROM rn JOIN usual USING (kind) GROUP BY ALL)"""


@query("off_route", f"""WITH {RUNS}, {_ROUTE} SELECT kind, "of", off_route, round_even(100.0 * off_route / "of", 0)::BIGINT AS off_pct FROM rt""")
def off_route(spark, sf) -> DataFrame:
    runs = event_runs(spark, sf)
    return P.route(runs, P.usual_shape(runs, KIND), KIND).select("kind", "of", "off_route", "off_pct")


@query("not_completed", f"""WITH {RUNS}, {_ROUTE} SELECT kind, final_step, "of", not_completed, round_even(100.0 * not_completed / "of", 0)::BIGINT AS open_pct FROM rt""")
def not_completed(spark, sf) -> DataFrame:
    runs = event_runs(spark, sf)
    return P.route(runs, P.usual_shape(runs, KIND), KIND).select("kind", "final_step", "of", "not_completed", "open_pct")


@query(
    "skipped_steps",
    f"""WITH {RUNS}, {_USUAL}, s AS (SELECT rn.kind, rn.key, unnest(string_split(canon, '>')) AS step, rn.shape FROM rn JOIN usual USING (kind) WHERE rn.shape <> canon)
SELECT kind, step, count(*) AS n FROM s WHERE NOT list_contains(string_split(shape, '>'), step) GROUP BY ALL""",
)
def skipped_steps(spark, sf) -> DataFrame:
    runs = event_runs(spark, sf)
    return P.skipped(runs, P.usual_shape(runs, KIND), KIND)


@query("rework", f"""WITH {RUNS} SELECT kind, count(*) AS "of", count(*) FILTER (WHERE blocks <> length) AS rework, round_even(100.0 * count(*) FILTER (WHERE blocks <> length) / count(*), 0)::BIGINT AS rework_pct FROM rn GROUP BY kind""")
def rework(spark, sf) -> DataFrame:
    return P.rework(event_runs(spark, sf), KIND)


@query("redone_steps", f"WITH {RUNS} SELECT kind, activity AS step, count(*) AS n FROM bf WHERE times > 1 GROUP BY ALL")
def redone_steps(spark, sf) -> DataFrame:
    return P.redone(event_runs(spark, sf), KIND)


@query(
    "bottleneck",
    f"""WITH {RUNS}, {_CYCLE}, {_WAITS}, {_ROUTE}, h AS (SELECT kind, count(*) AS n, arg_max(share_pct, {{'a': total_s, 'b': median_s}}) AS share FROM wt GROUP BY kind),
k AS (SELECT kind, count(*) AS runs, round_even(100.0 * count(*) FILTER (WHERE blocks <> length) / count(*), 0) AS rework_pct FROM rn GROUP BY kind)
SELECT k.kind, CASE WHEN k.runs < 5 THEN 'insufficient' WHEN h.n >= 2 AND h.share >= 30 THEN 'bottleneck' WHEN round_even(100.0 * off_route / "of", 0) >= 15 THEN 'exception' WHEN k.rework_pct >= 10 THEN 'rework' ELSE 'steady' END AS headline
FROM k LEFT JOIN h USING (kind) LEFT JOIN rt USING (kind)""",
)
def bottleneck(spark, sf) -> DataFrame:
    runs = event_runs(spark, sf)
    return P.headline(runs, P.usual_shape(runs, KIND), KIND)


@query(
    "deviation_class",
    f"""WITH {LONG_RUNS}, {_CANON}, {_USUAL}, r AS (SELECT bf.key, max(place) AS latest FROM bf JOIN canon ON canon.kind = bf.kind AND canon.step = bf.activity GROUP BY bf.key),
m AS (SELECT DISTINCT r.key FROM r JOIN rn USING (key) JOIN canon c ON c.kind = rn.kind AND c.place < r.latest WHERE NOT EXISTS (SELECT 1 FROM bf WHERE bf.key = r.key AND bf.activity = c.step))
SELECT rn.kind, rn.key, CASE WHEN rn.kind = 'automated' THEN 'automated' WHEN m.key IS NOT NULL THEN 'missing' WHEN NOT list_contains(string_split(rn.shape, '>'), string_split(canon, '>')[-1]) THEN 'ended' WHEN rn.shape = canon THEN 'usual' ELSE 'other' END AS deviation
FROM rn LEFT JOIN usual USING (kind) LEFT JOIN m ON m.key = rn.key""",
)
def deviation_class(spark, sf) -> DataFrame:
    return U.deviations(event_runs(spark, sf, LONG_GAP), KIND, F.col("kind") == "automated").select("kind", "key", "deviation")


@query(
    "path_label",
    f"""WITH {RUNS}, {_USUAL} SELECT rn.key, CASE WHEN rn.shape = canon THEN 'most common' WHEN starts_with(canon, rn.shape || '>') THEN 'ended at ' || string_split(rn.shape, '>')[-1]
 WHEN len(list_filter(string_split(canon, '>'), lambda x: NOT list_contains(string_split(rn.shape, '>'), x))) = 1 THEN 'no ' || list_filter(string_split(canon, '>'), lambda x: NOT list_contains(string_split(rn.shape, '>'), x))[1] || ' step'
 WHEN len(list_filter(string_split(canon, '>'), lambda x: NOT list_contains(string_split(rn.shape, '>'), x))) > 1 THEN 'fewer steps' ELSE 'different order' END AS label FROM rn JOIN usual USING (kind)""",
)
def path_label(spark, sf) -> DataFrame:
    return U.path_labels(event_runs(spark, sf), KIND).select("key", "label")


@query("kind_flow", f"WITH {RUNS} SELECT kind, activity AS step, round(coalesce(avg((i - 1) / (length - 1)) FILTER (WHERE length >= 2), 1.1), 9) AS place FROM bf JOIN rn USING (kind, key) GROUP BY ALL")
def kind_flow(spark, sf) -> DataFrame:
    return U.kind_flow(event_runs(spark, sf), KIND).withColumn("place", F.round("place", 9))


@query("step_support", f"WITH {RUNS} SELECT bf.kind, activity AS step, count(*) AS found, any_value(t.n) AS runs FROM bf JOIN (SELECT kind, count(*) AS n FROM rn GROUP BY kind) t USING (kind) GROUP BY ALL")
def step_support(spark, sf) -> DataFrame:
    return U.step_support(event_runs(spark, sf), KIND)


@query(
    "transport_ratio",
    f"""WITH {EV}, a AS (SELECT 'events' AS source, case_id, activity FROM ev UNION ALL SELECT 'conversations', 'conv:' || conv_id, role FROM conversations),
r AS (SELECT source, case_id, count(*) / count(DISTINCT activity) AS ratio, count(*) AS n FROM a GROUP BY ALL)
SELECT source, count(*) AS runs, median(ratio) AS median_ratio, count(*) >= 10 AND median(ratio) >= 2.0 AS needs_reading FROM r WHERE n > 1 GROUP BY source""",
)
def transport_ratio(spark, sf) -> DataFrame:
    a = event_log(spark, sf).select(F.lit("events").alias("source"), "case_id", "activity").unionByName(conversation_log(spark, sf).select(F.lit("conversations").alias("source"), "case_id", "activity"))
    return U.transport_ratio(a, ["source"])


@query(
    "duration_words",
    f"""WITH {RUNS}, {_CYCLE} SELECT key, CASE WHEN cycle_s < 3600 THEN 'under an hour' WHEN cycle_s < 86400 THEN round_even(cycle_s / 3600, 0)::BIGINT || CASE WHEN round_even(cycle_s / 3600, 0) <> 1 THEN ' hours' ELSE ' hour' END
ELSE (CASE WHEN d = floor(d) THEN d::BIGINT::VARCHAR ELSE printf('%.1f', d) END) || CASE WHEN d <> 1 THEN ' days' ELSE ' day' END END AS took
FROM (SELECT key, cycle_s, CASE WHEN cycle_s / 86400 < 10 THEN round_even(cycle_s / 86400, 1) ELSE round_even(cycle_s / 86400, 0) END AS d FROM cy WHERE cycle_s IS NOT NULL)""",
)
def duration_words(spark, sf) -> DataFrame:
    return P.cycles(event_runs(spark, sf)).filter("cycle_s is not null").select("key", P.human_duration(F.col("cycle_s"), F.lit(True)).alias("took"))


@query(
    "flow_waits",
    f"""WITH {LONG_RUNS}, {_CYCLE}, {_WAITS}, {_CANON} SELECT a.kind, a.step AS from_step, z.step AS to_step, round(wt.median_s, 3) AS median_s, wt.measured FROM canon a JOIN canon z ON z.kind = a.kind AND z.place = a.place + 1
LEFT JOIN wt ON wt.kind = a.kind AND wt.from_step = a.step AND wt.to_step = z.step""",
)
def flow_waits(spark, sf) -> DataFrame:
    return U.flow_waits(event_runs(spark, sf, LONG_GAP), KIND).withColumn("median_s", F.round("median_s", 3))



