"""Queries over sources, links, components, cases, gaps and kinds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import gaps as G
from ..operators import graph, kinds, linking
from ..operators import traces as T
from .logs import EV, conversation_log, event_log, order_log, table
from .register import query


@query(
    "wide_unpivot_events",
    """SELECT 'order:' || o_orderkey AS case_id, 'ordered' AS action, o_orderdate AS ts FROM orders
UNION ALL SELECT 'order:' || o_orderkey, 'due', o_orderdate + INTERVAL 30 DAY FROM orders WHERE o_orderstatus <> 'P'""",
)
def wide_unpivot_events(spark, sf) -> DataFrame:
    from ..sources.tracker import unpivot_dates

    o = table(spark, sf, "orders").select(F.concat(F.lit("order:"), F.col("o_orderkey").cast("string")).alias("case_id"), F.col("o_orderdate").alias("ordered"), F.when(F.col("o_orderstatus") != "P", F.col("o_orderdate") + F.expr("interval 30 days")).alias("due"))
    return unpivot_dates(o, "case_id", {"ordered": "ordered", "due": "due"})


@query(
    "wide_duplicate_rows",
    """SELECT l_orderkey || ':' || l_linenumber AS id, row_number() OVER w AS occurrence, count(*) OVER (PARTITION BY l_orderkey, l_linenumber) AS n_rows, count(*) OVER (PARTITION BY l_orderkey, l_linenumber) > 1 AS duplicate_id, l_extendedprice
FROM lineitem WINDOW w AS (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_discount, l_tax)""",
)
def wide_duplicate_rows(spark, sf) -> DataFrame:
    l = table(spark, sf, "lineitem").withColumn("id", F.concat_ws(":", "l_orderkey", "l_linenumber"))
    w = Window.partitionBy("id")
    o = w.orderBy("l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_discount", "l_tax")
    n = F.count(F.lit(1)).over(w)
    return l.select("id", F.row_number().over(o).cast("bigint").alias("occurrence"), n.alias("n_rows"), (n > 1).alias("duplicate_id"), "l_extendedprice")


@query("source_union_counts", "SELECT source, count(*) AS n FROM (SELECT 'orders' AS source FROM orders UNION ALL SELECT 'events' FROM events UNION ALL SELECT 'conversations' FROM conversations) GROUP BY source")
def source_union_counts(spark, sf) -> DataFrame:
    parts = [table(spark, sf, t).select(F.lit(t).alias("source")) for t in ("orders", "events", "conversations")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("source").agg(F.count(F.lit(1)).alias("n"))


@query("person_registry", "SELECT 'person:' || user_id AS person_id, count(*) AS n, arg_min(event_type, event_id) AS first_seen, arg_max(event_type, event_id) AS last_seen, max(user_id % 10 = 0) AS is_bot FROM events GROUP BY user_id")
def person_registry(spark, sf) -> DataFrame:
    from ..sources.people import registry

    e = table(spark, sf, "events").select(F.concat(F.lit("person:"), F.col("user_id").cast("string")).alias("person_id"), F.col("event_type").alias("name"), (F.col("user_id") % 10 == 0).alias("is_bot"), F.col("event_id").alias("seq"))
    return registry(e)


@query("reconciliation_gaps", "SELECT 'order:' || o_orderkey AS case_id, 'reconciliation' AS kind FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def reconciliation_gaps(spark, sf) -> DataFrame:
    return G.reconciliation(order_log(spark, sf), "ordered", "shipped")


@query("dangling_refs", "SELECT 'line:' || l_orderkey || ':' || l_linenumber AS src, 'part:' || l_partkey AS target, count(*) AS n FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size <= 45) GROUP BY ALL")
def dangling_refs(spark, sf) -> DataFrame:
    p = table(spark, sf, "part").filter("p_size <= 45").select(F.concat(F.lit("part:"), F.col("p_partkey").cast("string")).alias("entity_id"))
    l = table(spark, sf, "lineitem").select(F.concat(F.lit("line:"), F.concat_ws(":", "l_orderkey", "l_linenumber")).alias("src"), F.concat(F.lit("part:"), F.col("l_partkey").cast("string")).alias("target"))
    return G.unresolved(l, p).groupBy("src", "target").agg(F.count(F.lit(1)).alias("n"))


@query("handoff_gaps", "SELECT l_orderkey AS entity, l_linenumber AS line, floor((epoch_us(l_shipdate) - epoch_us(o_orderdate)) / 86400000000.0)::BIGINT AS days FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE epoch_us(l_shipdate) - epoch_us(o_orderdate) >= 86400000000")
def handoff_gaps(spark, sf) -> DataFrame:
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("entity"), F.col("o_orderdate").alias("authored"))
    l = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("entity"), F.col("l_linenumber").alias("line"), F.col("l_shipdate").alias("committed"))
    return G.delays(o.join(l, "entity"), "authored", "committed", 1).select("entity", "line", "days")


@query("orphans", "SELECT c_custkey AS entity, CASE WHEN c_acctbal < 0 THEN 'in debt and without a large order' ELSE 'no record refers to it' END AS reason FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
def orphans(spark, sf) -> DataFrame:
    c = table(spark, sf, "customer").join(table(spark, sf, "orders").filter("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti")
    return c.select(F.col("c_custkey").alias("entity"), F.when(F.col("c_acctbal") < 0, "in debt and without a large order").otherwise("no record refers to it").alias("reason"))


@query("fk_correlation", "SELECT 'order:' || o_orderkey AS case_id, count(l_orderkey) AS lines, sum(l_quantity) AS quantity, any_value(c_mktsegment) AS segment FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY o_orderkey")
def fk_correlation(spark, sf) -> DataFrame:
    # lines are summed before they meet their orders: one row a key crosses the join
    l = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("lines"), F.sum("l_quantity").alias("quantity"))
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey").join(l, "o_orderkey", "left").join(table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("segment")), "o_custkey")
    return o.select(F.concat(F.lit("order:"), F.col("o_orderkey").cast("string")).alias("case_id"), F.coalesce("lines", F.lit(0)).alias("lines"), "quantity", "segment")


def _order_world(spark, sf):
    """Finished and open orders and all lines as entities and links: lines refer to their order, orders claim to be runs."""
    o = table(spark, sf, "orders").filter("o_orderstatus <> 'P'").select(F.concat(F.lit("order:"), F.col("o_orderkey").cast("string")).alias("entity_id"), F.lit("order").alias("type"))
    lk = table(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_returnflag").alias("flag"))
    l = lk.select(F.concat(F.lit("line:"), F.concat_ws(":", "l_orderkey", "l_linenumber")).alias("entity_id"), F.lit("line").alias("type"), F.col("l_orderkey"), "flag", "l_linenumber")
    blank = [F.lit(None).cast("string").alias("materialise"), F.lit(False).alias("virtual")]
    own = o.select(F.col("entity_id").alias("src"), F.col("entity_id").alias("target"), F.lit("row-identity").alias("method"), F.lit(4).alias("tier"), F.lit("own row").alias("rationale"), *blank, F.lit(True).alias("anchors"), F.lit(5).alias("anchor_rank"), F.lit(False).alias("fallback"), F.lit(0).cast("bigint").alias("decl_seq"))
    ref = l.select(F.col("entity_id").alias("src"), F.concat(F.lit("order:"), F.col("l_orderkey").cast("string")).alias("target"), F.lit("foreign-key").alias("method"), F.when(F.col("flag") == "A", 2).otherwise(3).alias("tier"), F.concat(F.lit("flag "), F.col("flag")).alias("rationale"), *blank, F.lit(True).alias("anchors"), F.lit(0).alias("anchor_rank"), F.lit(False).alias("fallback"), F.col("l_linenumber").cast("bigint").alias("decl_seq"))
    entities = o.select("entity_id", "type").unionByName(l.select("entity_id", "type"))
    return entities, entities.withColumn("n", F.lit(1).cast("bigint")), own.unionByName(ref)


_WORLD = """o AS (SELECT o_orderkey AS k FROM orders WHERE o_orderstatus <> 'P'),
l AS (SELECT l_orderkey AS k, l_linenumber AS n, min(l_returnflag) AS flag FROM lineitem GROUP BY ALL)"""


@query("case_members", f"WITH {_WORLD} SELECT 'case:order:' || k AS case_id, 'order:' || k AS entity_id FROM o UNION ALL SELECT 'case:order:' || k, 'line:' || k || ':' || n FROM l WHERE k IN (SELECT k FROM o)")
def case_members(spark, sf) -> DataFrame:
    return linking.build_cases(*_order_world(spark, sf)).members


@query(
    "weakest_link",
    f"""WITH {_WORLD}, w AS (SELECT k, min(CASE WHEN flag = 'A' THEN 2 ELSE 3 END) AS t FROM l GROUP BY k)
SELECT 'case:order:' || o.k AS case_id, CASE coalesce(w.t, 4) WHEN 2 THEN 'heuristic' WHEN 3 THEN 'joined' ELSE 'direct' END AS tier FROM o LEFT JOIN w USING (k)""",
)
def weakest_link(spark, sf) -> DataFrame:
    from ..model import tier_label

    return linking.build_cases(*_order_world(spark, sf)).cases.select("case_id", tier_label(F.col("tier")).alias("tier"))


@query("unresolved_links", f"WITH {_WORLD} SELECT 'line:' || k || ':' || n AS src, 'order:' || k AS target, 'foreign-key' AS method FROM l WHERE k NOT IN (SELECT k FROM o)")
def unresolved_links(spark, sf) -> DataFrame:
    return linking.build_cases(*_order_world(spark, sf)).unresolved


@query("loose_records", f"WITH {_WORLD} SELECT 'line:' || k || ':' || n AS entity_id FROM l WHERE k NOT IN (SELECT k FROM o)")
def loose_records(spark, sf) -> DataFrame:
    return linking.build_cases(*_order_world(spark, sf)).loose


@query(
    "anchor_election",
    """WITH n AS (SELECT l_orderkey AS comp, 'line:' || l_orderkey || ':' || l_linenumber AS node, 9 AS r, count(*) AS n FROM lineitem GROUP BY ALL UNION ALL SELECT o_orderkey, 'order:' || o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 9 ELSE 0 END, 1 FROM orders)
SELECT comp, node AS anchor FROM (SELECT *, row_number() OVER (PARTITION BY comp ORDER BY r, -n, node) AS k FROM n) WHERE k = 1""",
)
def anchor_election(spark, sf) -> DataFrame:
    l = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("comp"), F.concat(F.lit("line:"), F.concat_ws(":", "l_orderkey", "l_linenumber")).alias("node")).agg(F.count(F.lit(1)).alias("n")).withColumn("r", F.lit(9))
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("comp"), F.concat(F.lit("order:"), F.col("o_orderkey").cast("string")).alias("node"), F.lit(1).cast("bigint").alias("n"), F.when(F.col("o_orderstatus") == "P", 9).otherwise(0).alias("r"))
    return l.unionByName(o).groupBy("comp").agg(F.min_by("node", F.struct("r", -F.col("n"), "node")).alias("anchor"))


@query("first_claim_wins", "SELECT l_orderkey AS node, arg_min(l_shipmode, {'t': CASE l_shipmode WHEN 'A' THEN 0 ELSE 1 END, 'n': l_linenumber, 'p': l_partkey, 's': l_suppkey, 'e': l_extendedprice}) AS claim FROM (SELECT *, l_returnflag AS l_shipmode FROM lineitem) GROUP BY l_orderkey")
def first_claim_wins(spark, sf) -> DataFrame:
    l = table(spark, sf, "lineitem")
    order = F.struct(F.when(F.col("l_returnflag") == "A", 0).otherwise(1), "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    return l.groupBy(F.col("l_orderkey").alias("node")).agg(F.min_by("l_returnflag", order).alias("claim"))


@query(
    "connected_components",
    """WITH RECURSIVE e AS MATERIALIZED (SELECT 'o' || o_orderkey AS a, 'c' || o_custkey AS b FROM orders), n AS (SELECT a AS node FROM e UNION SELECT b FROM e), b AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r(node, seen) AS (SELECT node, node FROM n UNION SELECT r.node, b.b FROM r JOIN b ON r.seen = b.a) SELECT node, min(seen) AS component FROM r GROUP BY node""",
)
def connected_components(spark, sf) -> DataFrame:
    e = table(spark, sf, "orders").select(F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("a"), F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("b"))
    nodes = e.select(F.col("a").alias("node")).union(e.select("b")).distinct()
    return graph.connected_components(nodes, e)


_BOT = "CASE WHEN min((user_id % 10 = 0)::INT) = 1 THEN true ELSE false END"


@query("structural_kinds", f"WITH {EV}, k AS (SELECT case_id, {_BOT} AS automated, arg_min(activity, {{'t': ts, 's': seq}}) AS hint FROM ev GROUP BY case_id) SELECT automated, hint, count(*) AS cases, row_number() OVER (ORDER BY count(*) DESC, hint, automated) AS kind FROM k GROUP BY automated, hint")
def structural_kinds(spark, sf) -> DataFrame:
    return kinds.number(kinds.clusters(_cases(spark, sf), ["automated", "hint"]), ["hint", "automated"])


def _cases(spark, sf) -> DataFrame:
    log = event_log(spark, sf).withColumn("is_bot", F.col("user_id") % 10 == 0)
    return log.groupBy("case_id").agg(kinds.automated(F.col("actor"), F.col("is_bot")).alias("automated"), F.min_by("activity", F.struct("ts", "seq")).alias("hint"))


@query(
    "kind_features",
    f"""WITH {EV}, a AS (SELECT kind, activity, count(*) AS n FROM ev GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY n DESC, activity) AS k FROM a)
SELECT kind, string_agg(activity, ',' ORDER BY k) AS top_actions, sum(n)::BIGINT AS top_events FROM r WHERE k <= 4 GROUP BY kind""",
)
def kind_features(spark, sf) -> DataFrame:
    return kinds.top_actions(event_log(spark, sf), ["kind"], 4)


@query("reject_lookalikes", f"WITH {EV}, k AS (SELECT case_id, {_BOT} AS automated, arg_min(activity, {{'t': ts, 's': seq}}) AS hint FROM ev GROUP BY case_id) SELECT automated, hint, count(*) AS cases, automated AND count(*) > 1 AS rejected FROM k GROUP BY automated, hint")
def reject_lookalikes(spark, sf) -> DataFrame:
    return kinds.reject(kinds.clusters(_cases(spark, sf), ["automated", "hint"]))


@query("process_split", f"""WITH {EV}, c AS (SELECT case_id, kind, arg_min(activity, {{'t': ts, 's': seq}}) AS process, count(DISTINCT activity) AS steps FROM ev GROUP BY ALL),
t AS (SELECT kind, greatest(3, round_even(0.02 * count(*), 0))::BIGINT AS bar FROM c GROUP BY kind), g AS (SELECT kind, process, count(*) AS cases, max(steps) AS most FROM c GROUP BY ALL)
SELECT g.kind, process, cases, CASE WHEN cases >= bar THEN 'process' WHEN most >= 3 THEN 'project' ELSE 'parent' END AS placed FROM g JOIN t USING (kind)""")
def process_split(spark, sf) -> DataFrame:
    c = event_log(spark, sf).groupBy("case_id", "kind").agg(F.min_by("activity", F.struct("ts", "seq")).alias("process"), F.countDistinct("activity").alias("steps"))
    return kinds.split_by_process(c)


@query("run_systems", "WITH s AS (SELECT l_orderkey % 100 AS run, 'lines' AS source FROM lineitem UNION ALL SELECT o_orderkey % 100, 'orders' FROM orders UNION ALL SELECT event_id % 120, 'events' FROM events) SELECT run, string_agg(DISTINCT source, ',' ORDER BY source) AS sources, count(DISTINCT source) > 1 AS cross_source FROM s GROUP BY run")
def run_systems(spark, sf) -> DataFrame:
    parts = [table(spark, sf, "lineitem").select((F.col("l_orderkey") % 100).alias("run"), F.lit("lines").alias("source")), table(spark, sf, "orders").select((F.col("o_orderkey") % 100).alias("run"), F.lit("orders").alias("source")), table(spark, sf, "events").select((F.col("event_id") % 120).alias("run"), F.lit("events").alias("source"))]
    s = parts[0].unionByName(parts[1]).unionByName(parts[2]).distinct()
    g = s.groupBy("run").agg(F.sort_array(F.collect_set("source")).alias("s"))
    return g.select("run", F.array_join("s", ",").alias("sources"), (F.size("s") > 1).alias("cross_source"))


@query("observation_order", "SELECT 'conv:' || conv_id AS case_id, string_agg(turn::VARCHAR, ',' ORDER BY turn) AS ordered, 'unknown' AS order_status FROM conversations GROUP BY conv_id")
def observation_order(spark, sf) -> DataFrame:
    o = conversation_log(spark, sf).select("case_id", F.col("ts").alias("seen_at"), "seq", F.col("seq").cast("string").alias("obs_id"))
    none = order_log(spark, sf).select("case_id")
    return T.order_observations(o, none).select("case_id", F.array_join("ordered_ids", ",").alias("ordered"), "order_status")
