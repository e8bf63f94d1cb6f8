"""Queries over text, similarity, readings, decisions and views."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import dates as D
from ..functions import text as X
from ..operators import evidence as E
from ..operators import similarity as S
from ..operators import summaries as U
from .logs import EV, LONG_GAP, LONG_RUNS, event_log, event_runs, table
from .register import query

_STOP = "[" + ", ".join(f"'{w}'" for w in X.STOPWORDS) + "]"


def _tok(source: str, id_: str) -> str:
    return f"tk AS (SELECT DISTINCT id, token FROM (SELECT {id_} AS id, unnest(regexp_extract_all(lower(text), '[a-z][a-z'']+')) AS token FROM {source}) WHERE NOT list_contains({_STOP}, token))"


@query("content_tokens", f"WITH {_tok('documents', 'doc_id')} SELECT id, count(*) AS n, string_agg(token, ' ' ORDER BY token) AS tokens FROM tk GROUP BY id")
def content_tokens(spark, sf) -> DataFrame:
    t = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), X.content_tokens(F.col("text")).alias("t"))
    return t.filter(F.size("t") > 0).select("id", F.size("t").cast("bigint").alias("n"), F.array_join(F.array_sort("t"), " ").alias("tokens"))


@query("token_idf", f"WITH {_tok('documents', 'doc_id')} SELECT token, count(*) AS df, round(greatest(0, ln((SELECT count(*) FROM documents) / count(*))), 9) AS idf FROM tk GROUP BY token")
def token_idf(spark, sf) -> DataFrame:
    d = table(spark, sf, "documents")
    t = d.select(F.col("doc_id").alias("id"), F.explode(X.content_tokens(F.col("text"))).alias("token"))
    return S.token_idf(t, d.agg(F.count(F.lit(1)).alias("n"))).withColumn("idf", F.round("idf", 9))


@query("strong_tokens")
def strong_tokens(spark, sf) -> DataFrame:
    t = table(spark, sf, "documents").select("doc_id", F.explode(X.strong_tokens(F.col("text"))).alias("token"))
    return t.groupBy("token").agg(F.count(F.lit(1)).alias("df"))


@query(
    "similar_pairs",
    f"""WITH r AS (SELECT 0 AS side, item_id AS id, text FROM benchmark UNION ALL SELECT 1, doc_id, text FROM documents), n AS (SELECT count(*) AS n FROM r),
tk AS (SELECT DISTINCT side, id, token FROM (SELECT side, id, unnest(regexp_extract_all(lower(regexp_replace(text, '[^A-Za-z'' ]', ' ', 'g')), '[a-z][a-z'']+')) AS token FROM r) WHERE NOT list_contains({_STOP}, token)),
w AS (SELECT token, ln((SELECT n FROM n) / count(*)) AS idf FROM tk GROUP BY token HAVING count(*) < (SELECT n FROM n)),
t AS (SELECT side, id, token, idf FROM tk JOIN w USING (token)), m AS (SELECT side, id, sum(idf) AS mass FROM t GROUP BY ALL),
p AS (SELECT a.id AS a, b.id AS b, sum(a.idf) AS shared, count(*) AS n_content FROM t a JOIN t b ON a.token = b.token AND a.side = 0 AND b.side = 1 GROUP BY ALL)
SELECT a, b, n_content, round(2 * shared / (x.mass + y.mass), 6) AS score FROM p JOIN m x ON x.side = 0 AND x.id = a JOIN m y ON y.side = 1 AND y.id = b WHERE 2 * shared / (x.mass + y.mass) >= 0.3""",
)
def similar_pairs(spark, sf) -> DataFrame:
    """Every benchmark passage against every document, by words alone."""
    words = lambda name, id_: table(spark, sf, name).select(F.col(id_).alias("id"), F.regexp_replace("text", r"[^A-Za-z' ]", " ").alias("text"))
    p = S.similar_pairs(words("benchmark", "item_id"), words("documents", "doc_id"), min_score=0.3)
    return p.select("a", "b", F.col("n_content").cast("bigint").alias("n_content"), F.round("score", 6).alias("score"))


@query("fuzzy_matches")
def fuzzy_matches(spark, sf) -> DataFrame:
    b = table(spark, sf, "benchmark").select(F.col("item_id").alias("id"), "text")
    return S.greedy_matches(S.similar_pairs(b, min_score=0.2, prefix=True))


@query(
    "greedy_pairs",
    """WITH RECURSIVE o AS MATERIALIZED (SELECT s_suppkey AS a, c_custkey AS b, round(-abs(s_acctbal - c_acctbal), 2) AS score, row_number() OVER (ORDER BY round(-abs(s_acctbal - c_acctbal), 2) DESC, s_suppkey, c_custkey) AS k FROM supplier JOIN customer ON s_nationkey = c_nationkey),
r(k, ta, tb, a, b, score, ok) AS (SELECT 0::BIGINT, []::BIGINT[], []::BIGINT[], 0::BIGINT, 0::BIGINT, 0.0::DOUBLE, false
 UNION ALL SELECT o.k, CASE WHEN NOT list_contains(ta, o.a) AND NOT list_contains(tb, o.b) THEN list_append(ta, o.a) ELSE ta END, CASE WHEN NOT list_contains(ta, o.a) AND NOT list_contains(tb, o.b) THEN list_append(tb, o.b) ELSE tb END,
 o.a, o.b, o.score, NOT list_contains(ta, o.a) AND NOT list_contains(tb, o.b) FROM r JOIN o ON o.k = r.k + 1)
SELECT 's' || lpad(a::VARCHAR, 12, '0') AS a, 't' || lpad(b::VARCHAR, 12, '0') AS b, score FROM r WHERE ok""",
)
def greedy_pairs(spark, sf) -> DataFrame:
    """Suppliers and customers of one nation, paired by how near their balances are."""
    pad = lambda t, c: F.concat(F.lit(t), F.lpad(F.col(c).cast("string"), 12, "0"))
    s, c = table(spark, sf, "supplier"), table(spark, sf, "customer")
    return S.greedy_nearest(s.select(pad("s", "s_suppkey").alias("a"), F.col("s_nationkey").alias("part"), F.col("s_acctbal").alias("at")), c.select(pad("t", "c_custkey").alias("b"), F.col("c_nationkey").alias("part"), F.col("c_acctbal").alias("at")))


@query(
    "proximity_pairs",
    """WITH t AS (SELECT o_orderkey AS k, o_orderdate AS ts FROM orders UNION SELECT l_orderkey, l_shipdate FROM lineitem), p AS (SELECT o_orderkey AS a, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS b FROM orders),
d AS (SELECT a, b, min(abs(epoch_us(x.ts::TIMESTAMP) - epoch_us(y.ts::TIMESTAMP))) AS us FROM p JOIN t x ON x.k = a JOIN t y ON y.k = b GROUP BY ALL),
s AS (SELECT DISTINCT a, b FROM p JOIN lineitem x ON x.l_orderkey = a JOIN lineitem y ON y.l_orderkey = b AND x.l_suppkey = y.l_suppkey)
SELECT d.a, d.b, CASE WHEN s.a IS NULL THEN 'time' ELSE 'actor' END AS why, CASE WHEN us <= 30 * 86400000000 + 86399999999 THEN us // 86400000000 END AS min_days FROM d LEFT JOIN s USING (a, b) WHERE s.a IS NOT NULL OR us // 86400000000 <= 30""",
)
def proximity_pairs(spark, sf) -> DataFrame:
    """Every order with the customer's next one: near in time, or from a common supplier."""
    from pyspark.sql import Window

    o, l = table(spark, sf, "orders"), table(spark, sf, "lineitem")
    log = o.select(F.col("o_orderkey").alias("case_id"), F.col("o_orderdate").cast("timestamp").alias("ts"), F.lit(None).cast("bigint").alias("actor")).unionByName(l.select(F.col("l_orderkey").alias("case_id"), F.col("l_shipdate").cast("timestamp").alias("ts"), F.col("l_suppkey").cast("bigint").alias("actor")))
    following = F.lead("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    return S.proximity(log, o.select(F.col("o_orderkey").alias("a"), following.alias("b")).filter("b is not null"), 30)


@query(
    "jaccard_shape_veto",
    """WITH s AS (SELECT user_id, date_trunc('day', ts) AS d, list_distinct(list(event_type)) AS acts FROM events GROUP BY ALL)
SELECT a.user_id, a.d AS d, len(list_intersect(a.acts, b.acts)) / len(list_distinct(list_concat(a.acts, b.acts))) > 0.8 AS veto FROM s a JOIN s b ON a.user_id = b.user_id AND b.d = a.d + INTERVAL 1 DAY""",
)
def jaccard_shape_veto(spark, sf) -> DataFrame:
    s = table(spark, sf, "events").groupBy("user_id", F.date_trunc("day", "ts").cast("timestamp_ntz").alias("d")).agg(F.collect_set("event_type").alias("acts"))
    b = s.select("user_id", (F.col("d") - F.expr("interval 1 day")).alias("d"), F.col("acts").alias("next"))
    return s.join(b, ["user_id", "d"]).select("user_id", "d", (S.shape_overlap(F.col("acts"), F.col("next")) > 0.8).alias("veto"))


@query("topic_clusters")
def topic_clusters(spark, sf) -> DataFrame:
    from ..operators.topics import refine

    b = table(spark, sf, "benchmark").select(F.col("item_id").cast("string").alias("id"), "text")
    return refine(b, spark_total=b.count(), min_score=0.2)


_COSINES = "e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), c AS (SELECT a.vec_id AS a, b.vec_id AS b, round(list_cosine_similarity(a.v, b.v), 6) AS cosine FROM e a JOIN e b ON a.vec_id < b.vec_id)"


def _vectors(spark, sf) -> DataFrame:
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))


@query("embedding_shortlist", f"WITH {_COSINES} SELECT a, b, cosine FROM c WHERE cosine >= 0.3 ORDER BY cosine DESC, a, b LIMIT 200")
def embedding_shortlist(spark, sf) -> DataFrame:
    """All vectors with all others; the 200 likest pairs are what a judge is asked about."""
    return S.shortlist(S.cosine_pairs(_vectors(spark, sf), 0.3, top=200).withColumn("cosine", F.round("cosine", 6)), "cosine", 200)


@query("embedding_links", f"WITH {_COSINES}, l AS (SELECT a AS id FROM c WHERE cosine >= 0.55 UNION ALL SELECT b FROM c WHERE cosine >= 0.55), n AS (SELECT id, count(*) AS n FROM l GROUP BY id) SELECT vec_id AS id, coalesce(n, 0) AS links FROM e LEFT JOIN n ON id = vec_id")
def embedding_links(spark, sf) -> DataFrame:
    """Every vector and how many others it is at the bar of 0.55 or above with."""
    v = _vectors(spark, sf)
    ends = S.cosine_pairs(v, 0.55).select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("links"))
    return v.select("id").join(ends, "id", "left").select("id", F.coalesce("links", F.lit(0)).cast("bigint").alias("links"))


_RULES = [("thank", "closing"), ("error", "problem"), ("?", "question"), ("the", "statement")]
_RULES_SQL = "CASE " + " ".join(f"WHEN contains(lower(text), '{p}') THEN '{l}'" for p, l in _RULES) + " END"


@query("scripted_judge", f"SELECT conv_id, turn, {_RULES_SQL} AS verdict FROM conversations")
def scripted_judge(spark, sf) -> DataFrame:
    return table(spark, sf, "conversations").select("conv_id", "turn", E.scripted(F.col("text"), _RULES).alias("verdict"))


_VERBS = {"signup": "Join", "purchase": "Buy", "click": "Browse", "view": "Browse"}


@query("verb_map", "SELECT CASE event_type WHEN 'signup' THEN 'Join' WHEN 'purchase' THEN 'Buy' WHEN 'click' THEN 'Browse' WHEN 'view' THEN 'Browse' ELSE event_type END AS activity, count(*) AS n FROM events GROUP BY 1")
def verb_map(spark, sf) -> DataFrame:
    return table(spark, sf, "events").groupBy(E.relabel(F.col("event_type"), _VERBS).alias("activity")).agg(F.count(F.lit(1)).alias("n"))


@query("record_reading", f"SELECT coalesce({_RULES_SQL}, role) AS activity, count(*) AS n FROM conversations GROUP BY 1")
def record_reading(spark, sf) -> DataFrame:
    return table(spark, sf, "conversations").groupBy(E.relabel(F.col("role"), {}, E.scripted(F.col("text"), _RULES)).alias("activity")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "process_vote",
    f"""WITH r AS (SELECT conv_id AS case_id, turn, {_RULES_SQL} AS process FROM conversations), g AS (SELECT case_id, process, count(*) AS votes, min(turn) AS f FROM r WHERE process IS NOT NULL GROUP BY ALL)
SELECT case_id, process, votes FROM (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY votes DESC, f) AS k FROM g) WHERE k = 1""",
)
def process_vote(spark, sf) -> DataFrame:
    c = table(spark, sf, "conversations").select(F.col("conv_id").alias("case_id"), E.scripted(F.col("text"), _RULES).alias("process"), F.col("turn").alias("seq"))
    return E.process_vote(c)


@query(
    "lonely_steps",
    """WITH p AS (SELECT DISTINCT l_returnflag || l_quantity::INT AS process, l_partkey AS step, l_orderkey AS case_id FROM lineitem), n AS (SELECT process, case_id, count(*) AS s FROM p GROUP BY ALL)
SELECT process, step::VARCHAR AS step, count(*) AS runs FROM p JOIN n USING (process, case_id) GROUP BY process, step HAVING count(*) >= 3 AND max(s) = 1""",
)
def lonely_steps(spark, sf) -> DataFrame:
    l = table(spark, sf, "lineitem").select(F.concat(F.col("l_returnflag"), F.col("l_quantity").cast("int").cast("string")).alias("process"), F.col("l_partkey").cast("string").alias("step"), F.col("l_orderkey").alias("case_id"))
    return E.lonely_steps(l)


@query("even_stride_sample", "WITH r AS (SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS i, count(*) OVER () AS t FROM events), k AS (SELECT DISTINCT floor(k * (SELECT count(*) FROM events) / 150.0)::BIGINT AS i FROM range(150) AS x(k)) SELECT event_id FROM r JOIN k USING (i)")
def even_stride_sample(spark, sf) -> DataFrame:
    return E.even_stride(table(spark, sf, "events").select("event_id"), "event_id", 150)


@query("cap_per_case", "SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events) WHERE k <= 3")
def cap_per_case(spark, sf) -> DataFrame:
    return E.cap_per_case(table(spark, sf, "events"), "user_id", ["ts", "event_id"], 3).select("user_id", "event_id")


_SCORES_SQL = "sc0 AS (SELECT user_id AS record, event_type AS option, count(*) AS c FROM events GROUP BY user_id, event_type), sc AS (SELECT record, option, c / sum(c) OVER (PARTITION BY record) AS score FROM sc0)"


def _scores(spark, sf) -> DataFrame:
    from pyspark.sql import Window

    g = table(spark, sf, "events").groupBy(F.col("user_id").alias("record"), F.col("event_type").alias("option")).agg(F.count(F.lit(1)).alias("c"))
    return g.withColumn("score", F.col("c") / F.sum("c").over(Window.partitionBy("record"))).drop("c")


@query(
    "separation_margin",
    f"""WITH {_SCORES_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY record ORDER BY score DESC, option) AS k FROM sc), g AS (SELECT record, max(option) FILTER (WHERE k = 1) AS best, max(score) FILTER (WHERE k = 1) AS score, max(score) FILTER (WHERE k = 2) AS second FROM r GROUP BY record)
SELECT *, coalesce(score < 1.5 * second, false) AS ambiguous FROM g""",
)
def separation_margin(spark, sf) -> DataFrame:
    return E.separation(_scores(spark, sf))


@query("label_screen", "SELECT d.doc_id, CASE WHEN quality < 0.35 THEN 'quality' WHEN 1 - toxic < 0.35 THEN 'harm' END AS failed FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def label_screen(spark, sf) -> DataFrame:
    d = table(spark, sf, "documents").select("doc_id").join(table(spark, sf, "labels"), "doc_id", "left")
    return d.select("doc_id", E.screen({"quality": F.col("quality"), "harm": 1 - F.col("toxic")}).alias("failed"))


@query("decision_ledger", "SELECT kind, outcome, count(*) AS n FROM (SELECT 'quality' AS kind, CASE WHEN quality = 1 THEN 'kept' ELSE 'declined' END AS outcome FROM labels UNION ALL SELECT 'toxic', CASE WHEN toxic = 0 THEN 'kept' ELSE 'declined' END FROM labels) GROUP BY ALL")
def decision_ledger(spark, sf) -> DataFrame:
    l = table(spark, sf, "labels")
    d = l.select(F.lit("quality").alias("kind"), F.when(F.col("quality") == 1, "kept").otherwise("declined").alias("outcome")).unionByName(l.select(F.lit("toxic").alias("kind"), F.when(F.col("toxic") == 0, "kept").otherwise("declined").alias("outcome")))
    return U.ledger(d)


@query("repeatability", "SELECT event_type, count(value) AS n, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS deviation, count(DISTINCT value >= 0.5) - 1 AS flips FROM events GROUP BY event_type")
def repeatability(spark, sf) -> DataFrame:
    return E.repeatability(table(spark, sf, "events"), "event_type", "value").withColumn("mean", F.round("mean", 6)).withColumn("deviation", F.round("deviation", 6))


@query("claim_ids", "SELECT o_orderkey, 'c-' || substr(sha1(lower(trim(o_orderstatus)) || chr(31) || lower(trim(o_orderpriority)) || chr(31) || o_orderkey), 1, 12) AS claim FROM orders")
def claim_ids(spark, sf) -> DataFrame:
    return table(spark, sf, "orders").select("o_orderkey", X.claim_id(F.col("o_orderstatus"), F.col("o_orderpriority"), F.col("o_orderkey")).alias("claim"))


@query(
    "review_reconcile",
    """WITH c AS (SELECT DISTINCT 'k' || (o_orderkey % 500) AS claim FROM orders WHERE o_orderstatus = 'P'), a AS (SELECT 'k' || (o_custkey % 700) AS claim, CASE o_orderstatus WHEN 'F' THEN 'confirmed' WHEN 'O' THEN 'disputed' ELSE 'hm' END AS answer, o_orderkey AS position FROM orders),
l AS (SELECT claim, arg_max(answer, position) AS answer FROM a WHERE answer <> 'hm' GROUP BY claim)
SELECT coalesce(c.claim, l.claim) AS claim, CASE WHEN c.claim IS NULL THEN 'unmatched' ELSE coalesce(l.answer, 'open') END AS status FROM c FULL JOIN l ON c.claim = l.claim""",
)
def review_reconcile(spark, sf) -> DataFrame:
    o = table(spark, sf, "orders")
    claims = o.filter("o_orderstatus = 'P'").select(F.concat(F.lit("k"), (F.col("o_orderkey") % 500).cast("string")).alias("claim"))
    answers = o.select(F.concat(F.lit("k"), (F.col("o_custkey") % 700).cast("string")).alias("claim"), F.when(F.col("o_orderstatus") == "F", "confirmed").when(F.col("o_orderstatus") == "O", "disputed").otherwise("hm").alias("answer"), F.col("o_orderkey").alias("position"))
    return E.reconcile(claims, answers)


@query("subject_norm", "SELECT o_orderkey, lower('Order ' || o_orderpriority) AS subject FROM orders")
def subject_norm(spark, sf) -> DataFrame:
    o = table(spark, sf, "orders")
    raw = F.concat(F.when(F.col("o_orderkey") % 3 == 0, "Re: FW:  ").when(F.col("o_orderkey") % 3 == 1, "fwd: re: ").otherwise(""), F.lit("Order   "), F.col("o_orderpriority"))
    return o.select("o_orderkey", X.subject_key(raw).alias("subject"))


@query(
    "reference_extract",
    """SELECT o_orderkey, 'pr' AS kind, o_orderkey AS number, 4 AS tier FROM orders WHERE o_orderkey % 2 = 0 UNION ALL SELECT o_orderkey, 'issue', o_custkey, 3 FROM orders
UNION ALL SELECT o_orderkey, 'issue', o_orderkey, 2 FROM orders WHERE o_orderkey % 2 = 0 AND o_orderkey <> o_custkey""",
)
def reference_extract(spark, sf) -> DataFrame:
    o = table(spark, sf, "orders")
    body = F.concat(F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("Merge pull request #"), F.col("o_orderkey").cast("string"), F.lit(" from x/y\n"))).otherwise(""), F.lit("Fixes #"), F.col("o_custkey").cast("string"), F.lit(", see #"), F.col("o_custkey").cast("string"))
    return o.select("o_orderkey", F.explode(X.references(body)).alias("r")).select("o_orderkey", "r.kind", "r.number", "r.tier")


@query("date_parse", "SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 4 THEN NULL ELSE strftime(o_orderdate, '%Y-%m-%d') END AS d FROM orders")
def date_parse(spark, sf) -> DataFrame:
    o, d = table(spark, sf, "orders"), F.col("o_orderdate").cast("timestamp")
    form = F.col("o_orderkey") % 5
    raw = F.when(form == 0, F.date_format(d, "yyyy-MM-dd")).when(form == 1, F.date_format(d, "dd/MM/yyyy")).when(form == 2, F.date_format(d, "d-MMM-yyyy")).when(form == 3, F.date_format(d, "d MMM yyyy")).otherwise("soon")
    return o.select("o_orderkey", D.parse_date(raw).cast("string").alias("d"))


@query(
    "model_stats",
    f"""WITH {EV} SELECT kind, activity, count(*) AS events, count(DISTINCT case_id) AS cases FROM ev GROUP BY GROUPING SETS ((kind), (activity), ())""",
)
def model_stats(spark, sf) -> DataFrame:
    return U.stats(event_log(spark, sf))


@query("run_facets", f"WITH {LONG_RUNS} SELECT 'kind' AS facet, kind AS value, count(*) AS n FROM rn GROUP BY kind UNION ALL SELECT 'shape', shape, count(*) FROM rn GROUP BY shape HAVING count(*) > 1")
def run_facets(spark, sf) -> DataFrame:
    r = event_runs(spark, sf, LONG_GAP).select("kind", F.array_join("shape", ">").alias("shape"))
    return U.facets(r, ["kind", "shape"]).filter("facet = 'kind' or n > 1")


@query("run_search", f"WITH {LONG_RUNS} SELECT key, shape FROM rn WHERE contains(lower(key || ' ' || kind || ' ' || shape), 'purchase>error')")
def run_search(spark, sf) -> DataFrame:
    r = event_runs(spark, sf, LONG_GAP).select("key", "kind", F.array_join("shape", ">").alias("shape"))
    return U.search(r, "Purchase>error", ["key", "kind", "shape"]).select("key", "shape")


@query("leftover_groups", "SELECT CASE WHEN c_acctbal < 0 THEN 'in debt' ELSE 'idle' END AS reason, count(*) AS n FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000) GROUP BY 1")
def leftover_groups(spark, sf) -> DataFrame:
    big = table(spark, sf, "orders").filter("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey"))
    return U.leftovers(table(spark, sf, "customer"), big, "c_custkey", F.when(F.col("c_acctbal") < 0, "in debt").otherwise("idle"))
