"""Queries over readings, inferred joins and what a reader of the model looks at."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import readings as R
from ..operators import views as V
from .logs import LONG_GAP, LONG_RUNS, event_runs, table
from .register import query

s_ = lambda c: F.col(c).cast("string")


@query(
    "typed_answers",
    """WITH a AS (SELECT event_id, CASE WHEN event_id % 4 = 0 THEN (event_id % 100) / 100.0 END AS noul, CASE WHEN event_id % 4 = 1 THEN event_type END AS choice, CASE WHEN event_id % 4 = 2 THEN value END AS score FROM events)
SELECT event_id, CASE WHEN noul IS NOT NULL THEN 'noul' WHEN choice IS NOT NULL THEN 'choice' ELSE 'score' END AS kind, round(CASE WHEN noul IS NOT NULL THEN greatest(noul, 1 - noul) WHEN choice = 'click' THEN 0.7 WHEN choice IS NOT NULL THEN 0.7 END, 6) AS sure
FROM a WHERE noul IS NOT NULL OR choice IS NOT NULL OR score IS NOT NULL""",
)
def typed_answers(spark, sf) -> DataFrame:
    """Yes-or-no answers as text, choices with shares of the options (the chosen one among them or not), scores, no answers."""
    k = F.col("event_id") % 4
    shares = F.create_map(F.lit("click"), F.lit(0.7), F.lit("other"), F.lit(0.3))
    a = table(spark, sf, "events").select("event_id", F.when(k == 0, ((F.col("event_id") % 100) / 100).cast("string")).when(k == 3, "maybe").alias("noul"), F.when(k == 1, F.col("event_type")).alias("choice"), F.when(k == 2, F.col("value")).alias("score"), F.when(k == 1, shares).alias("probabilities"), F.lit(None).cast("double").alias("confidence"))
    return R.typed(a).select("event_id", "kind", F.round("sure", 6).alias("sure"))


@query(
    "judge_gate",
    """WITH p AS (SELECT l_orderkey AS a, l_partkey AS b, CASE WHEN l_linenumber <> 3 THEN l_discount * 10 END AS same, CASE WHEN l_linenumber <> 2 THEN l_tax * 10 END AS span, l_linenumber FROM lineitem)
SELECT least('r' || a, 'r' || b) || '↔' || greatest('r' || a, 'r' || b) AS pair, CASE WHEN same IS NULL THEN 'judged' WHEN same < 0.4 THEN 'declined' WHEN span < 0.5 THEN 'same subject apart' ELSE 'judged' END AS outcome, count(*) AS n FROM p GROUP BY ALL""",
)
def judge_gate(spark, sf) -> DataFrame:
    l = table(spark, sf, "lineitem")
    p = l.select(F.concat(F.lit("r"), s_("l_orderkey")).alias("a"), F.concat(F.lit("r"), s_("l_partkey")).alias("b"), F.when(F.col("l_linenumber") != 3, F.col("l_discount") * 10).alias("same"), F.when(F.col("l_linenumber") != 2, F.col("l_tax") * 10).alias("one_span"))
    return R.gate(p).groupBy("pair", "outcome").agg(F.count(F.lit(1)).alias("n"))


def _vocabulary(spark, sf) -> DataFrame:
    """The names of large parts are steps of their brand, those of the smallest are loose steps."""
    return table(spark, sf, "part").filter("p_size > 25 or p_size = 1").select(F.when(F.col("p_size") > 25, F.col("p_brand")).alias("process"), F.col("p_name").alias("step"))


_VOCABULARY = "v AS (SELECT CASE WHEN p_size > 25 THEN p_brand END AS process, p_name AS step FROM part WHERE p_size > 25 OR p_size = 1)"


@query("option_space", f"WITH {_VOCABULARY} SELECT DISTINCT coalesce(process || ' > ', '') || step AS option, process, step FROM v")
def option_space(spark, sf) -> DataFrame:
    o = R.option_space(_vocabulary(spark, sf))
    process, step = R.read_option(F.col("option"))
    return o.select("option", process.alias("process"), step.alias("step"))


@query("steps_allowed", f"WITH {_VOCABULARY} SELECT p_partkey, p_brand AS process, p_name AS step FROM part WHERE p_name IN (SELECT step FROM v WHERE process IS NULL) OR (p_brand, p_name) IN (SELECT (process, step) FROM v WHERE process IS NOT NULL)")
def steps_allowed(spark, sf) -> DataFrame:
    r = table(spark, sf, "part").select("p_partkey", F.col("p_brand").alias("process"), F.col("p_name").alias("step"))
    return R.steps_allowed(r, _vocabulary(spark, sf))


@query("short_labels", r"SELECT item_id, trim(text) AS step FROM benchmark WHERE len(string_split_regex(trim(text, ' '), '\s+')) <= 40")
def short_labels(spark, sf) -> DataFrame:
    b = table(spark, sf, "benchmark").select("item_id", F.trim("text").alias("step"))
    return R.short_labels(b, most=40)


@query(
    "beam_paths",
    """WITH f0 AS (SELECT user_id AS record, event_type AS process, count(*) AS c FROM events GROUP BY ALL), f AS (SELECT record, process, c / sum(c) OVER (PARTITION BY record) AS p FROM f0),
s0 AS (SELECT user_id AS record, event_type AS process, (event_id % 4)::VARCHAR AS step, count(*) AS c FROM events GROUP BY ALL), s AS (SELECT record, process, step, c / sum(c) OVER (PARTITION BY record, process) AS p FROM s0),
k AS (SELECT *, row_number() OVER (PARTITION BY record ORDER BY p DESC, process) AS k FROM f), j AS (SELECT s.record, s.process, s.step, sqrt(s.p * k.p) AS c, k.p AS q FROM s JOIN k ON k.record = s.record AND k.process = s.process WHERE k <= 3)
SELECT record, process, step, round(c, 6) AS confidence FROM (SELECT *, row_number() OVER (PARTITION BY record ORDER BY c DESC, q DESC, process, step) AS r FROM j) WHERE r = 1""",
)
def beam_paths(spark, sf) -> DataFrame:
    from pyspark.sql import Window

    e = table(spark, sf, "events").select(F.col("user_id").alias("record"), F.col("event_type").alias("process"), (F.col("event_id") % 4).cast("string").alias("step"))
    share = lambda g, by: g.withColumn("p", F.col("c") / F.sum("c").over(Window.partitionBy(*by))).drop("c")
    first = share(e.groupBy("record", "process").agg(F.count(F.lit(1)).alias("c")), ["record"])
    second = share(e.groupBy("record", "process", "step").agg(F.count(F.lit(1)).alias("c")), ["record", "process"])
    return R.beam(first, second).withColumn("confidence", F.round("confidence", 6))


@query(
    "batch_packs",
    """WITH RECURSIVE t AS (SELECT c_mktsegment AS lane, c_custkey AS thread, 1 + c_custkey % 9 AS size, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) AS i FROM customer),
r(lane, thread, size, i, batch, held) AS (SELECT lane, thread, size, i, 0::BIGINT, size FROM t WHERE i = 1
UNION ALL SELECT t.lane, t.thread, t.size, t.i, CASE WHEN held + t.size > 25 THEN batch + 1 ELSE batch END, CASE WHEN held + t.size > 25 THEN t.size ELSE held + t.size END FROM r JOIN t ON t.lane = r.lane AND t.i = r.i + 1)
SELECT lane, thread, size, batch FROM r""",
)
def batch_packs(spark, sf) -> DataFrame:
    c = table(spark, sf, "customer")
    return R.pack(c.select(F.col("c_mktsegment").alias("lane"), F.col("c_custkey").alias("thread"), (1 + F.col("c_custkey") % 9).alias("size")), 25)


@query("kind_triage", "SELECT p_brand AS kind, max(p_size) > 49 OR (count(*) % 2 = 0 AND avg(p_size) / 30 >= 0.7 AND coalesce(min(p_size) < 3, true)) AS rejected FROM part GROUP BY p_brand")
def kind_triage(spark, sf) -> DataFrame:
    k = table(spark, sf, "part").groupBy(F.col("p_brand").alias("kind")).agg((F.max("p_size") > 49).alias("rejected"), F.when(F.count(F.lit(1)) % 2 == 0, "machine_noise").otherwise("process").alias("verdict"), (F.avg("p_size") / 30).alias("confidence"), F.when(F.min("p_size") < 3, 0.2).otherwise(0.9).alias("produces"))
    return R.triage(k).select("kind", "rejected")


@query("merged_counters", "SELECT c_nationkey, string_agg(c_mktsegment || '=' || n, ',' ORDER BY c_mktsegment) AS counts FROM (SELECT c_nationkey, c_mktsegment, sum(1 + c_custkey % 3)::BIGINT AS n FROM customer GROUP BY ALL) GROUP BY c_nationkey")
def merged_counters(spark, sf) -> DataFrame:
    c = table(spark, sf, "customer").select("c_nationkey", F.create_map("c_mktsegment", 1 + F.col("c_custkey") % 3).alias("m"))
    m = R.merged_counts(c, ["c_nationkey"], "m")
    return m.select("c_nationkey", F.array_join(F.transform(F.map_entries("m"), lambda x: F.concat(x["key"], F.lit("="), x["value"].cast("string"))), ",").alias("counts"))


_JOINS = "j AS (SELECT 'i' || l_partkey AS a, 'i' || l_suppkey AS b, 1 + l_linenumber % 3 AS tier, l_returnflag AS rationale, l_orderkey * 10 + l_linenumber AS seq FROM lineitem), e AS (SELECT a AS island, tier, rationale, seq FROM j UNION ALL SELECT b, tier, rationale, seq FROM j), w AS (SELECT island, tier, rationale FROM (SELECT *, row_number() OVER (PARTITION BY island ORDER BY tier, seq, rationale) AS k FROM e) WHERE k = 1)"


def _joins(spark, sf) -> DataFrame:
    l = table(spark, sf, "lineitem")
    return l.select(F.concat(F.lit("i"), s_("l_partkey")).alias("a"), F.concat(F.lit("i"), s_("l_suppkey")).alias("b"), (1 + F.col("l_linenumber") % 3).cast("int").alias("tier"), F.col("l_returnflag").alias("rationale"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"))


@query("inferred_bridges", f"WITH {_JOINS} SELECT island, min(tier) AS tier FROM w GROUP BY island")
def inferred_bridges(spark, sf) -> DataFrame:
    return V.bridges(_joins(spark, sf)).select("island", "tier")


@query(
    "link_scores",
    f"""WITH {_JOINS}, r AS (SELECT l_orderkey, l_linenumber, l_linenumber = 1 AS anchor, CASE WHEN l_linenumber % 2 = 0 THEN 4 END AS own, CASE WHEN l_linenumber % 3 = 0 THEN 3 END AS attach, 2 AS ct, 'i' || l_partkey AS mi, 'i' || (l_orderkey % 50) AS ai FROM lineitem)
SELECT l_orderkey, l_linenumber, least(CASE WHEN anchor THEN coalesce(own, attach, ct) ELSE coalesce(attach, own, ct) END, CASE WHEN NOT anchor AND mi <> ai THEN coalesce(m.tier, a.tier) END) AS tier, count(*) AS n FROM r LEFT JOIN w m ON m.island = mi LEFT JOIN w a ON a.island = ai GROUP BY ALL""",
)
def link_scores(spark, sf) -> DataFrame:
    l, k = table(spark, sf, "lineitem"), F.col("l_linenumber")
    r = l.select("l_orderkey", "l_linenumber", k.cast("string").alias("entity_id"), F.lit("1").alias("anchor_id"), F.when(k % 2 == 0, 4).alias("own"), F.when(k % 3 == 0, 3).alias("attach"), F.lit(2).alias("case_tier"), F.concat(F.lit("i"), s_("l_partkey")).alias("island"), F.concat(F.lit("i"), (F.col("l_orderkey") % 50).cast("string")).alias("anchor_island"))
    return V.link_scores(r, V.bridges(_joins(spark, sf))).groupBy("l_orderkey", "l_linenumber", "tier").agg(F.count(F.lit(1)).alias("n"))


def _runs(spark, sf) -> DataFrame:
    r = event_runs(spark, sf, LONG_GAP)
    return r.select(F.col("key").alias("case_id"), "kind", F.when(F.size("shape") > 3, "usual").otherwise("short").alias("label"), "shape")


_RUNS = LONG_RUNS + ", r AS (SELECT key AS case_id, kind, CASE WHEN length > 3 THEN 'usual' ELSE 'short' END AS label, shape FROM rn)"


@query(
    "run_rows",
    f"""WITH {_RUNS} SELECT case_id, CASE WHEN kind = 'human' THEN 'People' ELSE 'Ungrouped' END AS kind, label, concat_ws(',', CASE WHEN contains(shape, 'error') THEN 'error_seen' END, CASE WHEN NOT contains(shape, 'view') THEN 'no_view' END) AS gaps,
contains(shape, 'error')::BIGINT + (NOT contains(shape, 'view'))::BIGINT AS n_gaps, false AS attention FROM r""",
)
def run_rows(spark, sf) -> DataFrame:
    r = _runs(spark, sf)
    gaps = r.filter(F.array_contains("shape", "error")).select("case_id", F.lit("error_seen").alias("gap")).unionByName(r.filter(~F.array_contains("shape", "view")).select("case_id", F.lit("no_view").alias("gap")))
    names = spark.createDataFrame([("human", "People", False)], "kind string, name string, rejected boolean")
    return V.run_rows(r.drop("shape"), gaps, names)


@query("runs_on_route", f"WITH {_RUNS} SELECT case_id, kind FROM r WHERE label = 'usual'")
def runs_on_route(spark, sf) -> DataFrame:
    return V.on_route(_runs(spark, sf), "usual").select("case_id", "kind")


@query("runs_behind", f"WITH {_RUNS} SELECT case_id, label FROM r WHERE contains(shape, 'purchase')")
def runs_behind(spark, sf) -> DataFrame:
    r = _runs(spark, sf)
    figures = r.select(F.explode("shape").alias("about"), "case_id").groupBy("about").agg(F.collect_set("case_id").alias("runs"))
    return V.behind(r, figures, "purchase").select("case_id", "label")


@query("tile_texts", f"WITH {_RUNS} SELECT kind AS tile, round_even(sum((label = 'usual')::INT) * 100 / count(*), 0)::BIGINT || ' % (' || sum((label = 'usual')::INT)::BIGINT || ' of ' || count(*) || ')' AS text FROM r GROUP BY kind UNION ALL SELECT 'nothing', '–' FROM (SELECT 1)")
def tile_texts(spark, sf) -> DataFrame:
    g = _runs(spark, sf).groupBy(F.col("kind").alias("tile")).agg(F.count_if(F.col("label") == "usual").alias("n"), F.count(F.lit(1)).alias("of"))
    return V.tiles(g.unionByName(spark.createDataFrame([("nothing", 0, 0)], "tile string, n long, of long")))


@query("member_table", "SELECT user_id AS id, 'u' || user_id AS name, user_id % 10 = 0 AS is_bot, count(*) AS count FROM events GROUP BY user_id")
def member_table(spark, sf) -> DataFrame:
    p = table(spark, sf, "events").groupBy(F.col("user_id").alias("id")).agg(F.count(F.lit(1)).alias("count"))
    return V.members(p.select("id", F.concat(F.lit("u"), s_("id")).alias("name"), (F.col("id") % 10 == 0).alias("is_bot"), "count"))


@query("decision_popovers", "SELECT d.doc_id, arg_max(o_orderstatus, o_orderkey) AS answer, arg_max(o_totalprice, o_orderkey) AS confidence, arg_max(o_orderpriority, o_orderkey) AS outcome FROM documents d LEFT JOIN orders ON o_custkey = d.doc_id GROUP BY d.doc_id")
def decision_popovers(spark, sf) -> DataFrame:
    rows = table(spark, sf, "documents").select(F.lit("document").alias("kind"), F.col("doc_id").alias("about"), "doc_id")
    d = table(spark, sf, "orders").select(F.lit("document").alias("kind"), F.col("o_custkey").alias("about"), F.col("o_orderstatus").alias("answer"), F.col("o_totalprice").alias("confidence"), F.col("o_orderpriority").alias("outcome"), F.col("o_orderkey").alias("seq"))
    return V.decision_for(rows, d).select("doc_id", "answer", "confidence", "outcome")


@query(
    "dominant_nouns",
    """WITH t AS (SELECT c_nationkey, CASE WHEN c_custkey % 100 < 80 THEN 'pr' WHEN c_nationkey % 2 = 0 THEN 'issue' ELSE 'pr' END AS t FROM customer), n AS (SELECT c_nationkey, t, count(*) AS n FROM t GROUP BY ALL), m AS (SELECT c_nationkey, max(n) / sum(n) AS share, arg_max(t, n) AS t FROM n GROUP BY c_nationkey)
SELECT c_nationkey, CASE WHEN share < 0.8 THEN 'run' WHEN t = 'pr' THEN 'pull request' ELSE 'issue' END AS item, CASE WHEN share < 0.8 THEN 'runs' WHEN t = 'pr' THEN 'pull requests' ELSE 'issues' END AS items FROM m""",
)
def dominant_nouns(spark, sf) -> DataFrame:
    c = table(spark, sf, "customer").select("c_nationkey", F.when(F.col("c_custkey") % 100 < 80, "pr").when(F.col("c_nationkey") % 2 == 0, "issue").otherwise("pr").alias("type"))
    return V.dominant_noun(c, ["c_nationkey"])


@query("lines_at", "SELECT doc_id, trim(list_last(string_split(substr(coalesce(text, ''), 1, 200), chr(10))) || string_split(substr(coalesce(text, ''), 201), chr(10))[1]) AS line FROM documents")
def lines_at(spark, sf) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", V.line_at(F.coalesce("text", F.lit("")), F.lit(200)).alias("line"))


@query("join_words", "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'identifiers ''' || p_brand || ''' and ' ELSE '' END || 'words ' || list_aggregate(list_transform(string_split(p_name, ' ')[1:1], lambda x: '''' || x || ''''), 'string_agg', ', ') AS why FROM part")
def join_words(spark, sf) -> DataFrame:
    strong = F.when(F.col("p_partkey") % 2 == 0, F.array("p_brand")).otherwise(F.array().cast("array<string>"))
    return table(spark, sf, "part").select("p_partkey", V.join_rationale(strong, F.slice(F.split("p_name", " "), 1, 1)).alias("why"))


@query(
    "commit_subkinds",
    """WITH c AS (SELECT o_custkey AS case_id, CASE WHEN o_custkey % 7 = 0 THEN 'notes' WHEN o_custkey % 7 = 1 THEN 'release' END AS hint, CASE o_orderstatus WHEN 'F' THEN 'dependabot[bot]' WHEN 'O' THEN 'Somebody' ELSE 'GitHub-Actions' END AS author, o_custkey % 3 = 0 AS d FROM orders),
g AS (SELECT case_id, max(hint) AS hint, sum((author = 'dependabot[bot]')::INT) AS dep, sum((author = 'GitHub-Actions')::INT) AS ci, count(*) AS n, bool_and(d) AS d FROM c GROUP BY case_id)
SELECT case_id, CASE WHEN hint = 'notes' THEN 'release_notes' WHEN hint = 'release' THEN 'release_and_backport' WHEN dep * 2 > n THEN 'dependency_bumps' WHEN ci * 2 > n THEN 'ci_maintenance' WHEN d THEN 'documentation' ELSE 'code_contribution' END AS subkind FROM g""",
)
def commit_subkinds(spark, sf) -> DataFrame:
    k, st = F.col("o_custkey"), F.col("o_orderstatus")
    files = F.when(k % 3 == 0, F.array(F.lit("docs/a.txt"), F.lit("README.md"))).otherwise(F.array(F.lit("src/x.py"), F.lit("docs/a.txt")))
    c = table(spark, sf, "orders").select(k.alias("case_id"), F.when(k % 7 == 0, "notes").when(k % 7 == 1, "release").alias("hint"), F.when(st == "F", "dependabot[bot]").when(st == "O", "Somebody").otherwise("GitHub-Actions").alias("author"), files.alias("files"))
    return V.commit_subkind(c)


@query(
    "object_families",
    """SELECT page_id, CASE f WHEN 0 THEN 'code' WHEN 1 THEN 'code' WHEN 2 THEN 'docs' WHEN 3 THEN 'docs' WHEN 4 THEN 'deps/config' WHEN 5 THEN 'deps/config' ELSE 'other' END AS family, least(60, 45 + f) AS n, length(s) AS n_chars FROM (SELECT page_id, page_id % 7 AS f, substr(html, 1, 200) AS s FROM pages)
""".replace("least(60, 45 + f)", "least(50, 45 + f)"),
)
def object_families(spark, sf) -> DataFrame:
    k = F.col("page_id") % 7
    names = F.array(*[F.lit(p) for p in ("src/a.md", "pkg/tests/b.rst", "docs/c.toml", "d/e.md", "requirements-dev.in", "setup.cfg", "pic.png")])
    files, snippet = V.capped(F.array_repeat(F.lit("x"), (45 + k).cast("int")), F.col("html"))
    return table(spark, sf, "pages").select("page_id", V.object_family(F.element_at(names, (k + 1).cast("int"))).alias("family"), F.size(files).cast("bigint").alias("n"), F.length(snippet).cast("bigint").alias("n_chars"))


@query("profile_choice", "SELECT CASE WHEN (SELECT max((event_type = 'signup')::INT) FROM (SELECT event_type FROM events ORDER BY event_id LIMIT 100)) = 1 OR (SELECT max((role = 'none')::INT) FROM conversations) = 1 THEN 'git' ELSE 'generic' END AS profile")
def profile_choice(spark, sf) -> DataFrame:
    e = table(spark, sf, "events").select(F.when(F.col("event_type") == "signup", "git:x").otherwise("log").alias("source"), F.col("event_id").alias("seq"))
    return V.profile_of(e, table(spark, sf, "conversations").select("role", F.col("conv_id").alias("seq")).withColumnRenamed("role", "source"))


@query("kind_sentences", "SELECT p_brand, count(*) || ' runs, ' || CASE WHEN max(p_size) > 49 THEN 'automated' ELSE 'human-driven' END || ', anchor: ' || p_brand || ', mostly: —, touches: ' || string_agg(DISTINCT p_type, ', ' ORDER BY p_type) || '. A cluster of the data that nobody has named.' AS why FROM part GROUP BY p_brand")
def kind_sentences(spark, sf) -> DataFrame:
    g = table(spark, sf, "part").groupBy("p_brand").agg(F.count(F.lit(1)).alias("n"), (F.max("p_size") > 49).alias("auto"), F.collect_set("p_type").alias("types"))
    return g.select("p_brand", V.kind_rationale(F.col("n"), F.col("auto"), F.col("p_brand"), F.array().cast("array<string>"), F.col("types")).alias("why"))
