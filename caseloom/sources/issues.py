"""Issue-tracker payloads: issues and pull requests with their timelines, exploded to events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..model import DIRECT, JOINED, Shaped, shaped

_USER = "struct<login:string>"
_ENTRY = f"struct<event:string,actor:{_USER},user:{_USER},created_at:string,submitted_at:string,body:string,state:string,source:struct<issue:struct<number:bigint,pull_request:struct<url:string>>>>"
_ITEM = f"struct<number:bigint,title:string,body:string,user:{_USER},state:string,created_at:string,closed_at:string,merged_at:string,updated_at:string,merge_commit_sha:string,html_url:string,draft:boolean,labels:array<struct<name:string>>,merged_by:{_USER},closed_by:{_USER},timeline:array<{_ENTRY}>>"
PAYLOAD = f"slug string, issues array<{_ITEM}>, pulls array<{_ITEM}>"
ACTIONS = {a: a for a in "commented labeled unlabeled assigned unassigned review_requested review_request_removed reviewed committed ready_for_review renamed closed reopened merged referenced connected disconnected".split()} | {"head_ref_force_pushed": "force_pushed", "convert_to_draft": "converted_to_draft", "cross-referenced": "cross_referenced"}


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PAYLOAD).json(path, multiLine=True)


def shape(payload: DataFrame) -> Shaped:
    one = lambda col, pr: payload.select("slug", F.explode(col).alias("i")).select("slug", F.lit(pr).alias("is_pr"), "i.*")
    i = one("issues", False).unionByName(one("pulls", True)).filter("number is not null")
    n = F.col("number").cast("string")
    kind = F.when(F.col("is_pr"), "pr").otherwise("issue")
    i = i.withColumn("eid", F.when(F.col("is_pr"), F.concat(F.lit("pr:"), n)).otherwise(F.concat_ws(":", F.lit("issue"), "slug", n))).withColumn("type", kind).withColumn("source", F.concat(F.lit("github:"), "slug")).withColumn("locator", F.coalesce("html_url", F.concat_ws("/", "type", n)))
    entities = i.select(F.col("eid").alias("entity_id"), "source", "type", F.create_map(F.lit("number"), n, F.lit("title"), F.col("title"), F.lit("state"), F.col("state"), F.lit("labels"), F.array_join(F.transform("labels", lambda x: x["name"]), ",")).alias("attrs"), F.coalesce("title", F.lit("")).alias("text"), F.lit(DIRECT).alias("tier"), "locator", F.left("title", F.lit(200)).alias("snippet"), (F.col("number") * 1000).alias("seq"))

    def event(df, action, raw, login, at):
        who = F.lower(login)
        return df.select(F.concat_ws(":", F.lit("evt:gh"), "eid", action, at.cast("string")).alias("event_id"), F.col("eid").alias("entity_id"), action.alias("action"), "source", raw.alias("ts_raw"), raw.try_cast("timestamp").alias("ts"), raw.isNotNull().alias("has_time"), F.when(who.isNotNull(), F.concat(F.lit("person:gh:"), who)).alias("actor"), F.lit(DIRECT).alias("tier"), "locator", (F.col("number") * 1000 + at).alias("seq"))

    table = F.create_map(*[F.lit(x) for kv in ACTIONS.items() for x in kv])
    t = i.select("*", F.posexplode("timeline").alias("at", "e")).withColumn("act", table[F.col("e.event")]).filter("act is not null")
    events = event(i, F.lit("opened"), F.col("created_at"), F.col("user.login"), F.lit(0))
    events = events.unionByName(event(t, F.col("act"), F.coalesce("e.created_at", "e.submitted_at"), F.coalesce("e.actor.login", "e.user.login"), F.col("at") + 1))
    # the end of an item that its timeline does not show
    for action, raw, who in (("merged", "merged_at", "merged_by.login"), ("closed", "closed_at", "closed_by.login")):
        shown = t.filter(F.col("act") == action).select("eid").distinct()
        events = events.unionByName(event(i.filter(F.col(raw).isNotNull()).join(shown, "eid", "left_anti"), F.lit(action), F.col(raw), F.col(who), F.lit(998 if action == "merged" else 999)))
    people = events.filter("actor is not null").groupBy("actor").agg(F.min("seq").alias("seq"), F.min("source").alias("source"))
    login = F.regexp_replace("actor", "^person:gh:", "")
    persons = people.select(F.col("actor").alias("entity_id"), "source", F.lit("person").alias("type"), F.create_map(F.lit("login"), login, F.lit("is_bot"), (login.endswith("[bot]") | login.endswith("-bot")).cast("string")).alias("attrs"), F.lit(DIRECT).alias("tier"), "seq")

    def link(df, target, method, tier, why, rank, at):
        return df.select(F.col("eid").alias("src"), target.alias("target"), method.alias("method"), tier.cast("int").alias("tier"), F.lit(why).alias("rationale"), F.lit(None).cast("string").alias("materialise"), F.lit(False).alias("virtual"), rank.isNotNull().alias("anchors"), rank.cast("int").alias("anchor_rank"), F.lit(False).alias("fallback"), (F.col("number") * 1000 + at).alias("decl_seq"))

    none = F.lit(None).cast("int")
    links = link(i, F.col("eid"), F.lit("record-identity"), F.lit(DIRECT), "the item has its own timeline", F.when(F.col("is_pr"), 0).otherwise(5), 0)
    r = i.select("*", F.explode(X.references(F.concat_ws("\n", "title", "body"))).alias("r"))
    target = lambda pr, num: F.when(pr, F.concat(F.lit("pr:"), num.cast("string"))).otherwise(F.concat_ws(":", F.lit("issue"), "slug", num.cast("string")))
    cited = r.withColumn("to", target(F.col("r.kind") == "pr", F.col("r.number"))).filter("to <> eid")
    links = links.unionByName(link(cited, F.col("to"), F.lit("reference"), F.col("r.tier"), "the text refers to it", none, 1))
    crossed = t.filter(F.col("act").isin("cross_referenced", "connected") & F.col("e.source.issue.number").isNotNull())
    links = links.unionByName(link(crossed, target(F.col("e.source.issue.pull_request").isNotNull(), F.col("e.source.issue.number")), F.concat(F.lit("timeline-"), "e.event"), F.lit(JOINED), "the timeline records it", none, 2))
    merged = i.filter("merge_commit_sha <> ''")
    links = links.unionByName(link(merged, F.concat(F.lit("commit:"), "merge_commit_sha"), F.lit("merge-commit-sha"), F.lit(JOINED), "the pull request names the commit it merged", none, 3))
    return shaped(payload.sparkSession, entities.unionByName(persons, allowMissingColumns=True), events, None, links)
