"""Version-control history: commit JSON lines and tags to records, events and links.

The merge topology is walked with joins: the trunk by a loop over first parents in bulk (pointer jumping), branches of
all merges together, one frontier step a round up to the cap.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..model import DIRECT, HEURISTIC, JOINED, Shaped, shaped
from ..operators.graph import materialise

COMMITS = "sha string, short_sha string, parents array<string>, is_merge boolean, author struct<name:string,email:string>, committer struct<name:string,email:string>, author_date string, committer_date string, refs array<string>, subject string, body string, files array<string>"
TAGS = "name string, commit string, date string"
CAP = 60


def read(spark: SparkSession, commits: str, tags: str | None = None) -> tuple[DataFrame, DataFrame]:
    c = spark.read.schema(COMMITS).json(commits)
    t = spark.read.schema(TAGS).json(tags, multiLine=True) if tags else spark.createDataFrame([], TAGS)
    return c, t


def trunk(commits: DataFrame) -> DataFrame:
    """(sha): the first-parent chain from the commit that no other has as a parent (the latest of them).

    Pointer jumping: reach doubles every round, so a chain of n commits takes log2(n) joins.
    """
    first = commits.select("sha", F.get("parents", F.lit(0)).alias("up"))
    known = commits.select(F.col("sha").alias("up"))
    first = first.join(known, "up", "left_semi").select("sha", "up")
    heads = commits.join(commits.select(F.explode("parents").alias("sha")).distinct(), "sha", "left_anti")
    head = heads.orderBy(F.desc("committer_date"), "sha").limit(1).select("sha")
    on, jump = materialise(head), materialise(first)
    for _ in range(40):
        new = on.join(jump, "sha").select(F.col("up").alias("sha"))
        grown = materialise(on.union(new).distinct())
        if grown.count() == on.count():
            return grown
        # commits already on the chain reach twice as far next time
        j = jump.alias("a").join(jump.alias("b"), F.col("a.up") == F.col("b.sha")).select(F.col("a.sha").alias("sha"), F.col("b.up").alias("up"))
        on, jump = grown, materialise(first.unionByName(j).distinct())
    return on


def branches(commits: DataFrame, on_trunk: DataFrame, merges: DataFrame, stops: DataFrame, cap: int = CAP) -> DataFrame:
    """(merge, sha, depth): commits reachable from a merge's later parents but not on the trunk nor beyond ``stops``."""
    edges = commits.select("sha", F.explode("parents").alias("parent")).join(commits.select(F.col("sha").alias("parent")), "parent", "left_semi")
    edges = edges.join(on_trunk.select(F.col("sha").alias("parent")), "parent", "left_anti")
    edges = edges.join(stops.select(F.col("sha").alias("parent")), "parent", "left_anti")
    edges = materialise(edges)
    front = materialise(merges.select(F.col("sha").alias("merge"), "sha").join(edges, "sha").select("merge", F.col("parent").alias("sha"), F.lit(1).alias("depth")).distinct())
    seen = front
    for d in range(2, cap + 2):
        if front.isEmpty():
            break
        nxt = front.join(edges, "sha").select("merge", F.col("parent").alias("sha")).distinct().join(seen.select("merge", "sha"), ["merge", "sha"], "left_anti").withColumn("depth", F.lit(d))
        front = materialise(nxt)
        seen = seen.unionByName(front)
    return seen


def shape(commits: DataFrame, tags: DataFrame, slug: str) -> Shaped:
    spark, source = commits.sparkSession, f"git:{slug}"
    c = commits.withColumn("seq", F.coalesce(F.unix_timestamp(F.col("committer_date").try_cast("timestamp")), F.lit(0)) * 1)
    c = c.withColumn("eid", F.concat(F.lit("commit:"), "sha")).withColumn("a", X.person_id(F.col("author.email"), F.col("author.name"))).withColumn("k", X.person_id(F.col("committer.email"), F.col("committer.name")))
    c = c.withColumn("refs_", X.references(F.concat_ws("\n", "subject", "body"))).withColumn("branch", F.when(F.col("is_merge"), X.merged_branch(F.col("subject"))))
    c = c.withColumn("squash", F.regexp_extract(F.coalesce("subject", F.lit("")), r"\(#(\d+)\)", 1)).withColumn("pull", F.regexp_extract(F.coalesce("subject", F.lit("")), r"(?i)Merge pull request #(\d+)", 1))
    revert = F.lower(F.trim("subject")).rlike("^(re-)?revert")
    closes = F.col("is_merge") & ((F.col("pull") != "") | (F.col("squash") != "") | F.col("branch").isNotNull())
    c = materialise(c.withColumn("action", F.when(closes, "merged").when(revert, "reverted").otherwise("authored")))
    when = F.when(F.col("action") == "merged", F.col("committer_date")).otherwise(F.col("author_date"))
    entities = c.select(F.col("eid").alias("entity_id"), F.lit(source).alias("source"), F.lit("commit").alias("type"), F.create_map(F.lit("subject"), F.col("subject"), F.lit("n_files"), F.size("files").cast("string"), F.lit("is_merge"), F.col("is_merge").cast("string"), F.lit("branch"), F.col("branch")).alias("attrs"), F.col("subject").alias("text"), F.lit(DIRECT).alias("tier"), F.col("sha").alias("locator"), F.left("subject", F.lit(200)).alias("snippet"), "seq")

    def event(df, id_, action, raw, actor, at):
        return df.select(id_.alias("event_id"), F.col("eid").alias("entity_id"), action.alias("action"), F.lit(source).alias("source"), raw.alias("ts_raw"), raw.try_cast("timestamp").alias("ts"), raw.isNotNull().alias("has_time"), actor.alias("actor"), F.lit(DIRECT).alias("tier"), F.col("sha").alias("locator"), (F.col("seq") * 4 + at).alias("seq"))

    primary = event(c, F.concat_ws(":", F.lit("evt"), "sha", "action"), F.col("action"), when, F.when(F.col("action") == "merged", F.col("k")).otherwise(F.col("a")), 0)
    co = c.filter("action = 'authored'").select("*", F.posexplode(X.co_authors(F.col("body"))).alias("i", "co")).withColumn("who", X.person_id(F.col("co.email"), F.col("co.name"))).filter(~F.col("who").eqNullSafe(F.col("a")))
    coauthored = event(co, F.concat_ws(":", F.lit("evt"), "sha", F.lit("coauthored"), F.col("i").cast("string")), F.lit("authored"), F.col("author_date"), F.col("who"), 1)
    handed = c.filter("action <> 'merged'").filter(~F.col("a").eqNullSafe(F.col("k")) | ~F.col("author_date").eqNullSafe(F.col("committer_date")))
    committed = event(handed, F.concat_ws(":", F.lit("evt"), "sha", F.lit("committed")), F.lit("committed"), F.col("committer_date"), F.col("k"), 2)
    people = c.select(F.explode(F.array(F.struct(F.col("a").alias("id"), F.col("author.name").alias("name")), F.struct(F.col("k").alias("id"), F.col("committer.name").alias("name")))).alias("p"), "seq").filter("p.id is not null").groupBy("p.id").agg(F.max_by("p.name", "seq").alias("name"), F.min("seq").alias("seq"))
    persons = people.select(F.col("id").alias("entity_id"), F.lit(source).alias("source"), F.lit("person").alias("type"), F.create_map(F.lit("name"), F.col("name"), F.lit("is_bot"), X.is_bot(F.col("name")).cast("string")).alias("attrs"), F.lit(DIRECT).alias("tier"), "seq")

    t = tags.withColumn("eid", F.concat(F.lit("release:"), "name")).withColumn("sha", F.concat(F.lit("tag:"), "name")).withColumn("seq", F.lit(0))
    releases = t.select(F.col("eid").alias("entity_id"), F.lit(source).alias("source"), F.lit("release").alias("type"), F.create_map(F.lit("name"), F.col("name"), F.lit("commit"), F.col("commit")).alias("attrs"), F.lit(DIRECT).alias("tier"), F.col("sha").alias("locator"), F.lit(0).alias("seq"))
    released = event(t, F.concat(F.lit("evt:release:"), "name"), F.lit("released"), F.nullif(F.col("date"), F.lit("")), F.lit(None).cast("string"), 3)

    def link(df, target, method, tier, why, kind=None, rank=None, virtual=False, at=0):
        return df.select(F.col("eid").alias("src"), target.alias("target"), F.lit(method).alias("method"), (tier if not isinstance(tier, int) else F.lit(tier)).alias("tier"), F.lit(why).alias("rationale"), F.lit(kind).cast("string").alias("materialise"), F.lit(virtual).alias("virtual"), F.lit(rank is not None).alias("anchors"), F.lit(rank).cast("int").alias("anchor_rank"), F.lit(False).alias("fallback"), (F.col("seq") * 8 + at).alias("decl_seq"))

    merges = c.filter("is_merge and pull <> ''")
    reach = materialise(branches(commits, trunk(commits), merges, c.filter("pull <> '' or squash <> ''").select("sha")))
    big = reach.groupBy("merge").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > CAP).select(F.col("merge").alias("sha"))
    trains, pulls = merges.join(big, "sha", "left_semi"), merges.join(big, "sha", "left_anti")
    owner = reach.join(pulls.select(F.col("sha").alias("merge"), "pull", F.col("seq").alias("__at")), "merge").groupBy("sha").agg(F.min_by("pull", F.struct("__at", "merge")).alias("owner"))
    members = c.join(owner, "sha")
    release = F.lower(F.concat_ws(" ", "subject", "branch")).contains("release")
    pr = lambda n: F.concat(F.lit("pr:"), F.col(n))
    links = link(trains, F.when(release, F.concat(F.lit("release:"), "pull")).otherwise(F.concat(F.lit("integration:pr:"), "pull")), "oversized-merge", HEURISTIC, f"a merge of more than {CAP} commits is a train, not one contribution", None, 0, True)
    links = links.unionByName(link(pulls, pr("pull"), "merge-commit", JOINED, "the merge that closed the pull request", "pr", 0, at=1))
    links = links.unionByName(link(members, pr("owner"), "merge-topology", JOINED, "reachable from the merge and not from the trunk", "pr", 0, at=2))
    claimed = merges.select("sha").union(members.select("sha")).distinct()
    squashed = c.filter("squash <> ''").join(claimed, "sha", "left_anti")
    links = links.unionByName(link(squashed, pr("squash"), "squash-subject", JOINED, "the squashed commit names its pull request", "pr", 0, at=3))
    issues = c.select("*", F.explode("refs_").alias("r")).filter("r.kind = 'issue'").filter((F.col("r.number").cast("string") != F.col("pull")) & (F.col("r.number").cast("string") != F.col("squash")))
    links = links.unionByName(link(issues, F.concat(F.lit(f"issue:{slug}:"), F.col("r.number").cast("string")), "issue-reference", F.col("r.tier"), "a closing word or a mention", "issue", 1, at=4))
    named = c.filter("branch is not null").join(claimed.union(squashed.select("sha")), "sha", "left_anti")
    links = links.unionByName(link(named, F.concat_ws(":", F.lit("integration"), "branch", F.left("sha", F.lit(8))), "branch-merge", JOINED, "a merge of a named branch", None, 0, True, at=5))
    links = links.unionByName(link(t.filter("commit <> ''"), F.concat(F.lit("commit:"), "commit"), "tag-target", JOINED, "the release tags this commit", at=6))
    events = primary.unionByName(coauthored).unionByName(committed).unionByName(released)
    return shaped(spark, entities.unionByName(releases, allowMissingColumns=True).unionByName(persons, allowMissingColumns=True), events, None, links)
