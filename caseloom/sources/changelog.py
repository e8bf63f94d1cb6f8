"""Changelogs: version headings, status lines and bullets to observations without a time, by windows over line numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..model import DIRECT, HEURISTIC, JOINED, Shaped, shaped


def read(spark: SparkSession, path: str) -> DataFrame:
    """(file, no, line) of every file under ``path``."""
    whole = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.split("value", r"\r?\n").alias("l"))
    return whole.select("file", F.posexplode("l").alias("no", "line"))


def bullets(lines: DataFrame) -> DataFrame:
    """(file, version, status, idx, text, no): a bullet goes on over lines indented by four."""
    w = Window.partitionBy("file").orderBy("no")
    v = F.when(F.col("line").rlike(r"^Version \S+") & F.lead("line").over(w).rlike(r"^\s*-+\s*$"), F.regexp_extract("line", r"^Version (\S+)", 1))
    l = lines.withColumn("v", v).withColumn("version", F.last("v", True).over(w)).filter("version is not null")
    by = Window.partitionBy("file", "version").orderBy("no")
    s = F.nullif(F.regexp_extract(F.trim("line"), r"^(Released|Unreleased)", 1), F.lit(""))
    starts = F.col("line").startswith("-   ")
    more = F.col("line").rlike(r"^    (?!-)\s*\S")
    l = l.withColumn("status", F.last(s, True).over(by)).withColumn("start", starts.cast("int")).withColumn("b", F.sum("start").over(by))
    l = l.withColumn("broken", F.sum((~starts & ~more).cast("int")).over(Window.partitionBy("file", "version", "b").orderBy("no"))).filter("b > 0 and broken = 0")
    g = l.groupBy("file", "version", "b").agg(F.array_sort(F.collect_list(F.struct("no", F.trim(F.regexp_replace("line", r"^-   ", "")).alias("t")))).alias("p"), F.first("status").alias("status"), F.min("no").alias("no"))
    return g.select("file", "version", "status", (F.col("b") - 1).cast("int").alias("idx"), F.array_join(F.transform("p", lambda x: x["t"]), " ").alias("text"), (F.col("no") + 1).alias("no"))


def shape(lines: DataFrame, slug: str) -> Shaped:
    source = f"changelog:{slug}"
    b = bullets(lines).withColumn("eid", F.concat_ws(":", F.lit(f"changelog_entry:{slug}"), "version", F.col("idx").cast("string"))).withColumn("locator", F.concat(F.lit("L"), F.col("no").cast("string")))
    state = F.create_map(F.lit("version"), F.col("version"), F.lit("status"), F.col("status"), F.lit("text"), F.col("text"))
    entities = b.select(F.col("eid").alias("entity_id"), F.lit(source).alias("source"), F.lit("changelog_entry").alias("type"), state.alias("attrs"), "text", F.lit(DIRECT).alias("tier"), "locator", F.left("text", F.lit(200)).alias("snippet"), F.col("no").alias("seq"))
    obs = b.select(F.concat(F.lit("obs:"), "eid").alias("obs_id"), F.col("eid").alias("entity_id"), state.alias("state"), F.lit(source).alias("source"), F.lit(DIRECT).alias("tier"), "locator", F.col("no").alias("seq"))
    role = lambda p: F.transform(F.regexp_extract_all("text", F.lit(p), F.lit(1)), lambda x: x.cast("bigint"))
    prs, issues = role(r"(?i):(?:pr|pull):`(\d+)`"), role(r"(?i):issue:`(\d+)`")
    bare = F.array_except(F.transform(F.filter(X.references(F.col("text")), lambda r: r["kind"] == "issue"), lambda r: r["number"]), F.concat(prs, issues))
    to = F.concat(F.transform(F.array_distinct(prs), lambda x: F.concat(F.lit("pr:"), x.cast("string"))), F.transform(F.array_distinct(F.concat(issues, bare)), lambda x: F.concat(F.lit(f"issue:{slug}:"), x.cast("string"))))
    no = [F.lit(None).cast("string").alias("materialise")]
    cite = b.select(F.col("eid").alias("src"), F.explode(to).alias("target"), F.lit("changelog-citation").alias("method"), F.lit(JOINED).alias("tier"), F.lit("the bullet cites it").alias("rationale"), *no, F.lit(False).alias("virtual"), F.lit(False).alias("anchors"), F.lit(None).cast("int").alias("anchor_rank"), F.lit(False).alias("fallback"), F.col("no").cast("long").alias("decl_seq"))
    own = b.select(F.col("eid").alias("src"), F.concat_ws(":", F.lit(f"notes:{slug}"), "version").alias("target"), F.lit("version-section").alias("method"), F.lit(HEURISTIC).alias("tier"), F.lit("a section has no times, actors or order").alias("rationale"), *no, F.lit(True).alias("virtual"), F.lit(True).alias("anchors"), F.lit(0).alias("anchor_rank"), F.lit(True).alias("fallback"), F.col("no").cast("long").alias("decl_seq"))
    return shaped(lines.sparkSession, entities, None, obs, cite.unionByName(own))
