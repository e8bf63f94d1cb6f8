"""Gaps: steps that no system recorded, and references that point nowhere."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .traces import micros


def reconciliation(log: DataFrame, terminal: str = "paid", corroborating: str = "settled") -> DataFrame:
    """(case_id, kind): runs that reached ``terminal`` without ``corroborating``, where any run has the latter at all."""
    c = log.groupBy("case_id").agg(F.bool_or(F.col("activity") == terminal).alias("t"), F.bool_or(F.col("activity") == corroborating).alias("s"))
    any_ = log.agg(F.coalesce(F.bool_or(F.col("activity") == corroborating), F.lit(False)).alias("have"))
    return c.filter("t and not s").crossJoin(F.broadcast(any_)).filter("have").select("case_id", F.lit("reconciliation").alias("kind"))  # any_ is one row


def unresolved(links: DataFrame, entities: DataFrame) -> DataFrame:
    """Links whose target is no entity."""
    return links.join(entities.select(F.col("entity_id").alias("target")), "target", "left_anti")


def delays(df: DataFrame, first: str, second: str, days: float) -> DataFrame:
    """Rows whose ``second`` is at least ``days`` after ``first``, with whole days between."""
    span = micros(F.col(second)) - micros(F.col(first))
    return df.filter(span >= int(days * 86_400_000_000)).withColumn("days", F.floor(span / 86_400_000_000))


def off_system_review(log: DataFrame) -> DataFrame:
    """Runs that were merged with no review on record."""
    g = log.groupBy("case_id").agg(F.bool_or(F.col("activity") == "merged").alias("m"), F.bool_or(F.col("activity") == "reviewed").alias("r"))
    return g.filter("m and not r").select("case_id", F.lit("off_system_pr_open_review").alias("kind"))


def orphan_reason(kind: str = "type") -> Column:
    """Why a record is in no case, by what it is."""
    t = F.col(kind)
    return F.when(t == "orphan_row", "no identity key").when(t == "commit", "no reference and in no merge").when(t == "email", "no reply and no thread").when(t.isin("observation", "changelog_entry"), "a mention without a record").otherwise("nothing refers to it and it claims no run")


def orphans(records: DataFrame, members: DataFrame) -> DataFrame:
    """(entity_id, record, reason): the first record of every entity in no case. ``records``: entity_id, record, type, seq."""
    left = records.join(members.select("entity_id").distinct(), "entity_id", "left_anti")
    return left.groupBy("entity_id").agg(F.min_by(F.struct("record", "type"), "seq").alias("r")).select("entity_id", "r.record", F.col("r.type").alias("type")).select("entity_id", "record", orphan_reason().alias("reason"))
