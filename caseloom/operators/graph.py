"""Connected components by alternating large and small stars, with lineage cut in the shared folder each round."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where that is unset, a folder under the warehouse serves one machine, and a cluster is refused."""
    given = spark.conf.get("spark.checkpoint.dir", None)
    if not given and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return (given or spark.conf.get("spark.sql.warehouse.dir") + "/_caseloom").rstrip("/")


def materialise(df: DataFrame) -> DataFrame:
    """Write and read back: later rounds do not recompute earlier ones, and no executor holds the only copy."""
    path = f"{_folder(df.sparkSession)}/step-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def connected_components(nodes: DataFrame, edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for nodes (node and any more columns, which are kept) and edges (a, b): the least node reachable.

    Leaves, the nodes of one edge, are set aside with the node they hang from; only edges between other nodes go through
    rounds, and where there are none no round is made. Rounds grow with the logarithm of the longest chain. Every step is
    an aggregation with map-side combination and a join against one row per node, so hot nodes spread. Nodes without edges
    keep themselves; null ends are no edges.
    """
    e = materialise(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("a is not null and b is not null and u <> v").distinct())
    # one row a node of one edge; the two ends of an edge that stands alone become the leaf (the greater) and its node
    ends = e.select(F.col("u").alias("leaf"), F.col("v").alias("hub")).unionByName(e.select(F.col("v").alias("leaf"), F.col("u").alias("hub")))
    one = ends.groupBy("leaf").agg(F.min("hub").alias("hub"), F.count(F.lit(1)).alias("n")).filter("n = 1")
    hung = materialise(one.groupBy(F.greatest("leaf", "hub").alias("u"), F.least("leaf", "hub").alias("v")).agg(F.max("leaf").alias("leaf")).select("u", "v", "leaf", F.when(F.col("leaf") == F.col("u"), F.col("v")).otherwise(F.col("u")).alias("hub")))
    low = hung.groupBy(F.col("hub").alias("node")).agg(F.least(F.min("leaf"), F.col("hub")).alias("low"))
    if hung.count() < e.count():
        inner = _rounds(materialise(e.join(hung.select("u", "v"), ["u", "v"], "left_anti")), max_rounds)
        kept = inner.unionByName(inner.select(F.col("v").alias("u"), "v").distinct()).select(F.col("u").alias("node"), F.col("v").alias("top"))
        both = kept.join(low, "node", "full").select("node", F.coalesce("top", "node").alias("top"), F.coalesce("low", "node").alias("low"))
        low = materialise(both.join(both.groupBy("top").agg(F.min("low").alias("component")), "top").select("node", F.col("component").alias("low")))
    label = low.select("node", "low").unionByName(hung.select(F.col("leaf"), F.col("hub").alias("node")).join(low, "node").select(F.col("leaf").alias("node"), "low"))
    return nodes.join(label, "node", "left").select("node", F.coalesce("low", "node").alias("component"), *[c for c in nodes.columns if c != "node"])


def _rounds(e: DataFrame, max_rounds: int) -> DataFrame:
    """(u, v): the least node v that each other end u of the edges (u, v) reaches."""
    for _ in range(max_rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        new = materialise(small.unionByName(least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct())
        same = new.count() == e.count() and new.join(e, ["u", "v"], "left_anti").isEmpty()
        e = new
        if same:
            return e
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
