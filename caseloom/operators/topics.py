"""Topics of a structural cluster: components of the similarity join, where the vocabulary supports a split."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .graph import connected_components, materialise
from .similarity import similar_pairs, token_idf, tokens


def refine(docs: DataFrame, spark_total: int, min_score: float = 0.3, min_dominance: float = 0.9, min_cases: int = 25, min_topic: int = 3, min_share: float = 0.02, max_topics: int = 24) -> DataFrame:
    """(id, topic, terms): rows (id, text) that land in a topic; the others stay with their cluster, absent here.

    Declines (no rows) if the cluster is under ``min_dominance`` of the corpus, has too few texts, or gives fewer than two
    topics of max(min_topic, min_share) rows. Topics are numbered by size; terms are the four words that carry most
    weight in the joins inside the topic.
    """
    docs = docs.filter("text is not null and trim(text) <> ''")
    n = docs.count()
    nothing = docs.sparkSession.createDataFrame([], "id string, topic long, terms string")
    if n < spark_total * min_dominance or n < min_cases:
        return nothing
    pairs = materialise(similar_pairs(docs, min_score=min_score).select("a", "b", "shared_content"))
    comp = connected_components(docs.select(F.col("id").alias("node")), pairs)
    floor = max(min_topic, round(n * min_share))
    size = comp.groupBy("component").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= floor)
    kept = materialise(size.withColumn("topic", F.row_number().over(Window.partitionBy().orderBy(F.desc("n"), "component")).cast("long")).filter(F.col("topic") <= max_topics))
    if kept.count() < 2:
        return nothing
    placed = comp.join(kept.select("component", "topic"), "component").select(F.col("node").alias("id"), "topic")
    idf = token_idf(tokens(docs), docs.agg(F.count(F.lit(1)).alias("n")))
    said = pairs.join(placed.withColumnRenamed("id", "a"), "a").select("topic", F.explode(F.split("shared_content", ",")).alias("token")).groupBy("topic", "token").agg(F.count(F.lit(1)).alias("c"))
    weight = said.join(idf, "token").withColumn("k", F.row_number().over(Window.partitionBy("topic").orderBy(F.desc(F.col("c") * F.col("idf")), "token"))).filter("k <= 4")
    terms = weight.groupBy("topic").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "token"))), lambda x: x["token"]), ", ").alias("terms"))
    return placed.join(terms, "topic", "left").select("id", "topic", "terms")
