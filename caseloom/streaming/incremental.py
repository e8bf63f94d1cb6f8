"""The batch operators over streams: sessions by silence, and counts of activities and directly-follows pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import traces as T


def sessions(events: DataFrame, key: str, ts: str = "ts", gap: str = "12 hours", late: str = "1 day") -> DataFrame:
    """(key, first_ts, closes_at, n) of sessions that the watermark has closed. ``ts`` must be a timestamp with zone."""
    w = events.withWatermark(ts, late).groupBy(F.session_window(ts, gap).alias("w"), key).agg(F.count(F.lit(1)).alias("n"))
    return w.select(key, F.col("w.start").alias("first_ts"), F.col("w.end").alias("closes_at"), "n")


def activity_counts(events: DataFrame, activity: str, ts: str = "ts", window: str = "1 hour", late: str = "1 day") -> DataFrame:
    """(start, activity, n) of tumbling windows."""
    g = events.withWatermark(ts, late).groupBy(F.window(ts, window).alias("w"), F.col(activity).alias("activity")).agg(F.count(F.lit(1)).alias("n"))
    return g.select(F.col("w.start").alias("start"), "activity", "n")


def merge_counts(spark: SparkSession, path: str, batch: DataFrame, epoch: int) -> None:
    """Add a micro-batch's directly-follows pairs (complete traces) as its own partition: a batch that is run again after
    a failure overwrites itself, so counts never double."""
    T.dfg_edges(batch, []).withColumn("epoch", F.lit(epoch)).write.mode("overwrite").parquet(f"{path}/epoch={epoch}")


def start_graph(traces: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Keep directly-follows counts of a stream of traces (column trace) under ``path``."""
    return traces.writeStream.foreachBatch(lambda df, epoch: merge_counts(df.sparkSession, path, df, epoch)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def graph(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("recursiveFileLookup", True).parquet(path).groupBy("from_activity", "to_activity").agg(F.sum("n").alias("n"))
