"""XES event logs (plain or gzip) by Spark's XML reader: one row per event of every trace."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_ATTR = "array<struct<_key:string,_value:string>>"
_EVENT = f"array<struct<string:{_ATTR},date:{_ATTR}>>"


def read(spark: SparkSession, path: str, lifecycle: str | None = "complete") -> DataFrame:
    """(case_id, activity, timestamp, resource, lifecycle, row); events of other lifecycle transitions are left out."""
    t = spark.read.schema(f"string {_ATTR}, event {_EVENT}").format("xml").option("rowTag", "trace").load(path)
    get = lambda col, key: F.get(F.filter(col, lambda x: x["_key"] == key), F.lit(0))["_value"]
    e = t.select(get(F.col("string"), "concept:name").alias("case_id"), F.posexplode("event").alias("row", "e"))
    e = e.select("case_id", get(F.col("e.string"), "concept:name").alias("activity"), get(F.col("e.date"), "time:timestamp").alias("timestamp"), get(F.col("e.string"), "org:resource").alias("resource"), get(F.col("e.string"), "lifecycle:transition").alias("lifecycle"), "row")
    return e if lifecycle is None else e.filter(F.coalesce(F.lower("lifecycle"), F.lit(lifecycle)) == lifecycle)
