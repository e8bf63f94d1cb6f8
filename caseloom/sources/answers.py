"""Review answers: a JSON document of claim, answer rows; the last valid one of each claim wins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.evidence import last_answers


def read(spark: SparkSession, path: str) -> DataFrame:
    """(claim, answer). A file that is not JSON is an error; a row that is not an answer is skipped."""
    raw = spark.read.schema("answers array<struct<claim:string,answer:string>>").json(path, multiLine=True, mode="FAILFAST")
    return last_answers(raw.select(F.posexplode("answers").alias("position", "a")).select("position", "a.claim", "a.answer").filter("claim is not null"))
