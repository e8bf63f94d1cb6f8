"""Person registries: who acts, how often, under which name, and whether it is a machine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def registry(actors: DataFrame) -> DataFrame:
    """(person_id, n, first_seen, last_seen, is_bot) of rows person_id, name, is_bot, seq; rows without a person are left
    out."""
    a = actors.filter("person_id is not null")
    return a.groupBy("person_id").agg(F.count(F.lit(1)).alias("n"), F.min_by("name", "seq").alias("first_seen"), F.max_by("name", "seq").alias("last_seen"), F.max("is_bot").alias("is_bot"))
