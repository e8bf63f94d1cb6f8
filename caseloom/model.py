"""Canonical schemas, confidence tiers and their helpers.

Every claim has an ordinal tier and a pointer to its record; unknown actors, times and orders stay null.
"""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TIERS = ("model", "heuristic", "joined", "direct")  # 1 to 4
MODEL, HEURISTIC, JOINED, DIRECT = 1, 2, 3, 4

EVIDENCE = T.StructType([T.StructField(n, T.StringType()) for n in ("source", "locator", "snippet")])
CONFIDENCE = T.StructType([T.StructField("tier", T.IntegerType()), T.StructField("rationale", T.StringType())])
ATTRS = T.MapType(T.StringType(), T.StringType())


def _schema(**cols: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in cols.items()])


_S, _L, _I, _B, _TS = T.StringType(), T.LongType(), T.IntegerType(), T.BooleanType(), T.TimestampType()
ENTITIES = _schema(entity_id=_S, source=_S, type=_S, attrs=ATTRS, text=_S, tier=_I, rationale=_S, locator=_S, snippet=_S, seq=_L)
EVENTS = _schema(event_id=_S, entity_id=_S, action=_S, source=_S, ts_raw=_S, ts=_TS, has_time=_B, actor=_S, tier=_I, locator=_S, seq=_L)
OBSERVATIONS = _schema(obs_id=_S, entity_id=_S, state=ATTRS, source=_S, seen_at_raw=_S, seen_at=_TS, tier=_I, locator=_S, seq=_L)
LINKS = _schema(src=_S, target=_S, method=_S, tier=_I, rationale=_S, materialise=_S, virtual=_B, anchors=_B, anchor_rank=_I, fallback=_B, decl_seq=_L)


def tier_label(tier: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, TIERS)), tier.cast("int"))


def confidence(tier: int, rationale: str | Column | None = None) -> Column:
    why = rationale if isinstance(rationale, Column) else F.lit(rationale).cast("string")
    return F.struct(F.lit(tier).alias("tier"), why.alias("rationale"))


def weakest(tier: Column, rationale: Column) -> Column:
    """Aggregate: the confidence of a chain is that of its weakest link (first by rationale among equals)."""
    return F.min(F.struct(tier.alias("tier"), rationale.alias("rationale")))


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Select the columns of ``schema`` in order, missing ones as typed nulls."""
    have = set(df.columns)
    return df.select(*[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields])


@dataclass
class Shaped:
    """What a source gives: four DataFrames in the canonical schemas."""

    entities: DataFrame
    events: DataFrame
    observations: DataFrame
    links: DataFrame

    def extend(self, other: "Shaped") -> "Shaped":
        return Shaped(*(getattr(self, f.name).unionByName(getattr(other, f.name), allowMissingColumns=True) for f in fields(self)))


def shaped(spark, entities=None, events=None, observations=None, links=None) -> Shaped:
    """Any part that a source does not have is empty."""
    parts = []
    for df, schema in ((entities, ENTITIES), (events, EVENTS), (observations, OBSERVATIONS), (links, LINKS)):
        parts.append(spark.createDataFrame([], schema) if df is None else conform(df, schema))
    return Shaped(*parts)
