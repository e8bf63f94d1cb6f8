"""Trackers: one row per case, one date column per step.

Blank rows vanish; a row without an id is an orphan observation; the first row of an id holds its attributes, later ones
are counted and flagged; a row with no readable date is an observation of a state; every date is an event.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import dates as D
from ..functions import text as X
from ..model import DIRECT, JOINED, Shaped, shaped


@dataclass
class StepColumn:
    """A date column: the action it records, and the column that names who did it."""

    date: str
    action: str
    actor: str | None = None


@dataclass
class TableSpec:
    source: str
    entity_type: str
    id_column: str
    steps: list[StepColumn]
    references: dict[str, str] = field(default_factory=dict)  # column -> entity type it refers to
    attributes: list[str] = field(default_factory=list)
    text: list[str] = field(default_factory=list)


def unpivot_dates(df: DataFrame, case: str, steps: dict[str, str]) -> DataFrame:
    """(case, action, ts): one row per non-null date column."""
    long = df.unpivot([case], list(steps), "column", "ts").filter("ts is not null")
    table = F.create_map(*[F.lit(x) for kv in steps.items() for x in kv])
    return long.select(case, table[F.col("column")].alias("action"), "ts")


def read_rows(spark: SparkSession, path: str, sep: str | None = None) -> DataFrame:
    """Cells as trimmed strings, null as empty, in file order (``row``; files by name). The delimiter is the most frequent
    of , ; and tab in the first line unless given.

    Files are read in pieces where no line can be part of a longer record: every quote belongs to a whole quoted cell,
    lines end in a line feed alone and none is of spaces only. Otherwise each file is read by one task. Rows are numbered from the sizes of the pieces.
    """
    first = spark.read.text(path).limit(1).collect()
    head = (first[0].value if first else "").lstrip("﻿")
    sep = sep or max(",;\t", key=lambda c: (head.count(c), -",;\t".index(c)))
    cell, mark = r'[ \t]*+"(?:[^"]++|"")*+"[ \t]*+', re.escape(sep)
    plain = f'[^"{mark}]*+'
    whole = F.col("value").rlike(f"^(?:{cell}|{plain})(?:{mark}(?:{cell}|{plain}))*+$")
    apart = ~F.col("value").contains("\r") & ((F.col("value") == "") | (F.trim("value") != "")) & (~F.col("value").contains('"') | whole)
    multi = not spark.read.option("lineSep", "\n").text(path).filter(~apart).isEmpty()
    raw = spark.read.csv(path, header=True, sep=sep, multiLine=multi, escape='"', ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
    place = [F.col("_metadata.file_path").alias("__file"), F.col("_metadata.file_block_start").alias("__start"), F.monotonically_increasing_id().alias("__at")]
    clean = raw.select(*[F.trim(F.coalesce(F.col(f"`{c}`"), F.lit(""))).alias(c.lstrip("﻿").strip()) for c in raw.columns], *place)
    # one row a piece: the number of its first row, less the place that row has in its task
    pieces = clean.groupBy("__file", "__start").agg(F.min("__at").alias("__first"), F.count(F.lit(1)).alias("__n"))
    earlier = F.sum("__n").over(Window.orderBy("__file", "__start").rowsBetween(Window.unboundedPreceding, -1))
    pieces = pieces.select("__file", "__start", (F.coalesce(earlier, F.lit(0)) - F.col("__first")).alias("__by"))
    return clean.join(F.broadcast(pieces), ["__file", "__start"]).withColumn("row", F.col("__at") + F.col("__by")).drop("__file", "__start", "__at", "__by")


def shape(rows: DataFrame, spec: TableSpec) -> Shaped:
    spark = rows.sparkSession
    cells = [c for c in rows.columns if c != "row"]
    rows = rows.filter(F.concat_ws("", *[f"`{c}`" for c in cells]) != "")
    rows = rows.withColumn("__id", F.nullif(F.trim(spec.id_column), F.lit("")))
    whole = Window.partitionBy("__id")
    keyed = rows.filter("__id is not null").withColumn("__k", F.row_number().over(whole.orderBy("row"))).withColumn("__n", F.count(F.lit(1)).over(whole))
    eid = F.concat(F.lit(f"{spec.entity_type}:"), F.col("__id"))
    loc = F.concat(F.lit("row "), (F.col("row") + 1).cast("string"))

    attrs = F.map_from_arrays(F.array(*[F.lit(a) for a in [*spec.attributes, "n_rows", "duplicate_id"]]), F.array(*[F.col(f"`{a}`") for a in spec.attributes], F.col("__n").cast("string"), (F.col("__n") > 1).cast("string")))
    entities = keyed.filter("__k = 1").select(eid.alias("entity_id"), F.lit(spec.source).alias("source"), F.lit(spec.entity_type).alias("type"), attrs.alias("attrs"), X.pooled_text(*[F.col(f"`{t}`") for t in spec.text]).alias("text") if spec.text else F.lit("").alias("text"), F.lit(DIRECT).alias("tier"), loc.alias("locator"), F.col("row").alias("seq"))
    orphan_rows = rows.filter("__id is null").select(F.concat(F.lit(f"orphan_row:{spec.source}:"), F.col("row").cast("string")).alias("entity_id"), F.lit(spec.source).alias("source"), F.lit("orphan_row").alias("type"), F.lit("no identity key").alias("rationale"), F.lit(DIRECT).alias("tier"), loc.alias("locator"), F.col("row").alias("seq"))

    made = []
    for i, s in enumerate(spec.steps):
        who = F.nullif(F.col(f"`{s.actor}`"), F.lit("")) if s.actor else F.lit(None).cast("string")
        event_id = F.concat_ws(":", F.lit("ev"), eid, F.lit(s.action), F.when(F.col("__k") > 1, F.col("__k").cast("string")))
        raw = F.col(f"`{s.date}`")
        made.append(keyed.select(event_id.alias("event_id"), eid.alias("entity_id"), F.lit(s.action).alias("action"), F.lit(spec.source).alias("source"), raw.alias("ts_raw"), D.parse_date(raw).cast("timestamp").alias("ts"), F.lit(False).alias("has_time"), F.when(who.isNotNull(), F.concat(F.lit("person:"), F.lower(who))).alias("actor"), F.lit(DIRECT).alias("tier"), loc.alias("locator"), (F.col("row") * len(spec.steps) + i).alias("seq")).filter("ts is not null"))
    events = made[0] if made else None
    for m in made[1:]:
        events = events.unionByName(m)

    state = F.map_from_arrays(F.array(*map(F.lit, cells)), F.array(*[F.col(f"`{c}`") for c in cells]))
    dated = F.coalesce(*[D.parse_date(F.col(f"`{s.date}`")) for s in spec.steps]) if spec.steps else F.lit(None)
    states = keyed.filter(dated.isNull()).select(F.concat(F.lit("obs:"), eid, F.lit(":"), F.col("row").cast("string")).alias("obs_id"), eid.alias("entity_id"), state.alias("state"), F.lit(spec.source).alias("source"), F.lit(DIRECT).alias("tier"), loc.alias("locator"), F.col("row").alias("seq"))
    blank = rows.filter("__id is null").select(F.concat(F.lit(f"obs:orphan_row:{spec.source}:"), F.col("row").cast("string")).alias("obs_id"), F.concat(F.lit(f"orphan_row:{spec.source}:"), F.col("row").cast("string")).alias("entity_id"), state.alias("state"), F.lit(spec.source).alias("source"), F.lit(DIRECT).alias("tier"), loc.alias("locator"), F.col("row").alias("seq"))

    no = {"materialise": F.lit(None).cast("string"), "virtual": F.lit(False), "fallback": F.lit(False), "anchors": F.lit(True)}
    links = keyed.filter("__k = 1").select(eid.alias("src"), eid.alias("target"), F.lit("row-identity").alias("method"), F.lit(DIRECT).alias("tier"), F.lit("the row's own id").alias("rationale"), F.lit(5).alias("anchor_rank"), F.col("row").alias("decl_seq"), *[v.alias(k) for k, v in no.items()])
    for i, (col, kind) in enumerate(spec.references.items(), 1):
        ref = F.nullif(F.trim(F.col(f"`{col}`")), F.lit(""))
        links = links.unionByName(keyed.filter(ref.isNotNull()).select(eid.alias("src"), F.concat(F.lit(f"{kind}:"), ref).alias("target"), F.lit("foreign-key").alias("method"), F.lit(JOINED).alias("tier"), F.lit(f"{col} names it").alias("rationale"), F.lit(0).alias("anchor_rank"), (F.col("row") + i).alias("decl_seq"), *[v.alias(k) for k, v in no.items()]))
    return shaped(spark, entities.unionByName(orphan_rows, allowMissingColumns=True), events, states.unionByName(blank), links)
