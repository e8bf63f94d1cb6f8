"""Long event logs: one row per event. Attributes of a case are those of its first row; rows without a case or an
activity are orphans."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import dates as D
from ..model import DIRECT, Shaped, shaped


@dataclass
class EventLogSpec:
    source: str
    entity_type: str
    case: str
    activity: str
    timestamp: str | None = None
    actor: str | None = None
    attributes: list[str] = field(default_factory=list)


def first_cases(rows: DataFrame, case: str, n: int) -> DataFrame:
    """Rows of the first ``n`` cases in file order."""
    keep = rows.filter(F.col(case) != "").groupBy(case).agg(F.min("row").alias("__first")).orderBy("__first").limit(n)
    return rows.join(F.broadcast(keep.select(case)), case, "left_semi")  # n rows


def shape(rows: DataFrame, spec: EventLogSpec, max_cases: int | None = None) -> Shaped:
    """``rows``: string columns and ``row``, the place in the file."""
    if max_cases is not None:
        rows = first_cases(rows, spec.case, max_cases)
    blank = lambda c: F.nullif(F.trim(F.col(f"`{c}`")), F.lit(""))
    rows = rows.withColumn("__case", blank(spec.case)).withColumn("__act", blank(spec.activity))
    whole = F.col("__case").isNotNull() & F.col("__act").isNotNull()
    good, bad = rows.filter(whole), rows.filter(~whole)
    eid = F.concat(F.lit(f"{spec.entity_type}:"), F.col("__case"))
    loc = F.concat(F.lit("row "), (F.col("row") + 1).cast("string"))
    first = good.groupBy("__case").agg(F.min_by(F.struct(*[F.col(f"`{a}`").alias(a) for a in spec.attributes], "row"), "row").alias("f"))
    attrs = F.map_from_arrays(F.array(*map(F.lit, spec.attributes)), F.array(*[F.col("f")[a] for a in spec.attributes])) if spec.attributes else F.create_map().cast("map<string,string>")
    entities = first.select(eid.alias("entity_id"), F.lit(spec.source).alias("source"), F.lit(spec.entity_type).alias("type"), attrs.alias("attrs"), F.lit(DIRECT).alias("tier"), F.concat(F.lit("row "), (F.col("f.row") + 1).cast("string")).alias("locator"), F.col("f.row").alias("seq"))
    orphans = bad.select(F.concat(F.lit(f"orphan_row:{spec.source}:"), F.col("row").cast("string")).alias("entity_id"), F.lit(spec.source).alias("source"), F.lit("orphan_row").alias("type"), F.lit("no case or no activity").alias("rationale"), F.lit(DIRECT).alias("tier"), loc.alias("locator"), F.col("row").alias("seq"))
    raw = F.col(f"`{spec.timestamp}`") if spec.timestamp else F.lit(None).cast("string")
    who = blank(spec.actor) if spec.actor else F.lit(None).cast("string")
    events = good.select(F.concat(F.lit(f"ev:{spec.source}:"), F.col("row").cast("string")).alias("event_id"), eid.alias("entity_id"), F.col("__act").alias("action"), F.lit(spec.source).alias("source"), raw.alias("ts_raw"), D.parse_timestamp(raw).alias("ts"), D.has_time(raw).alias("has_time"), F.when(who.isNotNull(), F.concat(F.lit("person:"), F.lower(who))).alias("actor"), F.lit(DIRECT).alias("tier"), loc.alias("locator"), F.col("row").alias("seq"))
    links = entities.select(F.col("entity_id").alias("src"), F.col("entity_id").alias("target"), F.lit("case-id").alias("method"), F.lit(DIRECT).alias("tier"), F.lit("rows share the case id").alias("rationale"), F.lit(None).cast("string").alias("materialise"), F.lit(False).alias("virtual"), F.lit(True).alias("anchors"), F.lit(5).alias("anchor_rank"), F.lit(False).alias("fallback"), F.col("seq").alias("decl_seq"))
    return shaped(rows.sparkSession, entities.unionByName(orphans, allowMissingColumns=True), events, None, links)
