"""Link resolution, first claims, anchors, case assembly and weakest-link confidence.

Links are an edge table: src, target, method, tier, rationale, materialise, virtual, anchors, anchor_rank, fallback,
decl_seq. Resolution never drops a record: links that point nowhere come back as unresolved, records in no case as
orphans.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import connected_components, materialise

SKIP_TYPES = ("person", "orphan_row")


def dedupe_links(links: DataFrame) -> DataFrame:
    """The first declaration of each (src, target, method)."""
    w = Window.partitionBy("src", "target", "method").orderBy("decl_seq")
    return links.withColumn("__r", F.row_number().over(w)).filter("__r = 1").drop("__r")


def sources_of(members: DataFrame) -> DataFrame:
    """(component, sources, single): the systems of each component's records (component, source), and whether it is one."""
    g = members.groupBy("component").agg(F.array_sort(F.collect_set("source")).alias("s"))
    return g.select("component", F.array_join("s", ",").alias("sources"), (F.size("s") == 1).alias("single"))


def resolve(entities: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(links with resolved boolean, invented nodes (node, kind, virtual)).

    Firm links apply strongest tier first, then as declared. A link resolves if its target exists, or was invented by a
    link that applies no later and may materialise it or names a virtual node; the order matters, because a dangling
    reference that comes before the link that invents its target is a finding.
    """
    order = F.struct(F.col("fallback"), (-F.col("tier")).alias("t"), F.col("decl_seq"))
    known = entities.select(F.col("entity_id").alias("target"), F.lit(True).alias("__known"))
    l = links.withColumn("__o", order).join(known, "target", "left")
    makers = l.filter(F.col("__known").isNull() & (F.col("materialise").isNotNull() | F.col("virtual"))).groupBy("target").agg(F.min("__o").alias("__made"), F.min_by(F.struct(F.col("materialise").alias("kind"), F.col("materialise").isNull().alias("virtual")), "__o").alias("__how"))
    l = l.join(makers.select("target", "__made"), "target", "left")
    resolved = F.coalesce(F.col("__known"), F.lit(False)) | F.coalesce(F.col("__made") <= F.col("__o"), F.lit(False))
    out = l.withColumn("resolved", resolved).drop("__o", "__known", "__made")
    return out, makers.select(F.col("target").alias("node"), F.col("__how.kind").alias("kind"), F.col("__how.virtual").alias("virtual"))


def first_claims(links: DataFrame) -> DataFrame:
    """(node, tier, rationale, method): of the links that attach a node, from either end, the strongest, first declared."""
    ends = F.explode(F.array(F.struct(F.col("src").alias("node"), F.lit(0).alias("end")), F.struct(F.col("target").alias("node"), F.lit(1).alias("end"))))
    e = links.filter("resolved and src <> target").select(ends.alias("e"), "tier", "rationale", "method", "decl_seq")
    return e.groupBy(F.col("e.node").alias("node")).agg(F.min_by(F.struct("tier", "rationale", "method"), F.struct((-F.col("tier")).alias("t"), "decl_seq", F.col("e.end").alias("end"))).alias("c")).select("node", "c.*")


def anchor_claims(links: DataFrame) -> DataFrame:
    """(node, anchor_rank, method, tier): the first link in order of strength that names the node as a run."""
    named = links.filter("anchors and (resolved or src = target)")
    return named.groupBy(F.col("target").alias("node")).agg(F.min_by(F.struct("anchor_rank", "method", "tier"), F.struct(F.col("fallback"), (-F.col("tier")).alias("t"), "decl_seq")).alias("c")).select("node", "c.*")


class Cases:
    """What links make of records. Each table is worked out when it is first asked for, and steps that several share once.

    cases: case_id, anchor, kind_hint, tier, rationale; members: case_id, entity_id; unresolved: src, target, method; loose:
    entity_id of records in no case.
    """

    def __init__(self, entities: DataFrame, records: DataFrame, links: DataFrame):
        # one row a record, written once: its source is not read again by every step below
        self._entities = materialise(entities.filter(~F.col("type").isin(*SKIP_TYPES)).select("entity_id", "type").dropDuplicates(["entity_id"]))
        self._records = records
        # sources are known before the first declaration is looked for: both need rows of a source together
        linked = dedupe_links(links.join(self._entities.select(F.col("entity_id").alias("src")), "src", "left_semi"))
        linked, self._invented = resolve(self._entities, linked)
        self._linked = materialise(linked)

    @cached_property
    def _parts(self) -> tuple[DataFrame, DataFrame]:
        """(components (node, component, type, real), links that apply)."""
        linked = self._linked
        pairs = linked.filter("resolved and not fallback").select(F.col("src").alias("a"), F.col("target").alias("b"))
        known = self._entities.select(F.col("entity_id").alias("node"), "type", F.lit(True).alias("real"))
        nodes = known.unionByName(self._invented.select("node", F.lit(None).cast("string").alias("type"), F.lit(False).alias("real")))
        firm = connected_components(nodes, pairs)
        if linked.filter("fallback").isEmpty():
            return firm, linked
        alone = firm.groupBy("component").agg(F.count(F.lit(1)).alias("n")).filter("n = 1").select(F.col("component").alias("src"))
        first = linked.filter("resolved and fallback").join(alone, "src", "left_semi").groupBy("src").agg(F.min_by("target", "decl_seq").alias("target"))
        comp = connected_components(nodes, pairs.unionByName(first.select(F.col("src").alias("a"), F.col("target").alias("b"))))
        return comp, linked.join(first.withColumn("__f", F.lit(True)), ["src", "target"], "left").filter("not fallback or __f").drop("__f")

    @cached_property
    def _named(self) -> DataFrame:
        """One row a case, with its component."""
        comp, live = self._parts
        claims, attach = anchor_claims(live), first_claims(live)
        n = comp.join(self._records.select(F.col("entity_id").alias("node"), "n"), "node", "left").join(claims, "node", "left")
        n = n.join(attach.select("node", F.struct("tier", "rationale").alias("link")), "node", "left")
        rank = F.struct(F.coalesce("anchor_rank", F.lit(99)).alias("rank"), F.col("real").alias("entity"), (-F.coalesce("n", F.lit(0))).alias("few"), F.col("node").alias("id"), "type", F.col("tier").alias("own"))
        g = n.groupBy("component").agg(
            F.coalesce(F.sum("n"), F.lit(0)).alias("records"), F.count("method").alias("claimed"),
            F.min(F.when(F.col("method").isNotNull(), rank)).alias("pick"), F.min("link").alias("weakest"),
        )
        g = g.filter("records > 0 and claimed > 0").select("component", F.col("pick.id").alias("anchor"), F.col("pick.type").alias("type"), F.col("pick.own").alias("own"), "weakest")
        named = g.join(self._invented.select(F.col("node").alias("anchor"), "kind"), "anchor", "left")
        return named.select(
            "component", F.concat(F.lit("case:"), "anchor").alias("case_id"), "anchor",
            F.coalesce("type", "kind", F.substring_index("anchor", ":", 1)).alias("kind_hint"),
            F.least(F.col("weakest.tier"), F.col("own")).alias("tier"), F.col("weakest.rationale").alias("rationale"),
        )

    @cached_property
    def cases(self) -> DataFrame:
        return self._named.drop("component")

    @cached_property
    def members(self) -> DataFrame:
        real = self._parts[0].filter("real")
        return real.join(self._named.select("component", "case_id"), "component").select("case_id", F.col("node").alias("entity_id"))

    @cached_property
    def loose(self) -> DataFrame:
        real = self._parts[0].filter("real")
        return real.join(self._named.select("component"), "component", "left_anti").select(F.col("node").alias("entity_id"))

    @cached_property
    def unresolved(self) -> DataFrame:
        return self._linked.filter("not resolved").select("src", "target", "method")


def build_cases(entities: DataFrame, records: DataFrame, links: DataFrame) -> Cases:
    """Components over resolved links become cases where some node has records and some node claims to be a run.

    ``records``: entity_id and n, its events and observations. Fallback links apply to nodes that firm links leave alone.
    """
    return Cases(entities, records, links)


def anchor_attrs(node: Column) -> dict[str, Column]:
    """type, key after the first colon and number where the key is one."""
    key = F.regexp_replace(node, r"^[^:]*:", "")
    return {"type": F.substring_index(node, ":", 1), "key": key, "number": key.try_cast("bigint")}
