"""From shaped sources to a model of the process: one DataFrame a result, lazily, in the order
links, cases, sessions, traces, kinds, variants, graph, gaps, orphans, performance."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, fields

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import HEURISTIC, Shaped, tier_label
from ..operators import gaps as G
from ..operators import kinds as K
from ..operators import linking, similarity
from ..operators import performance as P
from ..operators import traces as T
from ..operators.graph import connected_components, materialise


@dataclass
class Policy:
    """What a caller may turn. ``cluster`` adds columns to the structural key; ``relabel`` maps actions to activities;
    ``detectors`` add gap tables (case_id, kind)."""

    fuzzy: bool = True
    min_score: float = 0.30
    proximity_days: int = 30
    max_overlap: float = 0.8
    max_rounds: int = 3
    cross_source_only: bool = False
    split_sessions: bool = True
    relabel: dict[str, str] = field(default_factory=dict)
    terminal: str = "paid"
    corroborating: str = "settled"
    detectors: list[Callable[[DataFrame], DataFrame]] = field(default_factory=list)


@dataclass
class Model:
    cases: DataFrame
    members: DataFrame
    events: DataFrame
    runs: DataFrame
    kinds: DataFrame
    variants: DataFrame
    nodes: DataFrame
    edges: DataFrame
    steps: DataFrame
    merges: DataFrame
    gaps: DataFrame
    orphans: DataFrame
    waits: DataFrame
    cycle: DataFrame
    headline: DataFrame

    def tables(self) -> dict[str, DataFrame]:
        return {f.name: getattr(self, f.name) for f in fields(self)}


def fuzzy_links(cases: DataFrame, loose: DataFrame, members: DataFrame, entities: DataFrame, events: DataFrame, policy: Policy) -> DataFrame:
    """(a, b, score): groups (cases and loose records) that text and proximity join, one partner each."""
    groups = members.select(F.col("case_id").alias("g"), "entity_id").unionByName(loose.select(F.concat(F.lit("loose:"), "entity_id").alias("g"), "entity_id"))
    e = groups.join(entities.select("entity_id", "text", "source", "seq"), "entity_id")
    said = e.filter("text is not null and trim(text) <> ''").groupBy("g").agg(F.left(F.array_join(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda x: x["text"])), " "), F.lit(4000)).alias("text"))
    pairs = materialise(similarity.similar_pairs(said.withColumnRenamed("g", "id"), min_score=policy.min_score, prefix=True).select("a", "b", "score"))
    log = groups.join(events, "entity_id").select(F.col("g").alias("case_id"), "action", "actor", "ts")
    traits = log.groupBy("case_id").agg(F.collect_set("actor").alias("who"), F.collect_set("action").alias("acts"))
    systems = e.groupBy("g").agg(F.collect_set("source").alias("sys"))
    both = pairs
    for s in ("a", "b"):
        both = both.join(traits.select(F.col("case_id").alias(s), F.col("who").alias(f"who_{s}"), F.col("acts").alias(f"acts_{s}")), s, "left").join(systems.select(F.col("g").alias(s), F.col("sys").alias(f"sys_{s}")), s, "left")
    near = similarity.near_in_time(log, pairs, policy.proximity_days).withColumn("near", F.lit(True)).drop("min_days")
    both = both.join(near, ["a", "b"], "left")
    known = F.coalesce(F.arrays_overlap("who_a", "who_b"), F.lit(False)) | F.coalesce("near", F.lit(False))
    twin = F.coalesce(similarity.shape_overlap(F.col("acts_a"), F.col("acts_b")) > policy.max_overlap, F.lit(False))
    both = both.filter(known & ~twin)
    if policy.cross_source_only:
        both = both.filter(~F.arrays_overlap("sys_a", "sys_b"))
    return similarity.greedy_matches(both.select("a", "b", "score"))


def induce(shaped: Shaped, policy: Policy | None = None) -> Model:
    policy = policy or Policy()
    entities = materialise(shaped.entities.filter(~F.col("type").isin(*linking.SKIP_TYPES)))
    live = entities.select("entity_id")
    events = materialise(shaped.events.join(live, "entity_id", "left_semi"))
    observations = shaped.observations.join(live, "entity_id", "left_semi")
    records = events.select("entity_id").unionByName(observations.select("entity_id")).groupBy("entity_id").agg(F.count(F.lit(1)).alias("n"))
    built = linking.build_cases(entities, records, shaped.links)
    cases, members, loose = materialise(built.cases), materialise(built.members), materialise(built.loose)

    for _ in range(policy.max_rounds if policy.fuzzy else 0):
        with_records = loose.join(records, "entity_id", "left_semi")
        found = fuzzy_links(cases, with_records, members, entities, events, policy)
        found = materialise(found)
        if found.isEmpty():
            break
        ends = found.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        comp = connected_components(ends, found.select("a", "b"))
        # a pair is named by its declared case, the least id among several; two loose records make a case of their own
        comp = materialise(comp.groupBy("component").agg(F.coalesce(F.min(F.when(~F.col("node").startswith("loose:"), F.col("node"))), F.concat(F.lit("case:"), F.regexp_replace(F.min("node"), "^loose:", ""))).alias("into"), F.collect_list("node").alias("nodes")).select("into", F.explode("nodes").alias("node")))
        to = comp.select(F.col("node").alias("case_id"), "into")
        fresh = loose.withColumn("node", F.concat(F.lit("loose:"), "entity_id")).join(comp, "node").select(F.col("into").alias("case_id"), "entity_id")
        members = materialise(members.join(to, "case_id", "left").select(F.coalesce("into", "case_id").alias("case_id"), "entity_id").unionByName(fresh))
        loose = materialise(loose.join(fresh.select("entity_id"), "entity_id", "left_anti"))
        kept = cases.join(to, "case_id", "left").withColumn("touched", F.col("into").isNotNull()).filter("into is null or into = case_id")
        weak = F.when(F.col("touched"), F.least(F.col("tier"), F.lit(HEURISTIC))).otherwise(F.col("tier"))
        kept = kept.select("case_id", "anchor", "kind_hint", weak.alias("tier"), F.when(F.col("touched"), F.lit("no shared key; text overlap and proximity")).otherwise(F.col("rationale")).alias("rationale"))
        new = comp.select("into").distinct().join(cases.select(F.col("case_id").alias("into")), "into", "left_anti")
        made = new.select(F.col("into").alias("case_id"), F.regexp_replace("into", "^case:", "").alias("anchor"), F.substring_index(F.regexp_replace("into", "^case:", ""), ":", 1).alias("kind_hint"), F.lit(HEURISTIC).alias("tier"), F.lit("no shared key; text overlap and proximity").alias("rationale"))
        cases = materialise(kept.unionByName(made))

    log = events.join(members, "entity_id").join(cases.select("case_id", "kind_hint", F.col("tier").alias("case_tier")), "case_id")
    if policy.split_sessions:
        first = log.groupBy("case_id", "entity_id").agg(F.min("ts").alias("ts"), F.max("case_tier").alias("tier"))
        weak = first.filter(F.col("tier") <= HEURISTIC)
        cut = T.split_quiet(weak, ["case_id"], "ts", "entity_id", policy.proximity_days).select("case_id", "entity_id", "session")
        members = members.join(cut, ["case_id", "entity_id"], "left").select(F.when(F.coalesce("session", F.lit(1)) > 1, F.concat_ws("#", "case_id", F.col("session").cast("string"))).otherwise(F.col("case_id")).alias("case_id"), "entity_id", F.col("case_id").alias("base"))
        members = materialise(members)
        cases = materialise(cases.withColumnRenamed("case_id", "base").join(members.select("base", "case_id").distinct(), "base").drop("base"))
        members = members.drop("base")
        log = events.join(members, "entity_id").join(cases.select("case_id", "kind_hint", F.col("tier").alias("case_tier")), "case_id")
    table = F.create_map(*[F.lit(x) for kv in policy.relabel.items() for x in kv]) if policy.relabel else None
    log = materialise(log.withColumn("activity", F.coalesce(table[F.col("action")], F.col("action")) if table is not None else F.col("action")))

    people = shaped.entities.filter("type = 'person'").select(F.col("entity_id").alias("actor"), F.coalesce(F.col("attrs")["is_bot"] == "true", F.lit(False)).alias("is_bot")).groupBy("actor").agg(F.max("is_bot").alias("is_bot"))
    acted = log.join(people, "actor", "left").withColumn("is_bot", F.coalesce("is_bot", F.lit(False)))
    auto = acted.groupBy("case_id").agg(K.automated(F.col("actor"), F.col("is_bot")).alias("automated"))
    traced = T.build_traces(log.select("case_id", "activity", "ts", "seq", "actor"))
    runs = cases.join(auto, "case_id", "left").join(traced, "case_id", "left").withColumn("automated", F.coalesce("automated", F.lit(False))).withColumn("steps", F.coalesce("steps", F.expr("cast(array() as " + traced.schema["steps"].dataType.simpleString() + ")"))).withColumn("order_status", F.coalesce("order_status", F.lit("unknown")))
    sized = K.number(K.clusters(runs, ["automated", "kind_hint"]), ["kind_hint", "automated"])
    named = K.reject(sized).withColumn("kind", F.concat(F.lit("kind_"), F.col("kind").cast("string")))
    runs = runs.join(F.broadcast(named.select("automated", "kind_hint", "kind", "rejected")), ["automated", "kind_hint"]).withColumn("key", F.col("case_id"))  # one row a kind
    runs = runs.withColumn("trace", T.activities(T.collapse("steps"))).withColumn("folded", T.fold("steps")).withColumn("shape", T.shape("trace"))
    runs = materialise(runs)
    measured = runs.filter(F.size("steps") > 0).select("kind", "key", "rejected", F.col("folded").alias("steps"), T.activities("folded").alias("trace"), "shape")
    expected = P.canonical_path(measured.filter("not rejected"), ["kind"])
    gone = P.missing_steps(measured.filter("not rejected"), expected, ["kind"]).select(F.col("key").alias("case_id"), F.lit("missing_expected_step").alias("kind"), F.col("missing").alias("detail"))
    loud = log.join(runs.filter("rejected").select("case_id"), "case_id", "left_anti")
    settled = G.reconciliation(loud, policy.terminal, policy.corroborating).withColumn("detail", F.lit(policy.terminal))
    dangling = built.unresolved.join(members.select(F.col("entity_id").alias("src"), "case_id"), "src", "left").select("case_id", F.lit("reconciliation").alias("kind"), F.col("target").alias("detail"))
    gaps = gone.unionByName(settled).unionByName(dangling)
    for detect in policy.detectors:
        gaps = gaps.unionByName(detect(log), allowMissingColumns=True)
    evs = events.select("entity_id", F.col("event_id").alias("record"), "seq").unionByName(observations.select("entity_id", F.col("obs_id").alias("record"), "seq"))
    unkeyed = shaped.observations.join(shaped.entities.filter("type = 'orphan_row'").select("entity_id"), "entity_id", "left_semi").select("entity_id", F.col("obs_id").alias("record"), "seq", F.lit("orphan_row").alias("type"))
    orphaned = evs.join(entities.select("entity_id", "type"), "entity_id").unionByName(unkeyed)
    steps = log.groupBy("activity").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("actor").alias("actors"))
    merges = log.groupBy("entity_id", "activity", "ts").agg(F.countDistinct("actor").alias("actors")).filter("actors >= 2")
    canon = P.usual_shape(measured, ["kind"])
    return Model(
        cases.withColumn("confidence", tier_label(F.col("tier"))), members, log, runs,
        named, T.variants(runs.filter(F.size("trace") > 0), ["kind"]), T.dfg_nodes(runs, ["kind"]), T.dfg_edges(runs, ["kind"]), steps, merges, gaps,
        G.orphans(orphaned, members), P.wait_times(measured, ["kind"]), P.cycle_time(measured, ["kind"]), P.headline(measured, canon, ["kind"]),
    )


def run_summary(model: Model) -> DataFrame:
    """(table, n): what the model holds, for a one-line report."""
    parts = [df.agg(F.lit(name).alias("table"), F.count(F.lit(1)).alias("n")) for name, df in model.tables().items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out

