"""What a reader of the model looks at: run rows, routes, the runs behind a figure, tiles, members, decisions, wording."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The words for what a run is about, by the type of its anchor. Results are read by them.
NOUNS = {
    "invoice": ("invoice", "invoices"), "grant": ("grant", "grants"), "payment": ("payment", "payments"), "pr": ("pull request", "pull requests"),
    "issue": ("issue", "issues"), "commit": ("change", "changes"), "release": ("release", "releases"), "case": ("case", "cases"),
    "integration": ("integration", "integrations"), "ticket": ("ticket", "tickets"), "email_thread": ("email thread", "email threads"), "email": ("email", "emails"),
}
DOMINANT = 0.8


def noun(type_: Column, many: bool) -> Column:
    table = F.create_map(*[F.lit(x) for k, v in NOUNS.items() for x in (k, v[many])])
    return F.coalesce(F.try_element_at(table, type_), F.concat(type_, F.lit("s")) if many else type_)


def dominant_noun(anchors: DataFrame, by: list[str], type_: str = "type") -> DataFrame:
    """(by, item, items): the word for a run where one type has 80 % of them and more, else run and runs."""
    n = anchors.groupBy(*by, type_).agg(F.count(F.lit(1)).alias("n"))
    top = n.groupBy(*by).agg(F.max(F.struct("n", F.col(type_).alias("t"))).alias("m"), F.sum("n").alias("all"), F.count(F.lit(1)).alias("types"))
    one = (F.col("types") <= 1) | (F.col("m.n") / F.col("all") >= DOMINANT)
    return top.select(*by, F.when(one, noun(F.col("m.t"), False)).otherwise("run").alias("item"), F.when(one, noun(F.col("m.t"), True)).otherwise("runs").alias("items"))


def run_rows(runs: DataFrame, gaps: DataFrame, kinds: DataFrame) -> DataFrame:
    """Runs (case_id, kind, label) with their gaps' kinds in order and their kind's name and flag; ordered with the usual
    first, then by id. A run of no kind is ungrouped."""
    g = gaps.groupBy("case_id").agg(F.array_join(F.array_sort(F.collect_set("gap")), ",").alias("gaps"), F.count(F.lit(1)).alias("n_gaps"))
    both = runs.join(g, "case_id", "left").join(kinds.select("kind", F.col("name").alias("__name"), "rejected"), "kind", "left")
    out = both.select("case_id", F.coalesce("__name", F.lit("Ungrouped")).alias("kind"), "label", F.coalesce("gaps", F.lit("")).alias("gaps"), F.coalesce("n_gaps", F.lit(0)).cast("bigint").alias("n_gaps"), F.coalesce("rejected", F.lit(False)).alias("attention"))
    return out.orderBy(F.when(F.col("label") == "usual", 0).otherwise(1), "case_id")


def on_route(runs: DataFrame, label: str | None) -> DataFrame:
    """Runs of one path label; all of them without one."""
    return runs if label is None else runs.filter(F.col("label") == label)


def behind(runs: DataFrame, figures: DataFrame, about: str) -> DataFrame:
    """Runs behind one figure. ``figures``: (about, runs: array of case ids)."""
    keys = figures.filter(F.col("about") == about).select(F.explode("runs").alias("case_id")).distinct()
    return runs.join(keys, "case_id", "left_semi")


def tiles(figures: DataFrame) -> DataFrame:
    """(tile, text) of (tile, n, of): a share in whole percent and its counts; a dash where there is nothing to share."""
    share = F.bround(F.col("n") * 100 / F.col("of")).cast("bigint").cast("string")
    return figures.select("tile", F.when(F.col("of") > 0, F.concat(share, F.lit(" % ("), F.col("n").cast("string"), F.lit(" of "), F.col("of").cast("string"), F.lit(")"))).otherwise("–").alias("text"))


def members(persons: DataFrame) -> DataFrame:
    """Persons (id, name, is_bot, count), those who did most first."""
    return persons.select("id", "name", F.coalesce("is_bot", F.lit(False)).alias("is_bot"), F.coalesce("count", F.lit(0)).alias("count")).orderBy(F.desc("count"), "id")


def decision_for(rows: DataFrame, decisions: DataFrame) -> DataFrame:
    """``rows`` (kind, about, ...) with the last decision on them (answer, confidence, outcome), null where none was made."""
    last = decisions.groupBy("kind", "about").agg(F.max_by(F.struct("answer", "confidence", "outcome"), "seq").alias("__d"))
    return rows.join(last, ["kind", "about"], "left").select(*rows.columns, "__d.answer", "__d.confidence", "__d.outcome")


def kind_rationale(n_cases: Column, automated: Column, hint: Column, actions: Column, types: Column) -> Column:
    """One sentence that says what a cluster is and that nobody has named it."""
    or_dash = lambda c: F.coalesce(F.nullif(F.array_join(c, ", "), F.lit("")), F.lit("—"))
    return F.concat(n_cases.cast("string"), F.lit(" runs, "), F.when(automated, "automated").otherwise("human-driven"), F.lit(", anchor: "), hint, F.lit(", mostly: "), or_dash(actions), F.lit(", touches: "), or_dash(F.array_sort(types)), F.lit(". A cluster of the data that nobody has named."))


def join_rationale(strong: Column, content: Column, most: int = 4) -> Column:
    """The words that joined two runs: identifiers before words, ``most`` of each."""
    quoted = lambda c, name: F.when(F.size(c) > 0, F.concat(F.lit(name + " "), F.array_join(F.transform(F.slice(c, 1, most), lambda t: F.concat(F.lit("'"), t, F.lit("'"))), ", ")))
    return F.coalesce(F.nullif(F.concat_ws(" and ", quoted(strong, "identifiers"), quoted(content, "words")), F.lit("")), F.lit("nothing"))


def line_at(text: Column, offset: Column) -> Column:
    """The line of ``text`` that holds the character at ``offset``, counted from 0, trimmed."""
    before = F.substring_index(F.substring(text, F.lit(1), offset), "\n", -1)
    after = F.substring_index(F.substring(text, offset + 1, F.length(text)), "\n", 1)
    return F.trim(F.concat(before, after))


def object_family(path: Column) -> Column:
    """What a file of a repository is: code, docs, deps/config or other, the first that fits."""
    code = path.startswith("src/") | path.startswith("tests/") | path.contains("/tests/")
    docs = path.startswith("docs/") | path.rlike(r"\.(md|rst)$")
    deps = path.contains("requirements") | path.rlike(r"\.(txt|cfg|toml|ini|lock)$")
    return F.when(code, "code").when(docs, "docs").when(deps, "deps/config").otherwise("other")


def commit_subkind(commits: DataFrame) -> DataFrame:
    """(case_id, subkind) of (case_id, hint, author, files): what kind of change a run of commits is."""
    blob = F.lower(F.coalesce("author", F.lit("")))
    dep, ci = blob.rlike("dependabot|renovate"), blob.rlike("pre-commit-ci|github-actions")
    families = F.transform(F.coalesce("files", F.array().cast("array<string>")), object_family)
    g = commits.groupBy("case_id").agg(
        F.max("hint").alias("hint"), F.count_if(dep).alias("dep"), F.count_if(ci & ~dep).alias("ci"), F.count(F.lit(1)).alias("n"),
        F.sum(F.size(families)).alias("files"), F.sum(F.size(F.filter(families, lambda x: x == "docs"))).alias("docs"),
    )
    sub = F.when(F.col("hint") == "notes", "release_notes").when(F.col("hint").isin("release", "integration"), "release_and_backport").when(F.col("dep") * 2 > F.col("n"), "dependency_bumps").when(F.col("ci") * 2 > F.col("n"), "ci_maintenance").when((F.col("files") > 0) & (F.col("docs") == F.col("files")), "documentation").otherwise("code_contribution")
    return g.select("case_id", sub.alias("subkind"))


def capped(files: Column, snippet: Column, most_files: int = 50, most_chars: int = 200) -> tuple[Column, Column]:
    """A feature's files and snippet, as many as a reader takes in."""
    return F.slice(files, 1, most_files), F.left(snippet, F.lit(most_chars))


def profile_of(events: DataFrame, entities: DataFrame, first: int = 100) -> DataFrame:
    """One row (profile): git if any of the first events or entities (source, seq) comes from a git source, else generic."""
    heads = [df.orderBy("seq").limit(first).select("source") for df in (events, entities)]
    return heads[0].unionByName(heads[1]).agg(F.when(F.coalesce(F.bool_or(F.col("source").startswith("git:")), F.lit(False)), "git").otherwise("generic").alias("profile"))


def anchor_attrs(node: Column, type_: Column, invented: Column, number: Column) -> Column:
    """struct(type, key, number) of an anchor: its own type, else that of the link that made it, else what its id says."""
    kind = F.coalesce(type_, invented, F.substring_index(node, ":", 1))
    at = F.instr(node, ":")
    return F.struct(kind.alias("type"), F.when(at > 0, F.substring(node, at + 1, F.length(node))).otherwise(node).alias("key"), number.alias("number"))


def bridges(joins: DataFrame) -> DataFrame:
    """(island, tier, rationale): the weakest inferred join (a, b, tier, rationale, seq) at each island, the first of equals."""
    ends = joins.select(F.explode(F.array("a", "b")).alias("island"), "tier", "rationale", "seq")
    return ends.groupBy("island").agg(F.min_by(F.struct("tier", "rationale"), F.struct("tier", "seq")).alias("m")).select("island", "m.tier", "m.rationale")


def link_scores(records: DataFrame, weakest: DataFrame) -> DataFrame:
    """``records`` (entity_id, anchor_id, own, attach, case_tier, island, anchor_island) with tier: how sure the record's place
    in its case is.

    An anchor's own claim counts before the link that attached it, a member's attachment before its own claim, and the
    case's confidence where there is neither. What crossed an inferred join is no surer than the join.
    """
    w = lambda c, out: weakest.select(F.col("island").alias(c), F.col("tier").alias(out))
    both = records.join(w("island", "__m"), "island", "left").join(w("anchor_island", "__a"), "anchor_island", "left")
    own = F.when(F.col("entity_id") == F.col("anchor_id"), F.coalesce("own", "attach", "case_tier")).otherwise(F.coalesce("attach", "own", "case_tier"))
    crossed = F.when((F.col("entity_id") != F.col("anchor_id")) & (F.col("island") != F.col("anchor_island")), F.coalesce("__m", "__a"))
    return both.select(*records.columns, F.least(own, crossed).alias("tier"))
