"""Operators on small hand-made rows with known answers, and invariants."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from caseloom.model import conform, shaped, tier_label, weakest
from caseloom.operators import evidence as E
from caseloom.operators import gaps as G
from caseloom.operators import graph, kinds, linking
from caseloom.operators import performance as P
from caseloom.operators import similarity as S
from caseloom.operators import topics
from caseloom.operators import traces as T
from caseloom.plans import writers
from caseloom.plans.induce import Policy, induce, run_summary
from caseloom.sources import tracker
from caseloom.streaming import incremental


def day(n, hour=0):
    return dt.datetime(2024, 1, 1, hour) + dt.timedelta(days=n)


def log_of(spark, rows):
    return spark.createDataFrame([(c, a, t, i, "p") for i, (c, a, t) in enumerate(rows)], "case_id string, activity string, ts timestamp, seq long, actor string")


def runs_of(spark, traces, kind="k"):
    """traces: list of [(step, day or None)]."""
    rows = [(f"r{i:02d}", a, None if d is None else day(d)) for i, t in enumerate(traces) for a, d in t]
    # ordered as given: undated steps keep their place through seq when every step of the run is undated
    t = T.build_traces(log_of(spark, rows)).select(F.lit(kind).alias("kind"), F.col("case_id").alias("key"), T.fold("steps").alias("steps"))
    t = t.withColumn("trace", T.activities("steps"))
    return t.withColumn("shape", T.shape("trace"))


@pytest.mark.parametrize("offsets, sizes", [([0, 1, 2, 5, 6], [5]), ([0, 1, 2, 400, 401], [3, 2]), ([0, 163], [1, 1]), ([0, 3], [2]), ([0, 257, 263, 533], [1, 2, 1]), ([0, 25, 50, 75, 100], [5])])
def test_quiet_sessions(spark, offsets, sizes):
    df = spark.createDataFrame([("c", day(o), i) for i, o in enumerate(offsets)], "case_id string, ts timestamp, seq long")
    got = T.split_quiet(df, ["case_id"], "ts", "seq").groupBy("session").count().orderBy("session").collect()
    assert [r["count"] for r in got] == sizes


def test_undated_case_is_not_split(spark):
    df = spark.createDataFrame([("c", day(0), 0), ("c", None, 1), ("c", day(400), 2)], "case_id string, ts timestamp, seq long")
    assert T.split_quiet(df, ["case_id"], "ts", "seq").select("session").distinct().count() == 1


def test_traces(spark):
    rows = [("a", "merged", day(1)), ("a", "authored", day(1)), ("a", "x", None), ("a", "authored", day(0)), ("b", "y", None)]
    t = {r.case_id: r for r in T.build_traces(log_of(spark, rows)).withColumn("t", T.text(T.activities(T.collapse("steps")))).collect()}
    assert t["a"].t == "authored>authored>merged>x" and t["a"].order_status == "partial" and t["b"].order_status == "unknown"
    shapes = spark.createDataFrame([(x.split(),) for x in ("A B C", "A B C B", "A B B C", "A C", "A C B")], "t array<string>").select(T.text(T.shape("t")).alias("s")).collect()
    assert [r.s for r in shapes] == ["A>B>C"] * 3 + ["A>C", "A>C>B"]


def test_variants_and_graph(spark):
    t = spark.createDataFrame([("k", f"c{i}", x.split(">")) for i, x in enumerate(["A>B", "A>B", "A>B>A", "A>C", "A>C", "A>reverted", "D"])], "kind string, case_id string, trace array<string>")
    v = {r.shape: (r.frequency, r.role, r.exact_traces) for r in T.variants(t, ["kind"]).collect()}
    assert v == {"A>B": (3, "common", 2), "A>C": (2, "exception", 1), "A>reverted": (1, "exception", 1), "D": (1, "one-off", 1)}
    e = {(r.from_activity, r.to_activity): r.n for r in T.dfg_edges(t, ["kind"]).collect()}
    assert e[("__start__", "A")] == 6 and e[("A", "B")] == 3 and e[("B", "A")] == 1 and e[("B", "__end__")] == 2
    assert T.variants(t.limit(0), ["kind"]).count() == 0 and T.dfg_edges(t.limit(0), ["kind"]).count() == 0


def test_waits(spark):
    runs = runs_of(spark, [[("raised", 1), ("approved", 2), ("paid", 12)]] * 6)
    w = {(r.from_step, r.to_step): r for r in P.wait_times(runs, ["kind"]).collect()}
    assert w["approved", "paid"].median_s == 10 * 86400 and w["approved", "paid"].share_pct == 91
    c = P.cycle_time(runs, ["kind"]).first()
    assert (c.median_s, c.slow_s, c.measured, c.of, c.coverage_pct) == (11 * 86400, 11 * 86400, 6, 6, 100)
    assert P.headline(runs, P.usual_shape(runs, ["kind"]), ["kind"]).first().headline == "bottleneck"
    few = runs_of(spark, [[("a", 1), ("b", 2)]] * 3)
    assert P.headline(few, P.usual_shape(few, ["kind"]), ["kind"]).first().headline == "insufficient"


def test_waits_rank_by_impact(spark):
    runs = runs_of(spark, [[("raised", 0), ("approved", 10), ("paid", 11)]] * 40 + [[("raised", 0), ("queried", 30), ("paid", 60)]] * 5)
    top = P.wait_times(runs, ["kind"]).orderBy(F.desc("total_s")).first()
    assert (top.from_step, top.to_step, top.measured) == ("raised", "approved", 40)


def test_route_and_rework(spark):
    runs = runs_of(spark, [[("a", 0), ("b", 1), ("c", 2)]] * 4 + [[("a", 0), ("c", 1)], [("a", 0), ("b", 1)], [("a", 0), ("b", 1), ("a", 2), ("c", 3)]])
    canon = P.usual_shape(runs, ["kind"])
    r = P.route(runs, canon, ["kind"]).first()
    assert (r.off_route, r.not_completed, r.final_step, r.of) == (2, 1, "c", 7)
    assert {(x.step, x.n) for x in P.skipped(runs, canon, ["kind"]).collect()} == {("b", 1), ("c", 1)}
    assert P.rework(runs, ["kind"]).first().rework == 1 and P.redone(runs, ["kind"]).first().step == "a"


def test_canonical_path(spark):
    path = lambda ts: [r.step for r in P.canonical_path(runs_of(spark, [[(s, i) for i, s in enumerate(t)] for t in ts]), ["kind"]).orderBy("place").collect()]
    assert path(["SO", "SRO", "SROH"]) == ["S", "R", "O"]
    assert path(["AB"] * 5 + ["AZB"]) == ["A", "B"]
    assert path(["AB", "CD", "EF", "GH", "IJ", "KL"]) == []
    runs = runs_of(spark, [[(s, i) for i, s in enumerate(t)] for t in ("SO", "SRO", "SROH")])
    gone = P.missing_steps(runs, P.canonical_path(runs, ["kind"]), ["kind"]).collect()
    assert [(r.key, r.missing, r.reached) for r in gone] == [("r00", "R", "O")]


@pytest.mark.parametrize("s, precise, want", [(0, False, "same day"), (10800, True, "3 hours"), (129600, True, "1.5 days"), (15 * 86400, False, "15 days"), (86400, False, "1 day"), (60, True, "under an hour")])
def test_durations(spark, s, precise, want):
    assert spark.range(1).select(P.human_duration(F.lit(float(s)), F.lit(precise)).alias("x")).first().x == want


def test_components(spark):
    nodes = spark.createDataFrame([(f"n{i:03d}",) for i in range(60)], "node string")
    edges = spark.createDataFrame([(f"n{i:03d}", f"n{i + 1:03d}") for i in range(40)] + [("n050", "n055"), ("n055", "n050"), ("n059", "n059"), (None, "n001")], "a string, b string")
    c = {r.node: r.component for r in graph.connected_components(nodes, edges).collect()}
    assert all(c[f"n{i:03d}"] == "n000" for i in range(41)) and c["n055"] == "n050" and c["n059"] == "n059" and len(c) == 60
    assert graph.connected_components(nodes.limit(0), edges.limit(0)).count() == 0


def test_stars_need_no_rounds_and_links_no_components(spark, monkeypatch):
    def never(*a, **k):
        raise AssertionError("not needed")

    monkeypatch.setattr(graph, "_rounds", never, raising=False)
    edges = spark.createDataFrame([("h", "b"), ("c", "h"), ("h", "d"), ("y", "x")], "a string, b string")
    nodes = spark.createDataFrame([(n,) for n in "bcdhxyz"], "node string")
    assert {r.node: r.component for r in graph.connected_components(nodes, edges).collect()} == {**dict.fromkeys("bcdh", "b"), "x": "x", "y": "x", "z": "z"}
    monkeypatch.setattr(linking, "connected_components", never)
    ents = spark.createDataFrame([("l:1", "line")], "entity_id string, type string")
    none = F.lit(None).cast("string")
    links = ents.select(F.col("entity_id").alias("src"), F.lit("o:1").alias("target"), F.lit("fk").alias("method"), F.lit(3).alias("tier"), none.alias("rationale"), none.alias("materialise"), F.lit(False).alias("virtual"), F.lit(True).alias("anchors"), F.lit(0).alias("anchor_rank"), F.lit(False).alias("fallback"), F.lit(1).cast("long").alias("decl_seq"))
    built = linking.build_cases(ents, ents.select("entity_id", F.lit(1).cast("long").alias("n")), links)
    assert [tuple(r) for r in built.unresolved.collect()] == [("l:1", "o:1", "fk")]


def test_matching_equals_greedy(spark):
    import random

    rng = random.Random(3)
    pairs = sorted({(f"a{rng.randrange(30)}", f"b{rng.randrange(30)}") for _ in range(200)})
    scored = [(a, b, float(rng.randrange(8))) for a, b in pairs]
    want, used = set(), set()
    for a, b, s in sorted(scored, key=lambda t: (-t[2], t[0], t[1])):
        if a not in used and b not in used:
            want.add((a, b))
            used |= {a, b}
    got = S.greedy_matches(spark.createDataFrame(scored, "a string, b string, score double"))
    assert {(r.a, r.b) for r in got.collect()} == want


def one_by_one(scored):
    want, used = set(), set()
    for a, b, s in sorted(scored, key=lambda t: (-t[2], t[0], t[1])):
        if a not in used and b not in used:
            want.add((a, b, s))
            used |= {a, b}
    return want


@pytest.mark.parametrize("few", [0, 100_000])
def test_matching_leaves_no_pair_of_a_large_tie_group(spark, few):
    """200 copies and an odd one near them, 130 x 150 ends at one score, and random ties between a and b and within a."""
    import random

    rng = random.Random(4)
    scored = [(f"c{i:03d}", f"c{j:03d}", 1.0) for j in range(200) for i in range(j)] + [(f"c{i:03d}", "odd", 0.9) for i in range(200)]
    scored += [(f"l{i:03d}", f"r{j:03d}", -0.5) for i in range(130) for j in range(150)]
    scored += [(a, b, float(rng.randrange(4))) for a, b in sorted({(f"x{rng.randrange(40)}", f"{rng.choice('wxy')}{rng.randrange(40)}") for _ in range(300)}) if a != b]
    got = S.greedy_matches(spark.createDataFrame(scored, "a string, b string, score double"), few=few)
    assert {(r.a, r.b, r.score) for r in got.collect()} == one_by_one(scored)


@pytest.mark.parametrize("places,odd", [(1, False), (40, False), (100_000, False), (40, True)])
def test_nearest_matching_equals_greedy_over_all_pairs(spark, places, odd):
    """Ties at one value, ties of distance, rows without a value, parts of one side only; a key twice and thirds of a cent."""
    import random

    rng = random.Random(places)
    at = lambda: None if rng.random() < 0.1 else rng.randrange(-places, places) / 100 + odd * rng.randrange(3) / 300
    left = [(f"s{i:03d}", rng.randrange(3), at()) for i in range(60)] + [("s999", 7, 1.0), (None, 1, 1.0), ("sx", None, 1.0)] + [("s001", 2, 0.5)] * odd
    right = [(f"t{i:03d}", rng.randrange(3), at()) for i in range(90)] + [("t999", 8, 1.0)]
    scored = [(a, b, None if x is None or y is None else round(-abs(x - y), 2)) for a, p, x in left for b, q, y in right if a is not None and p == q]
    want, used = set(), set()
    for a, b, score in sorted(scored, key=lambda t: (t[2] is None, -(t[2] or 0.0), t[0], t[1])):
        if a not in used and b not in used:
            want.add((a, b, score))
            used |= {a, b}
    got = S.greedy_nearest(spark.createDataFrame(left, "a string, part int, at double"), spark.createDataFrame(right, "b string, part int, at double")).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_nearest_matching_forms_no_pairs(spark):
    """30,000 and 40,000 rows of one part have 1.2 billion pairs."""
    rows = lambda c, n: spark.range(n).select(F.format_string(c + "%09d", "id").alias(c), F.lit(1).alias("part"), ((F.col("id") * 7919 % 100_003) / 100).alias("at"))
    got = S.greedy_nearest(rows("a", 30_000), rows("b", 40_000))
    assert got.agg(F.count("a"), F.countDistinct("a"), F.countDistinct("b"), F.min("score") == 0.0).first()[:] == (30_000, 30_000, 30_000, True)


def test_two_sides_equal_all_pairs(spark):
    """Blocks of two rows, ids on both sides and twice, strong tokens, empty texts: as all pairs scored one by one."""
    import math
    import random

    rng = random.Random(5)
    text = lambda: " ".join(rng.choices([f"word{chr(97 + i)}" for i in range(12)] + ["inv-2024-01", "x@y.org", "4711"], k=rng.randrange(7)))
    left, right = [(str(i % 9), text()) for i in range(10)], [(str(i % 28), text()) for i in range(30)] + [("n", None)]
    d = lambda rows: spark.createDataFrame(rows, "id string, text string")
    got = S._two_sides(d(left), d(right), 0.3, block=2).collect()
    sides: list = [{}, {}]
    for k, rows in enumerate((left, right)):
        for i, words in rows:
            sides[k].setdefault(i, set()).update(t for w in (words or "").split() for t in (w, {"inv-2024-01": "inv", "x@y.org": "org"}.get(w, w)))
    n = len(left) + len(right)
    idf = {t: math.log(n / sum(t in w for side in sides for w in side.values())) for side in sides for w in side.values() for t in w}
    want = {}
    for a, x in sides[0].items():
        for b, y in sides[1].items():
            c, s = ([t for t in x & y if t.isalpha() == k] for k in (True, False))
            m = sum(idf[t] for w in (x, y) for t in w if t.isalpha())
            dice = 2 * sum(idf[t] for t in c) / m if m else 0.0
            score = min(1.0, dice + (1 - dice) * (1 - math.exp(-sum(idf[t] for t in s) / 1.5)))
            if score >= 0.3 and c + s:
                want[a, b] = (round(score, 9), len(c), len(s))
    assert {(r.a, r.b): (round(r.score, 9), r.n_content, r.n_strong) for r in got} == want and len(got) == len(want)
    assert S.similar_pairs(d(left).limit(0), d(right)).count() == 0


def test_products_hold_and_yield_bounded_parts():
    """Two blocks of 3,000 equal vectors: nine million pairs come in parts of at most a million, or the best ten thousand and ties."""
    import numpy as np
    import pyarrow as pa

    v = [[1.0, float(i % 7)] for i in range(2999)] + [[0.0, 0.0]]
    ids = pa.array([list(range(3000))], pa.list_(pa.int64())), pa.array([list(range(3000, 6000))], pa.list_(pa.int64()))
    block = pa.array([v], pa.list_(pa.list_(pa.float32())))
    batch = pa.RecordBatch.from_arrays([pa.array([0]), pa.array([1]), ids[0], block, ids[1], block], names=["p", "j", "da", "va", "db", "vb"])
    parts = list(S._products(0.0)(iter([batch])))
    assert sum(b.num_rows for b in parts) == 2999 * 2999 and max(b.num_rows for b in parts) <= 2**20
    m = np.array(v[:2999]) / np.linalg.norm(v[:2999], axis=1)[:, None]
    top = np.concatenate([b.column(2).to_numpy() for b in S._products(0.0, 10)(iter([batch]))])
    assert 10 <= len(top) < 2999 * 2999 / 3 and top.max() <= 1 + 1e-9 and np.sort(top)[-10] >= (m @ m.T).max() - 1e-9


def test_similar(spark):
    rows = [("1", "Acme Corp March retainer handover"), ("2", "Acme Corporation March retainer"), ("3", "Weekly lunch menu options"), ("4", "Server outage postmortem"), ("5", None)]
    d = spark.createDataFrame(rows, "id string, text string")
    got = S.similar_pairs(d, min_score=0.3, prefix=True).collect()
    assert [(r.a, r.b) for r in got] == [("1", "2")]
    plain = S.similar_pairs(d, min_score=0.3).first()
    assert got[0].score > plain.score  # corp ~ corporation adds to it
    ids = spark.createDataFrame([("1", "invoice INV-2024-0312 overdue"), ("2", "please settle INV-2024-0312"), ("3", "nothing")], "id string, text string")
    assert S.similar_pairs(ids).first().shared_strong == "inv-2024-0312"
    assert S.similar_pairs(d.limit(0)).count() == 0


def test_prefix_pairs_equal_all_pairs(spark):
    """Pairs joined by prefix words alone, one word with several, common words, and random texts."""
    import math
    import random

    rng = random.Random(6)
    vocab = "corp corporate corporation retain retainer retainers audit auditor auditing auditors ledger ledgers inv invoice invoices zebra quartz marble".split()
    texts = ["corp retain", "corporation retainer", "audit auditor", "auditors quartz", "common zebra", "common marble"] + [" ".join(rng.choices(vocab, k=rng.randint(1, 5))) + " common" * (i % 2) for i in range(50)]
    rows = [(f"{i:03d}", t) for i, t in enumerate(texts)]
    words = {i: set(t.split()) for i, t in rows}
    idf = {w: math.log(len(rows) / sum(w in x for x in words.values())) for x in words.values() for w in x}

    def score(a, b):
        both, used, mass, n = a & b, set(), sum(idf[w] for w in a & b), len(a & b)
        for p in sorted(a - both, key=lambda w: (len(w), w), reverse=True):
            fits = [q for q in b - both - used if min(len(p), len(q)) >= 4 and (p.startswith(q) or q.startswith(p))]
            if fits:
                q = max(fits, key=lambda w: (len(w), w))
                used.add(q)
                mass, n = mass + 0.6 * min(idf[p], idf[q]), n + 1
        return 2 * mass / (sum(idf[w] for w in a) + sum(idf[w] for w in b)), n

    want = {(a, b): score(words[a], words[b]) for a in words for b in words if a < b}
    want = {(*k, round(v, 6), n) for k, (v, n) in want.items() if v >= 0.2 and n}
    got = S.similar_pairs(spark.createDataFrame(rows, "id string, text string"), min_score=0.2, prefix=True).collect()
    assert {(r.a, r.b, round(r.score, 6), r.n_content) for r in got} == want and len(got) == len(want)
    assert any(r.a == "000" and r.b == "001" and r.shared_content == "retain~retainer,corp~corporation" for r in got)


def test_shortlist_compares_every_vector(spark):
    import numpy as np
    import pyarrow.parquet as pq

    from caseloom.plans import catalogue

    rng = np.random.RandomState(2)
    rows = [(i, [float(x) for x in rng.randn(6)]) for i in range(90)] + [(90, None), (91, [0.0] * 6), (92, [1.0] * 3), (93, [2.0] * 3), (None, [1.0] * 6)]

    def brute(rows, bar):
        unit = {i: np.array(v) / np.linalg.norm(v) for i, v in rows if i is not None and v is not None and any(v)}
        return {(a, b, round(float(unit[a] @ unit[b]), 6)) for a in unit for b in unit if a < b and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= bar}

    d = spark.createDataFrame(rows, "id long, v array<float>")
    want = brute([(r.id, r.v) for r in d.collect()], 0.55)
    for block in (16, 24, 50, 1000):  # 6, 4, 2 blocks and 1
        got = [(r.a, r.b, round(r.cosine, 6)) for r in S.cosine_pairs(d, 0.55, block=block).collect()]
        assert set(got) == want and len(got) == len(want) and (92, 93, 1.0) in want
    assert S.cosine_pairs(d.limit(0)).count() == 0
    sf = "/root/testdata/sf0.1"
    t = pq.read_table(f"{sf}/embeddings.parquet", columns=["vec_id", "embedding", "label"]).to_pydict()
    label = dict(zip(t["vec_id"], t["label"]))
    got = [(r.a, r.b) for r in S.cosine_pairs(spark.read.parquet(f"{sf}/embeddings.parquet").selectExpr("vec_id as id", "embedding as v"), 0.55).collect()]
    m = np.array(t["embedding"], float)
    m /= np.linalg.norm(m, axis=1)[:, None]
    want = {tuple(sorted((t["vec_id"][x], t["vec_id"][y]))) for x, y in zip(*np.nonzero(m @ m.T >= 0.55)) if x < y}
    assert set(got) == want and len(got) == len(want) and any(label[a] != label[b] for a, b in got)


def test_proximity(spark):
    log = spark.createDataFrame([("a", day(0)), ("a", day(100)), ("b", day(103, 12)), ("c", day(300)), ("d", None)], "case_id string, ts timestamp")
    pairs = spark.createDataFrame([("a", "b"), ("a", "c"), ("a", "d")], "a string, b string")
    assert [(r.a, r.b, r.min_days) for r in S.near_in_time(log, pairs, 30).collect()] == [("a", "b", 3)]


def test_topics(spark):
    vocab = {"x": "contract clause counterparty signature", "y": "server outage incident rollback", "z": "invoice payment remittance ledger"}
    rows = [(f"{k}{i}", f"{v} item{i}") for k, v in vocab.items() for i in range(10)] + [(f"odd{i}", f"word{'abcdefghij'[i]} alone{'klmnopqrst'[i]}") for i in range(10)]
    got = topics.refine(spark.createDataFrame(rows, "id string, text string"), len(rows)).collect()
    assert len(got) == 30 and len({(r.id[0], r.topic) for r in got}) == 3 and not any(r.id.startswith("odd") for r in got)
    assert topics.refine(spark.createDataFrame(rows, "id string, text string"), 100).count() == 0
    assert topics.refine(spark.createDataFrame(rows[:6], "id string, text string"), 6).count() == 0


def test_readings(spark):
    rows = [("P", "lone", f"c{i}") for i in range(3)] + [("P", "with", "d"), ("P", "other", "d"), ("P", "few", "e")]
    assert [(r.step, r.runs) for r in E.lonely_steps(spark.createDataFrame(rows, "process string, step string, case_id string")).collect()] == [("lone", 3)]
    votes = spark.createDataFrame([("c", "A", 1), ("c", "B", 0), ("c", "A", 2), ("d", "B", 1), ("d", "A", 0), ("e", None, 0)], "case_id string, process string, seq long")
    assert {(r.case_id, r.process) for r in E.process_vote(votes).collect()} == {("c", "A"), ("d", "A")}
    for n, want in ((150, 150), (0, 0), (300, 263)):
        assert E.even_stride(spark.range(263), "id", n).count() == want
    ids = [r.id for r in E.even_stride(spark.range(263), "id", 150).orderBy("id").collect()]
    assert ids == [i * 263 // 150 for i in range(150)]
    x = spark.range(1).select(E.worth_reading(F.lit(None).cast("double")).alias("a"), E.screen({"q": F.lit(None).cast("double"), "h": F.lit(0.1)}).alias("b"), E.geometric_mean(F.array(F.lit(0.25), F.lit(1.0))).alias("c"), E.scripted(F.lit("Please SIGN it"), [("sign", "Sign"), ("please", "Ask")]).alias("d")).first()
    assert x.a and x.b == "h" and abs(x.c - 0.5) < 1e-9 and x.d == "Sign"


def test_kinds(spark):
    rows = [("k", "big", 3, 40), ("k", "project", 3, 1), ("k", "noise", 2, 2), ("k", None, 1, 5)]
    cases = spark.createDataFrame([(k, p, s) for k, p, s, n in rows for _ in range(n)], "kind string, process string, steps long")
    assert {r.process: r.placed for r in kinds.split_by_process(cases).collect()} == {"big": "process", "project": "project", "noise": "parent"}
    a = spark.createDataFrame([("c", "bot", True), ("c", None, False), ("d", "bot", True), ("d", "ann", False), ("e", None, False)], "case_id string, actor string, is_bot boolean")
    assert {r.case_id: r.automated for r in a.groupBy("case_id").agg(kinds.automated(F.col("actor"), F.col("is_bot")).alias("automated")).collect()} == {"c": True, "d": False, "e": False}


def test_tiers(spark):
    r = spark.createDataFrame([(4, "a"), (2, "b"), (3, "c")], "tier int, why string").agg(weakest(F.col("tier"), F.col("why")).alias("w")).select("w.*", tier_label(F.col("w.tier")).alias("label")).first()
    assert (r.tier, r.rationale, r.label) == (2, "b", "heuristic")


def test_links(spark):
    from caseloom.model import ENTITIES, LINKS

    ents = conform(spark.createDataFrame([("i1", "invoice"), ("p1", "payment"), ("p2", "payment"), ("x", "note"), ("u", "person")], "entity_id string, type string"), ENTITIES)
    links = conform(spark.createDataFrame([("i1", "i1", "row-identity", 4, True, 5, 0, None), ("p1", "i1", "foreign-key", 3, True, 0, 1, None), ("p2", "i9", "foreign-key", 3, True, 0, 2, None), ("x", "pr:7", "mention", 2, True, 1, 3, "pr")], "src string, target string, method string, tier int, anchors boolean, anchor_rank int, decl_seq long, materialise string"), LINKS).fillna(False, ["virtual", "fallback"])
    c = linking.build_cases(ents, ents.select("entity_id", F.lit(1).cast("long").alias("n")), links)
    assert {(r.case_id, r.kind_hint, r.tier) for r in c.cases.collect()} == {("case:i1", "invoice", 3), ("case:pr:7", "pr", 2)}
    assert {(r.case_id, r.entity_id) for r in c.members.collect()} == {("case:i1", "i1"), ("case:i1", "p1"), ("case:pr:7", "x")}
    assert [(r.src, r.target) for r in c.unresolved.collect()] == [("p2", "i9")] and [r.entity_id for r in c.loose.collect()] == ["p2"]


INVOICES = "inv,client,raised,approved,paid\n" + "".join(f"I-{i},Client {i},2024-01-0{i},2024-01-1{i},2024-01-2{i}\n" for i in range(1, 7)) + "I-7,Late,2024-01-05,,2024-02-01\n,Lost,2024-01-01,,\n"
PAYMENTS = "ref,inv,settled\n" + "".join(f"P-{i},I-{i},2024-01-2{i + 1}\n" for i in range(1, 6)) + "P-9,I-99,2024-03-01\n"


def test_induce_end_to_end(spark, tmp_path):
    (tmp_path / "i.csv").write_text(INVOICES)
    (tmp_path / "p.csv").write_text(PAYMENTS)
    a = tracker.shape(tracker.read_rows(spark, str(tmp_path / "i.csv")), tracker.TableSpec("table:i", "invoice", "inv", [tracker.StepColumn(c, c) for c in ("raised", "approved", "paid")], {}, ["client"], []))
    b = tracker.shape(tracker.read_rows(spark, str(tmp_path / "p.csv")), tracker.TableSpec("table:p", "payment", "ref", [tracker.StepColumn("settled", "settled")], {"inv": "invoice"}, [], []))
    m = induce(a.extend(b), Policy(fuzzy=False))
    gaps = {(r.case_id, r.kind, r.detail) for r in m.gaps.collect()}
    assert ("case:invoice:I-7", "missing_expected_step", "approved") in gaps and ("case:invoice:I-6", "reconciliation", "paid") in gaps
    assert any(k == "reconciliation" and d == "invoice:I-99" for _, k, d in gaps)
    assert {r.trace for r in m.runs.filter("case_id = 'case:invoice:I-1'").select(T.text("trace").alias("trace")).collect()} == {"raised>approved>paid>settled"}
    assert m.cases.filter("confidence = 'joined'").count() == 5
    assert [r.reason for r in m.orphans.filter("entity_id like 'orphan_row%'").collect()] == ["no identity key"]
    # nothing lost, nothing twice
    assert m.members.groupBy("entity_id").count().filter("count > 1").count() == 0
    assert m.runs.count() == m.cases.count() and run_summary(m).count() == 15
    writers.write_tables(m, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out/variants")).count() == m.variants.count()
    writers.write_json(m, str(tmp_path / "m.json"), ["table:i"])
    writers.write_page(m, str(tmp_path / "m.html"), ["table:i"])
    assert "Process model" in (tmp_path / "m.html").read_text() and "sheet" in (tmp_path / "m.json").read_text()


def test_fuzzy_joins_two_sources(spark):
    ents = spark.createDataFrame([("ticket:1", "tracker", "ticket", "Acme Corp March retainer handover", 0), ("mail:1", "email", "mail", "Acme Corporation March retainer", 1), ("ticket:2", "tracker", "ticket", "Weekly lunch menu options", 2), ("mail:2", "email", "mail", "Server outage postmortem", 3)], "entity_id string, source string, type string, text string, seq long")
    evs = spark.createDataFrame([("e1", "ticket:1", "opened", day(14), "p:a", 0), ("e2", "mail:1", "sent", day(19), "p:b", 1), ("e3", "ticket:2", "opened", day(20), "p:c", 2), ("e4", "mail:2", "sent", day(21), "p:d", 3)], "event_id string, entity_id string, action string, ts timestamp, actor string, seq long")
    links = spark.createDataFrame([("ticket:1", "ticket:1", "row-identity", 4, True, 5, 0, False, False), ("ticket:2", "ticket:2", "row-identity", 4, True, 5, 1, False, False)], "src string, target string, method string, tier int, anchors boolean, anchor_rank int, decl_seq long, virtual boolean, fallback boolean")
    m = induce(shaped(spark, ents, evs, None, links))
    got = {(r.case_id, r.entity_id) for r in m.members.collect()}
    assert got == {("case:ticket:1", "ticket:1"), ("case:ticket:1", "mail:1"), ("case:ticket:2", "ticket:2")}
    assert {r.case_id: r.confidence for r in m.cases.collect()} == {"case:ticket:1": "heuristic", "case:ticket:2": "direct"}
    assert [r.entity_id for r in m.orphans.collect()] == ["mail:2"]


def test_gap_detectors(spark):
    log = log_of(spark, [("a", "merged", day(1)), ("b", "reviewed", day(0)), ("b", "merged", day(1))])
    assert [r.case_id for r in G.off_system_review(log).collect()] == ["a"]
    assert G.reconciliation(log, "merged", "settled").count() == 0  # nothing settles anywhere: no gap


def test_streams(spark, tmp_path):
    rows = [(1, day(0, 1), "a"), (1, day(0, 2), "b"), (1, day(3), "a"), (2, day(9), "a")]
    spark.createDataFrame(rows, "user long, ts timestamp, act string").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("user long, ts timestamp, act string").parquet(str(tmp_path / "in"))
    q = incremental.sessions(stream, "user").writeStream.outputMode("append").format("memory").queryName("s").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted((r.user, r.n) for r in spark.table("s").collect()) == [(1, 1), (1, 2)]
    spark.createDataFrame([(["a", "b"],), (["a"],)], "trace array<string>").write.parquet(str(tmp_path / "t"))
    for _ in range(2):
        incremental.start_graph(spark.readStream.schema("trace array<string>").parquet(str(tmp_path / "t")), str(tmp_path / "g"), str(tmp_path / "cp")).awaitTermination(120)
    assert {(r.from_activity, r.to_activity): r.n for r in incremental.graph(spark, str(tmp_path / "g")).collect()}[("__start__", "a")] == 2
