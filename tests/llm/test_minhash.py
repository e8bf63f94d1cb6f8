import random

import numpy as np
import pyarrow.parquet as pq
import pytest

from caseloom.llm import minhash, registry
from caseloom.llm.common import NULL_ID


def sets(rows, k):
    out = []
    for d, text in rows:
        w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").split()
        out.append((d, frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()))
    return out


def brute(rows, k, percent=80):
    """Sorted (id, set size, component) with all pairs compared."""
    s = sets(rows, k)
    key = [NULL_ID if d is None else d for d, _ in s]
    comp = list(range(len(s)))

    def root(i):
        while comp[i] != i:
            i = comp[i]
        return i

    for i in range(len(s)):
        for j in range(i):
            a, b = s[i][1], s[j][1]
            both = len(a & b)
            if key[i] == key[j] and a and b or both and 100 * both >= percent * (len(a) + len(b) - both):
                comp[root(i)] = root(j)
    low = {}
    for i in range(len(s)):
        low[root(i)] = min(low.get(root(i), key[i]), key[i])
    return sorted((key[i], len(s[i][1]), low[root(i)]) for i in range(len(s)))


def found(docs, **how):
    return sorted((r["d"], r["n"], r["component"]) for r in minhash.near_duplicates(docs, **how).collect())


def edits(n, seed=1):
    """Groups of texts with a few words changed, around the threshold."""
    rng, rows = random.Random(seed), []
    for g in range(n):
        base = [f"w{rng.randint(0, 500)}" for _ in range(rng.randint(8, 120))]
        for c in range(rng.randint(1, 5)):
            w = list(base)
            for _ in range(rng.randint(0, 1 + len(w) // 15)):
                w[rng.randrange(len(w))] = f"e{rng.randint(0, 99)}"
            rows.append((g * 10 + c, " ".join(w)))
    return rows


def test_random_groups(make_docs):
    rows = edits(60)
    for k in (2, 5):
        assert found(make_docs(rows), k=k) == brute(rows, k)


def test_a_chain_whose_ends_are_unlike(make_docs):
    words = [f"w{i}" for i in range(300)]
    rows = [(i, " ".join(words[12 * i : 12 * i + 150])) for i in range(12)]
    assert found(make_docs(rows), k=2) == brute(rows, 2)
    assert {r[2] for r in brute(rows, 2)} == {0}


def test_odd_rows(make_docs, odd_rows):
    rows = [r[:2] for r in odd_rows]
    docs = make_docs(rows, clashing=True)
    assert found(docs, k=2) == brute(rows, 2)
    kept = minhash.drop_near_duplicates(docs, k=5)
    assert kept.columns == docs.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert len(ids) == len(set(ids)) and {1, 2, 3, 4, 10, 11, -3, None} <= set(ids)


def test_empty_table(make_docs):
    assert found(make_docs([])) == []
    assert minhash.drop_near_duplicates(make_docs([])).count() == 0


def test_query_on_documents(spark, sf):
    t = pq.read_table(f"{sf}/documents.parquet", columns=["doc_id", "text"]).to_pydict()
    rows = list(zip(t["doc_id"], t["text"]))
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in registry.op8_minhash(spark, sf).collect())
    assert got == brute(rows, 2)


def test_sequential_test_keeps_pairs_at_the_threshold():
    least = minhash.least_matches(80, 1e-6)
    rng = np.random.RandomState(0)
    n = minhash.BANDS * minhash.ROWS
    a = np.zeros((4000, n), np.uint32)
    like, unlike = (rng.rand(4000, n) >= 0.8).astype(np.uint32), (rng.rand(4000, n) >= 0.3).astype(np.uint32)
    assert len(minhash.survive(a, like, least)) == 4000
    assert len(minhash.survive(a, unlike, least)) == 0
    assert len(minhash.survive(a, unlike[:, : minhash.ROWS * 8], least[:8])) < 200  # most leave early


def test_blocks_link_what_the_pivot_does_not(make_docs):
    """Members of a bucket that are like each other but not like its pivot are still linked."""
    rng = random.Random(9)
    common = [f"c{i}" for i in range(60)]
    tails = [[f"t{g}_{i}" for i in range(22)] for g in range(4)]
    rows = [(g * 10 + c, " ".join(common + tails[g] + [f"u{g}_{c}_{rng.randint(0, 9)}"])) for g in range(4) for c in range(4)]
    assert found(make_docs(rows), k=2) == brute(rows, 2)


def test_every_text_of_an_id_links(make_docs):
    """Ids that repeat with several texts, null ids too, link by each of their texts and by the id."""
    text = lambda g: [f"g{g}w{i}" for i in range(40)]
    near = lambda g: " ".join([*text(g)[:-1], f"other{g}"])
    rows = [(5, " ".join(text(g))) for g in range(4)] + [(20 + g, near(g)) for g in range(4)]
    rows += [(None, " ".join(text(g))) for g in range(10, 14)] + [(30 + g, near(g)) for g in range(10, 14)] + [(99, near(50)), (3, "")]
    rows += [(60 + g, " ".join(text(g))) for g in (60, 61, 60)] + [(50, " ".join(text(60))), (50, near(61)), (3, "two words"), (5, None)]
    got = found(make_docs(rows), k=2)
    assert got == brute(rows, 2)
    assert {c for d, _, c in got if d in range(20, 24)} == {5} and {c for d, _, c in got if d in range(40, 44)} == {NULL_ID}


@pytest.mark.parametrize("words", [minhash.FILTER_WORDS, 1])
def test_wanted_texts_all_pass(spark, monkeypatch, words):
    monkeypatch.setattr(minhash, "FILTER_WORDS", words)
    rows = spark.range(-2, 3000).selectExpr("id", "id * 7 as t", "'x' as x")
    wanted = spark.range(-2, 3000, 10).selectExpr("id", "id * 7 as t")
    passed = minhash._perhaps(rows, wanted, ["id", "t"])
    ids = [r.id for r in passed.collect()]
    assert passed.columns == ["id", "t", "x"] and len(ids) == len(set(ids)) and set(ids) >= set(range(-2, 3000, 10))
    assert len(ids) < 310 or words == 1
    assert minhash._perhaps(rows, wanted.limit(0), ["id", "t"]).isEmpty()
