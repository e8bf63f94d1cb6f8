import zlib

import numpy as np
import pyarrow as pa
import pytest

from caseloom.llm import quality, registry, toxicity


def held_out(spark, sf, query, label):
    labels = {r["doc_id"]: r[label] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = query(spark, sf).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1 for r in rows)
    return [(r["score"], r["predicted"], labels[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in labels]


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    tox = held_out(spark, sf, registry.op1_toxicity, "toxic")
    assert np.mean([p == y for _, p, y in tox]) > 0.97
    assert np.mean([p == 0 for _, p, y in tox if y == 0]) > 0.99
    good = held_out(spark, sf, registry.op5_quality, "quality")
    assert np.mean([p == y for _, p, y in good]) > 0.97


@pytest.mark.parametrize("op,label,blank", [(toxicity, "toxic", 0.0), (quality, "quality", 1.0)])
def test_odd_rows_and_labels(spark, make_docs, odd_rows, op, label, blank):
    docs = make_docs([r[:2] for r in odd_rows], clashing=True)
    labels = spark.createDataFrame([(1, 1), (2, 0), (None, 1), (4, None), (5, 1), (5, 1), (7, 0), (99, 1), (8, 3)], f"doc_id long, {label} int")
    scored = op.score(docs, op.train(docs, labels, label))
    assert scored.columns == [c for c in docs.columns if c != "__score"] + ["__score"]
    rows = scored.collect()
    assert len(rows) == len(odd_rows) and all(0 <= r["__score"] <= 1 for r in rows)
    by = {}
    for r in rows:
        by.setdefault(r["text"], set()).add(r["__score"])
    assert all(len(v) == 1 for v in by.values())
    assert by[None] == by[""]
    none = op.score(docs, op.train(docs, labels.filter(f"{label} = 1"), label))
    assert {r["__score"] for r in none.collect()} == {blank}
    assert op.score(make_docs([]), op.train(make_docs([]), labels, label)).count() == 0


def test_ids_with_both_labels_and_several_texts(spark, make_docs):
    """An id with both labels has none; of an id's rows one is in the sample."""
    docs = make_docs([(1, "a"), (1, "b"), (2, "c"), (3, None), (3, "d"), (4, "e")])
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, 1), (3, 0), (3, 0), (9, 1)], "doc_id long, quality int")
    from pyspark.sql import functions as F

    sample, counts = quality.labelled_sample(docs, labels, "quality", F.lit(True), "doc_id", "text", 10)
    rows = sorted((r["__id"], r["__y"]) for r in sample.collect())
    assert rows == [(1, 1), (3, 0)] and counts == {1: 2, 0: 1}


def test_scores_do_not_depend_on_their_batch():
    rng = np.random.RandomState(3)
    m = quality.Ranking(rng.randn(264), np.abs(rng.randn(264)) + 0.1, rng.randn(264), 0.1, 0.5, 0.0)
    x = rng.randn(500, 264)
    assert np.array_equal(m.score(x), np.concatenate([m.score(r[None]) for r in x]))


def test_label_model_finds_accuracies():
    """Posteriors follow good voters, not noise, and voters that repeat each other count about once."""
    rng = np.random.RandomState(0)
    truth = rng.rand(4000) < 0.3
    given = np.where(rng.rand(4000) < 0.9, truth, ~truth).astype(int)
    good = np.stack([np.where(truth, rng.rand(4000) < 0.8, rng.rand(4000) < 0.02) for _ in range(3)], axis=1)
    noise = rng.rand(4000, 3) < 0.2
    good = np.concatenate([good, ~good.any(axis=1, keepdims=True)], axis=1)  # the voter for clean, as in training
    q = toxicity.label_model(np.concatenate([good, noise], axis=1), given, np.ones(4000))
    assert np.mean((q >= 0.5) == truth) > np.mean(given == truth) + 0.03
    repeated = np.concatenate([noise[:, :1]] * 8, axis=1)
    r = toxicity.label_model(np.concatenate([good, repeated], axis=1), given, np.ones(4000))
    assert np.mean((r >= 0.5) == truth) > 0.95


def test_bradley_terry_ranks_and_cuts():
    rng = np.random.RandomState(1)
    y = (rng.rand(900) < 0.7).astype(int)
    x = rng.randn(900, 6) + y[:, None] * np.array([3, 1, 0, 0, 0, 0])
    m = quality.fit_pairs(x, y, (y == 0).mean(), 0.3)
    s = m.score(x)
    assert np.mean((s >= 0.3) == (y == 1)) > 0.93
    order = np.argsort(s)
    assert (np.argsort(m.latent(x)[order]) == np.arange(900)).mean() > 0.9


def test_rows_do_not_depend_on_their_batch():
    texts = ["Plain words here.", "", None, "SHOUTED!! WORDS!!\n\nx", "é ñ ß", "a b a b a b"]
    whole = quality.style(pa.array(texts))
    assert np.array_equal(whole, np.concatenate([quality.style(pa.array([t], pa.string())) for t in texts]))
