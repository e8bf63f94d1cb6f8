"""Toxicity by weak supervision: voters, a generative label model, and a linear classifier on its posteriors.

Voters are present-or-absent signs of toxicity: words of a small built-in lexicon, patterns (an insult said to someone,
shouted, or repeated), and byte n-grams mined from a bounded labelled sample (``max_per_class`` rows of each label).
The label model is naive Bayes over the votes: expectation-maximisation, with the given label as one more voter of fixed
accuracy, estimates every voter's accuracy on both classes; residual correlations of voters within a class are estimated from the posteriors, and a
voter's evidence is divided by one plus its positive correlations, so that voters that repeat each other count once.
A logistic regression on hashed n-grams is then trained on the posterior labels, and alone scores documents. An n-gram's
value is its share of the words, full from one in ``DENSE`` on: what a long text holds by chance counts little.

N-grams of the sample are counted, and its votes taken, by the executors; no text reaches the driver.

Edge cases: null and empty texts score the classifier's bias; without labels of both kinds every score is 0; labels
that are null or not 0/1 are skipped, and so is an id that has both; of rows that repeat an id the sample takes one;
repeated rows repeat; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, SPACE, batches_of, drop_cut, text_buffer, tune, words
from .quality import labelled_sample

BITS = 20
LENGTHS = (5, 8)
#: An n-gram seen once in this many words, or more often, counts in full.
DENSE = 100
LEXICON = "idiot moron clown worthless pathetic trash scum loser disgusting stupid dumb filthy vermin garbage imbecile coward liar freak pig hate".split()
PATTERNS = [r"\byou(?:'re| are)? (?:an? )?(?:{w})\b", r"\bth(?:is|at|ese|ose) (?:{w})s?\b", r"(?:{w})[^.]{{0,80}}(?:{w})", r"\b(?:{w})!+", r"\bshut up\b|\bgo away\b|\bkill yourself\b"]
_FOLD = LOWER.copy()
_FOLD[SPACE] = 32


def grams(data: np.ndarray, off: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each n-gram length: (start positions, hashed buckets) of the n-grams inside single texts."""
    low = _FOLD[data].astype(np.uint64)
    for n in LENGTHS:
        if len(data) < n:
            continue
        v = low[: len(low) - n + 1].copy()
        for j in range(1, n):
            v |= low[j : len(low) - n + 1 + j] << np.uint64(8 * j)
        ok = np.ones(len(v), bool)
        for j in range(1, n):
            at = off[1:] - j
            ok[at[(at >= 0) & (at < len(v))]] = False
        bucket = ((v * np.uint64(0x9E3779B97F4A7C15 + 2 * n)) >> np.uint64(64 - BITS)).astype(np.int32)
        yield ok, bucket


def present(col: pa.Array, slot: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (text, feature) pairs with their values, ``slot`` giving a bucket's feature or -1."""
    data, off = text_buffer(col)
    found = []
    for ok, bucket in grams(data, off):
        f = slot[bucket]
        at = np.flatnonzero((f >= 0) & ok)
        found.append(((np.searchsorted(off, at, side="right") - 1) << BITS) | f[at])
    pairs, count = np.unique(np.concatenate(found) if found else np.zeros(0, np.int64), return_counts=True)
    d = pairs >> BITS
    n_words = np.maximum(1, np.bincount(words(data, off)[2], minlength=len(off) - 1))
    return d, pairs & ((1 << BITS) - 1), np.minimum(1.0, count * DENSE / n_words[d])


#: Values are summed as whole numbers of this part, so that sums do not depend on their order.
UNIT = 1 << 20


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(bucket, label, summed value) of a task's sample rows."""
    everything = np.arange(1 << BITS, dtype=np.int32)
    has = np.zeros((2, 1 << BITS), np.int64)
    for b in batches_of(batches, 1.5):
        y = b.column(2).to_numpy(zero_copy_only=False)
        d, f, x = present(b.column(1), everything)
        np.add.at(has, (y[d], f), np.rint(x * UNIT).astype(np.int64))
    for c in (0, 1):
        some = np.flatnonzero(has[c])
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(np.full(len(some), c, np.int32)), pa.array(has[c][some])], names=["bucket", "y", "x"])


def mine(sample: DataFrame, n: list[int], most: int) -> tuple[np.ndarray, np.ndarray]:
    """(buckets whose values tell the classes apart best, best first, by the root of their likelihood ratio; log-odds of all).

    ``n``: sample rows of each class. At most one number for each bucket and class comes to the driver.
    """
    sums = sample.mapInArrow(_counted, "bucket long, y int, x long").groupBy("bucket", "y").agg(F.sum("x").alias("x")).toArrow()
    has = np.zeros((2, 1 << BITS))
    has[sums.column(1).to_numpy(), sums.column(0).to_numpy()] = sums.column(2).to_numpy() / UNIT
    odds = np.log((has[1] + 0.5) / (n[1] + 1)) - np.log((has[0] + 0.5) / (n[0] + 1))
    share, twice = has.sum(axis=0) / sum(n), np.zeros(1 << BITS)
    for c in (0, 1):
        for seen, due in ((has[c], n[c] * share), (n[c] - has[c], n[c] * (1 - share))):
            twice += 2 * seen * np.log(np.maximum(seen, 1e-9) / np.maximum(due, 1e-9))
    sure = np.sqrt(np.maximum(0, twice))
    worth = np.where(sure >= 4.5, sure, 0)  # a chance gram among a million stays below
    best = np.argsort(-worth, kind="stable")[:most]
    return best[worth[best] > 0], odds


def votes(texts: list[str]) -> np.ndarray:
    """(texts, voters) of the lexicon and pattern voters."""
    word = [regex.compile(rf"\b{w}s?\b") for w in LEXICON]
    alt = "|".join(LEXICON)
    said = word + [regex.compile(p.format(w=alt)) for p in PATTERNS]
    lower = [t.lower() for t in texts]
    return np.array([[r.search(t) is not None for r in said] for t in lower], dtype=bool).reshape(len(texts), len(said))


def label_model(v: np.ndarray, y: np.ndarray, weight: np.ndarray, label_accuracy: float = 0.9, rounds: int = 20) -> np.ndarray:
    """Posterior of label 1 per row: EM for accuracies, evidence discounted by correlations within classes.

    A voter that is absent abstains and gives no evidence. The given label is a voter of fixed accuracy, which keeps the
    classes in place; their shares are those of the weighted labels.
    """
    x = v.astype(float)
    prior = np.clip((y * weight).sum() / weight.sum(), 1e-3, 1 - 1e-3)
    known = np.log(prior / (1 - prior)) + np.where(y == 1, 1, -1) * np.log(label_accuracy / (1 - label_accuracy))
    q = np.where(y == 1, label_accuracy, 1 - label_accuracy)
    for _ in range(rounds):
        rate = [np.clip(((p * weight) @ x + 1e-4) / ((p * weight).sum() + 2e-4), 1e-4, 1 - 1e-4) for p in (1 - q, q)]
        # correlation of what the classes' rates leave unexplained
        rest = x - (np.outer(q, rate[1]) + np.outer(1 - q, rate[0]))
        sd = np.sqrt((rest**2 * weight[:, None]).sum(axis=0) / weight.sum()) + 1e-6
        corr = (rest * weight[:, None]).T @ rest / weight.sum() / np.outer(sd, sd)
        np.fill_diagonal(corr, 0)
        discount = 1 / (1 + np.clip(corr - 0.1, 0, None).sum(axis=0))
        q = 1 / (1 + np.exp(-np.clip(known + x @ (discount * (np.log(rate[1]) - np.log(rate[0]))), -30, 30)))
    return q


@dataclass
class Classifier:
    slot: np.ndarray
    weights: np.ndarray
    bias: float

    def score(self, col: pa.Array) -> np.ndarray:
        d, f, x = present(col, self.slot)
        z = np.bincount(d, self.weights[f] * x, minlength=len(col)) + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def _seen(sent):
    """Sample rows to (id, label, features, values, votes), each a packed array."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches_of(batches, 1.5):
            d, f, x = present(b.column(1), sent.value)
            cuts = np.searchsorted(d, np.arange(b.num_rows + 1))
            spoken = votes([t or "" for t in b.column(1).to_pylist()])
            pack = lambda v: pa.array([v[i:j].tobytes() for i, j in zip(cuts[:-1], cuts[1:])], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pack(f.astype(np.int32)), pack(x), pa.array([r.tobytes() for r in spoken], pa.binary())], names=["__id", "__y", "f", "x", "v"])

    return run


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", keep: Column | None = None, id_col: str = "doc_id", text_col: str = "text", max_per_class: int = 3000, n_voters: int = 256, n_features: int = 4096) -> Classifier | None:
    """Fit on a sample of labelled rows that ``keep`` lets through; None without both labels."""
    sample, counts = labelled_sample(docs, labels, label, F.lit(True) if keep is None else keep, id_col, text_col, max_per_class)
    by = {r["__y"]: r["count"] for r in sample.groupBy("__y").count().collect()}
    if len(by) < 2:
        drop_cut(sample)
        return None
    best, odds = mine(sample, [by[0], by[1]], n_features)
    slot = np.full(1 << BITS, -1, np.int32)
    slot[best] = np.arange(len(best))
    kind = sample.schema["__id"].dataType.simpleString()
    sent = docs.sparkSession.sparkContext.broadcast(slot)
    # n_features numbers at most for each of 2 * max_per_class rows
    rows = sample.mapInArrow(_seen(sent), f"__id {kind}, __y int, f binary, x binary, v binary").orderBy("__id").toArrow()
    drop_cut(sample)
    y = rows.column(1).to_numpy()
    fs, xs, said = (rows.column(i).to_pylist() for i in (2, 3, 4))
    f, x = np.frombuffer(b"".join(fs), np.int32).astype(np.int64), np.frombuffer(b"".join(xs), float)
    r = np.repeat(np.arange(len(y)), [len(v) // 4 for v in fs])
    voter = np.flatnonzero(odds[best] > 0)[:n_voters]  # signs of toxicity vote; the others only help the classifier
    seat = np.full(len(best) + 1, -1)
    seat[voter] = np.arange(len(voter))
    mined = np.zeros((len(y), len(voter)), bool)
    on = (seat[f] >= 0) & (x >= 0.5)
    mined[r[on], seat[f[on]]] = True
    spoken = np.frombuffer(b"".join(said), bool).reshape(len(y), -1)
    v = np.concatenate([spoken, mined], axis=1)
    v = np.concatenate([v, ~v.any(axis=1, keepdims=True)], axis=1)  # one voter for clean: nothing was found
    total = sum(counts.values())
    weight = np.where(y == 1, counts[1] / total / (y == 1).sum(), counts[0] / total / (y == 0).sum())
    q = label_model(v, y, weight)
    w, b = fit_linear(r, f, x, len(y), len(best), q, weight / weight.sum())
    return Classifier(slot, w, b)


def fit_linear(r: np.ndarray, f: np.ndarray, x: np.ndarray, n: int, m: int, q: np.ndarray, weight: np.ndarray, steps: int = 400, l2: float = 1e-4) -> tuple[np.ndarray, float]:
    """Logistic regression of soft labels ``q`` on sparse rows (r, f, x), by adaptive full-batch steps."""
    w, b = np.zeros(m), float(np.log(np.clip((q * weight).sum(), 1e-3, 1 - 1e-3) / np.clip(1 - (q * weight).sum(), 1e-3, 1)))
    m1, m2 = np.zeros(m + 1), np.zeros(m + 1)
    for t in range(1, steps + 1):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(r, w[f] * x, minlength=n) + b, -30, 30)))
        g = (p - q) * weight
        grad = np.append(np.bincount(f, g[r] * x, minlength=m) + l2 * w, g.sum())
        m1, m2 = 0.9 * m1 + 0.1 * grad, 0.99 * m2 + 0.01 * grad**2
        step = 0.03 * (m1 / (1 - 0.9**t)) / (np.sqrt(m2 / (1 - 0.99**t)) + 1e-8)
        w -= step[:-1]
        b -= float(step[-1])
    return w, b


def score(docs: DataFrame, model: Classifier | None, text_col: str = "text") -> DataFrame:
    """``docs`` with __score double; a column of that name is replaced."""
    docs = docs.drop("__score")
    sent = docs.sparkSession.sparkContext.broadcast(model)
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for b in batches_of(batches, 1.5):
            s = np.zeros(b.num_rows) if m is None else m.score(b.column(place))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(s, pa.float64())], names=[*b.schema.names, "__score"])

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return tune(docs).mapInArrow(run, f"{ddl}, __score double")
