"""Quality classifier: Bradley-Terry ranking of documents from preference pairs, cut at a score quantile.

Labelled documents (a bounded sample, ``max_per_class`` of each label) give pairs (good, bad). A document's latent score
is linear in standardised style features; the chance that a beats b is sigmoid(score(a) - score(b)), fitted by logistic
loss on feature differences with full-batch Newton steps and L2. Rejection is a quantile of the training scores, every
sample row weighted to its class's share among all labels: the quantile that best separates the labels. Output scores
are sigmoid((latent - cut) / spread) shifted so that the cut maps to ``threshold``.

Features: shares of adjacent character-class pairs (16 classes), and repetition, word, line and length figures, all of
the whole text. Every feature costs a bounded number of numpy passes over a batch's bytes.

Features of the sample are computed by the executors; no text reaches the driver.

Edge cases: null and empty texts have zero features and a defined score; labels that are null or not 0/1 are skipped,
and so is an id that has both labels; of rows that repeat an id the sample takes one, by the hash of the text; without
labels of both kinds every score is 1 (nothing is rejected); repeated rows repeat; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batches_of, cut, drop_cut, prefix_hash, span_hash, text_buffer, tune, words

#: Character classes: letters by case, digits, spaces, line ends, frequent punctuation one by one, other bytes.
CLASSES = np.full(256, 15, np.uint8)
CLASSES[128:] = 0  # letters beyond ASCII, mostly
CLASSES[97:123], CLASSES[65:91], CLASSES[48:58] = 0, 1, 2
for _k, _chars in enumerate([" \t\r\x0b\x0c", "\n", ".", ",", "!", "?", "|", "%$&", "#*", "'\"-", ":;()/", "<>[]{}_=+@~^\\`"], 3):
    for _c in _chars.encode():
        CLASSES[_c] = _k
N_PAIRS = 256
N_FEATURES = N_PAIRS + 8


def style(col: pa.Array) -> np.ndarray:
    """(texts, N_FEATURES) float64; every row depends on its own text alone."""
    data, off = text_buffer(col)
    n = len(off) - 1
    out = np.zeros((n, N_FEATURES))
    if not n or not len(data):
        return out
    size = np.diff(off)
    cls = CLASSES[data].astype(np.int64)
    doc = np.repeat(np.arange(n), size)
    inside = doc[1:] == doc[:-1]
    pair = (doc[:-1] * N_PAIRS + cls[:-1] * 16 + cls[1:])[inside]
    out[:, :N_PAIRS] = np.bincount(pair, minlength=n * N_PAIRS).reshape(n, N_PAIRS) / np.maximum(1, size - 1)[:, None]

    h = prefix_hash(data)
    s, e, d = words(data, off)
    count = np.bincount(d, minlength=n)
    width = np.bincount(d, e - s, minlength=n) / np.maximum(1, count)
    distinct = _distinct(span_hash(h, s, e), d, n)
    ends = np.flatnonzero(data == 10)
    starts = np.unique(np.concatenate([off[:-1][size > 0], ends + 1]))
    starts = starts[starts < len(data)]
    stops = np.append(starts[1:], len(data))
    ld = np.searchsorted(off, starts, side="right") - 1
    lines = np.bincount(ld, minlength=n)
    extra = out[:, N_PAIRS:]
    extra[:, 0] = distinct / np.maximum(1, count)
    extra[:, 1] = np.log1p(count)
    extra[:, 2] = width / 10
    extra[:, 3] = _distinct(span_hash(h, starts, stops), ld, n) / np.maximum(1, lines)
    extra[:, 4] = np.log1p(lines)
    extra[:, 5] = distinct / np.maximum(1, count) ** 0.7
    shouting = np.bincount(doc, cls == 1, minlength=n) / np.maximum(1, np.bincount(doc, cls < 2, minlength=n))
    extra[:, 6] = shouting
    extra[:, 7] = np.bincount(doc, cls >= 5, minlength=n) / np.maximum(1, count)  # punctuation a word
    return out


def _distinct(hashes: np.ndarray, d: np.ndarray, n: int) -> np.ndarray:
    """Distinct hashes per text, by one sort of (text, 40 bits of hash)."""
    key = np.sort((d.astype(np.uint64) << np.uint64(40)) | (hashes >> np.uint64(24)))
    fresh = np.ones(len(key), bool)
    fresh[1:] = key[1:] != key[:-1]
    return np.bincount((key[fresh] >> np.uint64(40)).astype(np.int64), minlength=n)


@dataclass
class Ranking:
    """A fitted ranking: score(x) = sigmoid(((x - mean) / scale . weights - cut) / spread + shift)."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    cut: float
    spread: float
    shift: float

    def latent(self, x: np.ndarray) -> np.ndarray:
        # a sum for each row: a matrix product rounds by the number of rows
        return (np.clip((x - self.mean) / self.scale, -8, 8) * self.weights).sum(axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((self.latent(x) - self.cut) / self.spread + self.shift, -500, 500)
        return 1 / (1 + np.exp(-z))


def fit_pairs(x: np.ndarray, y: np.ndarray, share_bad: float, threshold: float, pairs_each: int = 4, l2: float = 1e-2, steps: int = 12) -> Ranking | None:
    """Bradley-Terry fit on pairs that join every good row to ``pairs_each`` bad ones and the other way round."""
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    if not len(good) or not len(bad):
        return None
    mean, scale = x.mean(axis=0), x.std(axis=0)
    scale = np.where(scale > 1e-9, scale, 1.0)
    z = np.clip((x - mean) / scale, -8, 8)
    most = max(len(good), len(bad)) * pairs_each
    k = np.arange(most)
    a, b = good[k % len(good)], bad[(k * 7919 + k // len(good)) % len(bad)]  # a fixed stride, so fits repeat
    diff = z[a] - z[b]
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(diff @ w, -40, 40)))
        grad = diff.T @ (1 - p) / most - l2 * w
        hess = (diff * (p * (1 - p))[:, None]).T @ diff / most + l2 * np.eye(len(w))
        w += np.linalg.solve(hess, grad)
    s = z @ w
    weight = np.where(y == 1, (1 - share_bad) / len(good), share_bad / len(bad))
    order = np.argsort(s)
    # rejecting the lowest i rows errs on the good ones among them and on the bad ones above
    wrong = np.concatenate([[0], np.cumsum(np.where(y == 1, weight, -weight)[order])]) + share_bad
    best = np.flatnonzero(wrong <= wrong.min() + 1e-12)
    i = int(best[len(best) // 2])
    below, above = (s[order[i - 1]] if i else s.min() - 1), (s[order[i]] if i < len(s) else s.max() + 1)
    return Ranking(mean, scale, w, float((below + above) / 2), float(max(1e-3, s.std() / 4)), float(np.log(threshold / (1 - threshold))))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, keep: Column, id_col: str, text_col: str, max_per_class: int) -> tuple[DataFrame, dict[int, int]]:
    """((__id, __x, __y) of a bounded sample, label counts of all rows kept).

    The sample takes ``max_per_class`` ids of each class in order of their hash, one row of each. Labels are counted in
    full; an id with both labels has none.
    """
    known = labels.filter(keep & F.col(label).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("__id")).agg(F.min(F.col(label).cast("int")).alias("__y"), F.max(F.col(label).cast("int")).alias("__top")).filter("__y = __top").drop("__top")
    counts = {r["__y"]: r["count"] for r in known.groupBy("__y").count().collect()}
    parts = [known.filter(F.col("__y") == y).orderBy(F.xxhash64("__id"), "__id").limit(max_per_class) for y in (0, 1)]
    chosen = parts[0].unionByName(parts[1])
    texts = docs.select(F.col(id_col).alias("__id"), F.coalesce(F.col(text_col), F.lit("")).alias("__x"))
    # at most 2 * max_per_class ids
    found = texts.join(F.broadcast(chosen), "__id").groupBy("__id").agg(F.min(F.struct(F.xxhash64("__x").alias("h"), "__x")).alias("m"), F.min("__y").alias("__y"))
    return cut(found.select("__id", F.col("m.__x").alias("__x"), "__y")), counts


def _styled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches_of(batches, 1.5):
        x = style(b.column(1))
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array([row.tobytes() for row in x], pa.binary())], names=["__id", "__y", "f"])


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", keep: Column | None = None, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3, max_per_class: int = 2000) -> Ranking | None:
    """Fit on a sample of labelled rows that ``keep`` lets through; None without both labels."""
    sample, counts = labelled_sample(docs, labels, label, F.lit(True) if keep is None else keep, id_col, text_col, max_per_class)
    kind = sample.schema["__id"].dataType.simpleString()
    # N_FEATURES numbers for each of 2 * max_per_class rows
    rows = sample.mapInArrow(_styled, f"__id {kind}, __y int, f binary").orderBy("__id").toArrow()
    drop_cut(sample)
    if rows.num_rows == 0:
        return None
    x = np.frombuffer(b"".join(rows.column(2).to_pylist()), float).reshape(rows.num_rows, N_FEATURES)
    y = rows.column(1).to_numpy()
    return fit_pairs(x, y, counts.get(0, 0) / max(1, sum(counts.values())), threshold)


def score(docs: DataFrame, model: Ranking | None, text_col: str = "text") -> DataFrame:
    """``docs`` with __score double; a column of that name is replaced."""
    docs = docs.drop("__score")
    sent = docs.sparkSession.sparkContext.broadcast(model)
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for b in batches_of(batches, 1.5):
            s = np.ones(b.num_rows) if m is None else m.score(style(b.column(place)))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(s, pa.float64())], names=[*b.schema.names, "__score"])

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return tune(docs).mapInArrow(run, f"{ddl}, __score double")
