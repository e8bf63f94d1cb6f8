"""URL filters: longest-prefix rules first, then logistic regression on hashed character n-grams of host and path.

The classifier is trained on the driver from a small labelled table of URLs (:data:`LABELLED` unless another is given;
``max_labelled`` rows at most are read from a given one, in order of the url's hash). Features are the 3- to 5-grams
of ``^host$`` and of ``^path$``, hashed into ``2**bits`` buckets, host and path apart, each present once, by numpy passes
over the whole batch's bytes; training is full-batch gradient descent with L2, so it is deterministic. The weights
(``8 * 2**bits`` bytes) are broadcast. Only urls that no rule decides are scored.

Rules are (host, path prefix, verdict): a rule fits its host and all subdomains when the url's path starts with the
rule's; the longest rule text wins. They are few and fixed, and become one CASE expression in the plan.

Edge cases: a null url, or one without ``://``, has empty host and path, fits no rule, and is judged by the classifier
on empty strings; repeated rows repeat; an empty table gives no rows; only the id and url columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_buffer

RULES: tuple[tuple[str, str, str], ...] = (("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block"))

_PLAIN = (
    "library garden harbour weather compiler museum kitchen transit school astronomy history cycling townhall recipes theater chemistry "
    "river orchard bakery physics atlas poetry railway forest village music council hospital pottery island science painting harvest lantern "
    "meridian thornbury eastwell norholt anderby hertheon reston tinsher onderal wharton leathin stedder blenheim oriental thatcher nation "
    "berlin lumiere maison jardin strasse zeitung escuela ciudad camino universidad enseignement wissenschaft"
).split()
_PLAIN += "seaside-inn north-shore green-valley old-mill blue-heron city-hall book-club thesis others heather theory wharves shores earthly onward lesson entire ashland flowers stones bridges horses trees voices gardens lilies theaters churches forests recipes letters verses studies pictures houses cottages sciences ferries series wishes inches breezes eaves".split()
_SPAM = [f"{a}-{b}" for i, a in enumerate("cheap free casino adult spam win ads bet hot fake crypto click".split()) for j, b in enumerate("pills farm bets win x track loans cams bonus links prizes meds".split()) if a != b and (i + j) % 2 == 0]
_FRONT, _ZONE = ["", "www.", "m.", "blog.", "news."], ["com", "net", "org"]
_PATHS = "/en/12 /de/431.html /fr/88/ /es/705 /article/solar-eclipse /2021/05/notes /index.html /about".split()
_SPAM_PATHS = "/buy-now /casino/bonus /free-money /cheap-viagra /xxx/cams /click/here/win /replica-watches /payday-loan".split()


def _labelled() -> list[tuple[str, int]]:
    rows = []
    for i, name in enumerate(_PLAIN + _SPAM):
        bad = int(i >= len(_PLAIN))
        for k in range(15):
            rows.append((f"https://{_FRONT[k % 5]}{name}.example.{_ZONE[k % 3]}{_PATHS[(i + k) % 8]}", bad))
        for k in range(2):
            rows.append((f"http://{_FRONT[(i + k) % 5]}{name}.example.{_ZONE[(i + k) % 3]}{_SPAM_PATHS[(i + 3 * k) % 8]}", 1))
    return rows + [("", 0)] * 80


#: The small labelled table: ordinary and spam sites over the same subdomains, zones and ordinary paths, and spam paths.
LABELLED: list[tuple[str, int]] = _labelled()

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_for(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """(text, verdict) of the longest rule that fits, nulls if none does. Ties of length go to the first by text."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: (len(r[0] + r[1]), r[0] + r[1]), reverse=False):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        text, verdict = F.when(fits, F.lit(h + p)).otherwise(text), F.when(fits, F.lit(v)).otherwise(verdict)
    return text, verdict


def features(hosts: pa.Array, paths: pa.Array, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, bucket) pairs of a batch of urls; rows whose host is null have none."""
    found = []
    for seed, col in ((1, hosts), (2, paths)):
        data, off = text_buffer(pc.binary_join_element_wise("^", col.cast(pa.string()), "$", ""))
        row = np.repeat(np.arange(len(off) - 1), np.diff(off))
        raw, h = data.astype(np.uint64), np.full(len(data), seed * 0x9E3779B1, np.uint64)
        for n in range(1, 6):
            if n > len(raw):
                break
            h = (h[: len(raw) - n + 1] ^ raw[n - 1 :]) * np.uint64(0x100000001B3)
            if n >= 3:
                inside = row[: len(h)] == row[n - 1 :]
                m = ((h ^ np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)
                found.append((row[: len(h)][inside] << bits) | m[inside].astype(np.int64))
    pairs = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
    return pairs >> bits, pairs & ((1 << bits) - 1)


def logits(w: np.ndarray, hosts: pa.Array, paths: pa.Array) -> np.ndarray:
    """Weights of each row's buckets, scaled by the root of their number, and the bias."""
    r, k = features(hosts, paths, (len(w) - 1).bit_length() - 1)
    count = np.bincount(r, minlength=len(hosts))
    return np.bincount(r, w[k], minlength=len(hosts)) / np.sqrt(np.maximum(1, count)) + w[-1]


def split_url(url: str) -> tuple[str, str]:
    """:func:`host_of` and :func:`path_of` for one string."""
    at = (url or "").find("://")
    if at < 0:
        return "", ""
    rest = url[at + 3 :]
    stop = min((i for c in "/?#" if (i := rest.find(c)) >= 0), default=len(rest))
    path = rest[stop:]
    end = min((i for c in "?#" if (i := path.find(c)) >= 0), default=len(path))
    return rest[:stop].translate(str.maketrans(_UPPER, _LOWER)), path[:end]


def train(labelled: Sequence[tuple[str, int]], bits: int = 14, steps: int = 600, rate: float = 2.0, l2: float = 1e-4) -> np.ndarray:
    """Weights of the buckets, the bias last. Rows are scaled by the root of their number of features."""
    parts = [split_url(u) for u, _ in labelled]
    rows, y = len(parts), np.array([float(v) for _, v in labelled])
    r, c = features(*(pa.array([p[i] for p in parts], pa.string()) for i in (0, 1)), bits)
    x = 1 / np.sqrt(np.maximum(1, np.bincount(r, minlength=rows)))[r]
    w, b = np.zeros(1 << bits), 0.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-(np.bincount(r, w[c] * x, minlength=rows) + b)))
        g = (p - y) / max(1, rows)
        w -= rate * (np.bincount(c, g[r] * x, minlength=1 << bits) + l2 * w)
        b -= rate * g.sum()
    return np.append(w, b)


def judge(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: Sequence[tuple[str, str, str]] = RULES, labelled: DataFrame | None = None, max_labelled: int = 10_000, bits: int = 14) -> DataFrame:
    """(id, host, path, rule, verdict, spam double) per row, spam null where a rule decides. ``labelled``: (url, label), bounded by ``max_labelled``."""
    table = LABELLED
    if labelled is not None:
        table = [(r.url, int(r.label)) for r in labelled.filter("label is not null").orderBy(F.xxhash64("url"), "url", "label").limit(max_labelled).collect()]
    sent = pages.sparkSession.sparkContext.broadcast(train(table, bits))

    @F.pandas_udf("double")
    def spam(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for hosts, paths in parts:
            open_ = hosts.notna().to_numpy()
            out = np.full(len(hosts), np.nan)
            z = logits(sent.value, pa.array(hosts[open_], pa.string()), pa.array(paths[open_], pa.string()))
            out[open_] = 1 / (1 + np.exp(-z))
            yield pd.Series(out)

    rows = pages.select(F.col(id_col).alias("id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    rule, verdict = rule_for(F.col("host"), F.col("path"), rules)
    ruled = rows.select("id", "host", "path", rule.alias("rule"), verdict.alias("said"))
    left = lambda c: F.when(F.col("said").isNull(), F.col(c))
    scored = ruled.withColumn("spam", F.nanvl(spam(left("host"), left("path")), F.lit(None).cast("double")))
    return scored.select("id", "host", "path", "rule", F.coalesce("said", F.when(F.col("spam") >= 0.5, "block").otherwise("allow")).alias("verdict"), "spam")
