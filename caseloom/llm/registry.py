"""The queries of this package: thin contracts over the operators, and DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import avi_media, bpe, line_dedup, minhash, mixing, quality, suffix_dedup, toxicity, url_filter, winnow
from .common import NULL_ID


def _docs(spark: SparkSession, sf_dir: str, *cols: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(*(cols or ("doc_id", "text", "source")))


def _held_out(c: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(c).cast("string")) % 5 == 0, F.lit(False))


def _classified(spark: SparkSession, sf_dir: str, op, label: str, at: float) -> DataFrame:
    docs, labels = _docs(spark, sf_dir, "doc_id", "text"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = op.train(docs, labels, label, keep=~_held_out())
    scored = op.score(docs, model).withColumnRenamed("__score", "score")
    return scored.select("doc_id", _held_out().alias("held_out"), "score", (F.col("score") >= at).cast("int").alias("predicted"))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _classified(spark, sf_dir, toxicity, "toxic", 0.5)


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _classified(spark, sf_dir, quality, "quality", 0.3)


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir, "doc_id", "text")
    kept = line_dedup.keep_lines(docs, line_dedup.line_bitmaps(docs, min_chars=40, min_docs=5))
    return kept.select("doc_id", F.col("__n_lines").alias("n_lines"), F.col("__n_dropped").alias("n_dropped"), F.sha2(F.col("__kept").cast("binary"), 256).alias("kept_sha256"))


def op3_winnow(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = winnow.compare_edits(_docs(spark, sf_dir, "doc_id", "text"))
    return near.select(F.col("id").alias("doc_id"), "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), winnow.shown("fp").alias("fingerprint"), winnow.shown("fp_edited").alias("edited_fingerprint"), "near_edited", "near_next")


def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(_docs(spark, sf_dir, "doc_id", "text", "source"), weights=(3, 1, 2), share=1.5, max_repeats=2)
    return mixed.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = suffix_dedup.remove_repeats(_docs(spark, sf_dir, "doc_id", "text"))
    return kept.select("doc_id", F.col("__n_bytes").alias("n_bytes"), F.col("__n_removed").alias("n_removed"), F.col("__n_spans").alias("n_spans"), F.sha2("__kept", 256).alias("kept_sha256"))


def op7_avi_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return avi_media.read_media(avi_media.store_texts(_docs(spark, sf_dir, "doc_id", "text")))


def op8_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = minhash.near_duplicates(_docs(spark, sf_dir, "doc_id", "text"), k=2, percent=80)
    plain = lambda c: F.when(F.col(c) != NULL_ID, F.col(c))
    return near.select(plain("d").alias("doc_id"), F.col("n").alias("n_shingles"), plain("component").alias("component_id"), (F.col("d") == F.col("component")).alias("kept"))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = bpe.encode_texts(_docs(spark, sf_dir, "doc_id", "text"), bpe.tokenizer_file("word_bpe_49k.json"))
    return made.select("doc_id", F.col("__n_tokens").alias("n_tokens"), F.sha2("__ids", 256).alias("ids_sha256"), F.sha2(F.col("__decoded").cast("binary"), 256).alias("decoded_sha256"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return url_filter.judge(pages).select(F.col("id").alias("page_id"), "host", "path", "rule", "verdict", "spam")


_BLANK = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

OP2_SQL = f"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS pos FROM d),
k AS (SELECT *, translate(trim(line, {_BLANK}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
g AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
m AS (SELECT k.doc_id, k.line, k.pos, g.key IS NOT NULL AND k.doc_id <> g.keeper AS gone FROM k LEFT JOIN g ON k.key = g.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id"""

OP4_SQL = r"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size, substr(md5(doc_id::VARCHAR), 1, 12) AS u FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, [3.0, 1.0, 2.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS w FROM d GROUP BY source),
c AS (SELECT *, 2.0::DOUBLE * source_size AS cap, (sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE AS budget FROM s),
v AS (SELECT *, (budget - coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
      / sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lv FROM c),
t AS (SELECT source, source_size, least(cap, max(lv) OVER () * w) AS target FROM v),
q AS (SELECT d.*, source_size, target, coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY u, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
-- one queue over all sources: packets of at most 512 words in order of finish time, each with the words served before it
k AS (SELECT *, unnest(range(1, (size + 511) // 512 + 1)) AS j FROM q, (VALUES (0), (1)) x(n) WHERE target > 0 AND size > 0),
p AS (SELECT doc_id, source, n, j, least(size, 512 * j) - 512 * (j - 1) AS words, (start + source_size * n + least(size, 512 * j))::DOUBLE / target AS f FROM k),
o AS (SELECT doc_id, words, coalesce(sum(words) OVER (ORDER BY f, source NULLS LAST, doc_id, n, j ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM p),
g AS (SELECT doc_id, sum(greatest(0, least(words, (SELECT floor(sum(target) + 1e-6) FROM t) - before))) AS taken FROM o GROUP BY doc_id)
SELECT q.doc_id, size, source_size, target, coalesce(taken, 0)::BIGINT AS taken FROM q LEFT JOIN g ON q.doc_id = g.doc_id"""

OP6_SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
g AS (SELECT doc_id, unnest(range(length(h) // 2 - 49)) AS i, h FROM d WHERE length(h) >= 100),
s AS MATERIALIZED (SELECT doc_id, i, hash(substr(h, 2 * i + 1, 100)) AS k FROM g),
m AS (SELECT k, min(doc_id) AS lo FROM s GROUP BY k HAVING min(doc_id) <> max(doc_id)),
c AS (SELECT doc_id, i FROM s JOIN m USING (k) WHERE doc_id > lo),
r AS (SELECT doc_id, i, i - lag(i) OVER w > 50 OR lag(i) OVER w IS NULL AS fresh FROM c WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
n AS (SELECT doc_id, i, sum(fresh::INT) OVER (PARTITION BY doc_id ORDER BY i) AS z FROM r),
v AS (SELECT doc_id, z, min(i) AS a, max(i) + 50 AS b FROM n GROUP BY doc_id, z),
e AS (SELECT v.doc_id, v.a, v.b, coalesce(lag(v.b) OVER w, 0) AS before, d.h, row_number() OVER (PARTITION BY v.doc_id ORDER BY a DESC) AS back FROM v JOIN d USING (doc_id) WINDOW w AS (PARTITION BY v.doc_id ORDER BY a)),
k AS (SELECT doc_id, sum(b - a) AS n_removed, count(*) AS n_spans,
      string_agg(substr(h, 2 * before + 1, 2 * (a - before)) || CASE WHEN back = 1 THEN substr(h, 2 * b + 1) ELSE '' END, '' ORDER BY a) AS kept FROM e GROUP BY doc_id)
SELECT d.doc_id, length(d.h) // 2 AS n_bytes, coalesce(k.n_removed, 0)::BIGINT AS n_removed, coalesce(k.n_spans, 0) AS n_spans, sha256(unhex(coalesce(k.kept, d.h))) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)"""

OP8_SQL = r"""
WITH RECURSIVE w AS MATERIALIZED (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, hash(g) AS g FROM (
  SELECT doc_id, unnest(CASE WHEN len(ws) = 0 OR ws IS NULL THEN []::VARCHAR[] WHEN len(ws) < 2 THEN [array_to_string(ws, ' ')]
         ELSE list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]) END) AS g FROM w)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
df AS MATERIALIZED (SELECT g, count(*) AS c FROM s GROUP BY g HAVING count(*) > 1),
-- the rarest fifth and one of a set's shingles meet those of any set that is 80 % alike
p AS MATERIALIZED (SELECT doc_id, g FROM (SELECT s.doc_id, s.g, row_number() OVER (PARTITION BY s.doc_id ORDER BY coalesce(df.c, 1), s.g) AS r, n.n FROM s JOIN n USING (doc_id) LEFT JOIN df ON s.g = df.g) WHERE 100 * r <= 100 * n - 80 * n + 100),
c AS MATERIALIZED (SELECT DISTINCT a.doc_id AS a, b.doc_id AS b FROM p a JOIN p b ON a.g = b.g AND a.doc_id < b.doc_id),
i AS MATERIALIZED (SELECT c.a, c.b, count(*) AS both_n FROM c JOIN s x ON x.doc_id = c.a JOIN s y ON y.doc_id = c.b AND x.g = y.g GROUP BY ALL),
e AS MATERIALIZED (SELECT i.a, i.b FROM i JOIN n x ON x.doc_id = i.a JOIN n y ON y.doc_id = i.b WHERE 100 * i.both_n >= 80 * (x.n + y.n - i.both_n)),
r(u, v) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.u, t.v FROM r JOIN (SELECT a AS u, b AS v FROM e UNION ALL SELECT b, a FROM e) t ON r.v = t.u)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.v AS component_id, m.v = d.doc_id AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN (SELECT u, min(v) AS v FROM r GROUP BY u) m ON m.u = d.doc_id"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_line_dedup": op2_line_dedup,
    "op3_winnow": op3_winnow,
    "op4_source_mixing": op4_source_mixing,
    "op5_quality": op5_quality,
    "op6_suffix_dedup": op6_suffix_dedup,
    "op7_avi_media": op7_avi_media,
    "op8_minhash": op8_minhash,
    "op9_bpe": op9_bpe,
    "op10_url_filter": op10_url_filter,
}
ORACLE: dict[str, str] = {"op2_line_dedup": OP2_SQL, "op4_source_mixing": OP4_SQL, "op6_suffix_dedup": OP6_SQL, "op8_minhash": OP8_SQL}
