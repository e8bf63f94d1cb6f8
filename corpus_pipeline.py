"""A training-data pipeline over ``documents``: five stages, each one of the operators of ``caseloom.llm``.

Every stage takes (spark, docs, sf_dir), works on all rows its predecessor kept and returns the columns of documents,
the last one excepted, which returns the encoded rows. ``run`` applies them in order; between stages the rows are
written to the shared folder, as the stages would be on a cluster.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caseloom.llm import bpe, line_dedup, minhash, mixing, quality
from caseloom.llm.common import cut, positional


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject: Bradley-Terry score of 0.3 and more.

    The classifier learns from the labels of ``sf_dir`` (documents without a label take no part in that). Its sample's
    texts are those of the input.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality.train(docs, labels, "quality")
    inner = positional(docs)  # the score's name may be one of the documents' columns
    scored = quality.score(inner, model, text_col=f"c{docs.columns.index('text')}")
    return scored.filter("__score >= 0.3").select(*inner.columns).toDF(*docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of 40 code points and more in at least 5 documents stay in the one with the largest id only."""
    kept = line_dedup.dedup_lines(docs, min_chars=40, min_docs=5)
    return kept.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else kept


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five-word shingles, similarity of 0.8 and more."""
    return minhash.drop_near_duplicates(docs, k=5, percent=80)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources weighed 3, 1, 2 in turn, 150 % of all words in total, no document more than twice.

    A document stands in the result once for every pass that takes it, at least in part, and always whole.
    """
    return mixing.take_mix(docs, weights=(3, 1, 2), share=1.5, max_repeats=2)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, n_tokens, ids (little-endian uint32) and the digest of the decoded text."""
    made = bpe.encode_texts(docs.select("doc_id", "source", "text"), bpe.tokenizer_file("word_bpe_49k.json"))
    return made.select("doc_id", "source", F.col("__n_tokens").alias("n_tokens"), F.col("__ids").alias("ids"), F.sha2(F.col("__decoded").cast("binary"), 256).alias("decoded_sha256"))


STAGES = [("quality classifier", keep_quality), ("line dedup", drop_repeated_lines), ("MinHash near-dedup", drop_near_duplicates), ("mixing sources", mix_sources), ("BPE encoding", encode)]

#: The classifier, its training and the tokenizer are not expressible in SQL; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = cut(docs)
    return docs
