import hashlib
from collections import Counter

import pyarrow.parquet as pq
from tokenizers import Tokenizer

import corpus_pipeline as pipeline
from caseloom.llm import bpe, mixing

from .test_line_dedup import brute as brute_lines
from .test_minhash import brute as brute_near


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_stages_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = pipeline.cut(pipeline.keep_quality(spark, docs, sf))
    assert kept.columns == docs.columns and set(rows_of(kept)) <= set(rows_of(docs))
    labels = pq.read_table(f"{sf}/labels.parquet").to_pydict()
    truth, stay = dict(zip(labels["doc_id"], labels["quality"])), {r["doc_id"] for r in kept.collect()}
    assert sum((d in stay) == (y == 1) for d, y in truth.items()) / len(truth) > 0.95

    lines = pipeline.cut(pipeline.drop_repeated_lines(spark, kept, sf))
    want = {d: t for d, _, _, t in brute_lines([(r["doc_id"], r["text"]) for r in kept.collect()])}
    got = lines.collect()
    assert {r["doc_id"]: r["text"] for r in got} == want and all(r["n_chars"] == len(r["text"]) for r in got)

    near = pipeline.cut(pipeline.drop_near_duplicates(spark, lines, sf))
    want_ids = {d for d, _, c in brute_near([(r["doc_id"], r["text"]) for r in got], 5) if d == c}
    assert {r["doc_id"] for r in near.collect()} == want_ids

    mixed = pipeline.cut(pipeline.mix_sources(spark, near, sf))
    copies = {r["id"]: r["copies"] for r in mixing.mix(near).collect() if r["copies"]}
    assert Counter(r["doc_id"] for r in mixed.collect()) == copies

    library = Tokenizer.from_file(bpe.tokenizer_file("word_bpe_49k.json"))
    library.no_truncation()
    library.no_padding()
    text = {r["doc_id"]: r["text"] for r in near.collect()}
    out = pipeline.encode(spark, mixed, sf).collect()
    assert len(out) == sum(copies.values())
    for r in out:
        ids = library.encode(text[r["doc_id"]] or "", add_special_tokens=False).ids
        assert bytes(r["ids"]) == b"".join(i.to_bytes(4, "little") for i in ids) and r["n_tokens"] == len(ids)
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_odd_and_empty_tables(spark, make_docs, odd_rows, sf):
    for rows in (odd_rows, []):
        docs = make_docs(rows, clashing=True)
        names = docs.columns
        for i, (_, stage) in enumerate(pipeline.STAGES):
            docs = pipeline.cut(stage(spark, docs, sf))
            assert i == len(pipeline.STAGES) - 1 or docs.columns == names
        assert docs.count() == 0 or rows
