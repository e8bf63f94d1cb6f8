import random
import zlib
from collections import defaultdict

from caseloom.llm import line_dedup
from caseloom.llm.common import NULL_ID

BLANK = " \t\n\x0b\x0c\r"


def brute(rows, min_chars=40, min_docs=5):
    fold = lambda s: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s.strip(BLANK))
    holders = defaultdict(set)
    for d, text in rows:
        for line in (text or "").split("\n"):
            holders[fold(line)].add(NULL_ID if d is None else d)
    hot = {k: max(v) for k, v in holders.items() if len(k) >= min_chars and len(v) >= min_docs}
    out = []
    for d, text in rows:
        lines = (text or "").split("\n")
        stay = [x for x in lines if fold(x) not in hot or hot[fold(x)] == (NULL_ID if d is None else d)]
        out.append((d, len(lines), len(lines) - len(stay), "\n".join(stay)))
    return sorted(out, key=repr)


def found(docs, **how):
    kept = line_dedup.keep_lines(docs, line_dedup.line_bitmaps(docs, **how))
    return sorted(((r["doc_id"], r["__n_lines"], r["__n_dropped"], r["__kept"]) for r in kept.collect()), key=repr)


def test_random_lines(make_docs):
    rng = random.Random(3)
    pool = [("line %d " % i) * 8 for i in range(12)] + ["short"] + ["É" * 39, "É" * 40, " Ab" * 20]
    rows = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randint(0, 12)))) for i in range(120)]
    assert found(make_docs(rows)) == brute(rows)


def test_any_number_of_documents(make_docs):
    rng = random.Random(4)
    pool = ["line %d " % i * 8 for i in range(9)] + ["short"]
    rows = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randint(0, 9)))) for i in range(60)]
    for min_docs in (1, 2, 3, 50):
        assert found(make_docs(rows), min_docs=min_docs) == brute(rows, min_docs=min_docs)


def test_few_documents_that_repeat_a_line(spark, make_docs):
    lines = [f"{c} is a line of some forty characters, at least" for c in "abcdef"]
    rows = [(i, "\n".join([lines[i % 6], *[lines[j] for j in range(6) if (i + j) % 2] * 30])) for i in range(9)] + [(20, lines[0])]
    for min_docs in (2, 5):
        assert found(make_docs(rows), min_docs=min_docs, hold=7) == brute(rows, min_docs=min_docs)


def test_odd_rows(make_docs, odd_rows):
    rows = [r[:2] for r in odd_rows]
    assert found(make_docs(rows, clashing=True)) == brute(rows)
    docs = make_docs(rows, clashing=True)
    whole = line_dedup.dedup_lines(docs)
    assert whole.columns == docs.columns
    assert sorted((r["doc_id"], r["text"], r["__kept"]) for r in whole.filter("doc_id > 3").collect()) == sorted((d, t, str(d)) for d, _, _, t in brute(rows) if d is not None and d > 3)


def test_empty_table(make_docs):
    assert found(make_docs([])) == []


def test_bitmaps_hold_one_bit_a_line(make_docs):
    line = "z" * 50
    rows = [(i, f"own {i}\n{line}\nrest") for i in range(6)]
    maps = line_dedup.line_bitmaps(make_docs(rows)).collect()
    assert {r["d"] for r in maps} == set(range(5))
    assert all(zlib.decompress(bytes(r["keep"])) == b"\x05" and (r["n_lines"], r["n_dropped"]) == (3, 1) for r in maps)


def test_a_hot_line_over_many_tasks(spark, make_docs):
    rows = [(i, "q" * 45 + f"\nown line {i}") for i in range(3000)]
    docs = make_docs(rows)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert found(docs) == brute(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
