import random
import re
import zlib

import xxhash

from caseloom.llm import winnow


def tokens_of(text):
    """Runs of 24 characters at most; of longer ones, and of unspaced scripts, every character."""
    out = []
    for run in re.findall(r"[^ \t\n\x0b\x0c\r]+", text):
        for part in re.findall(f"[{winnow.UNSPACED}]|[^{winnow.UNSPACED}]+", run):
            out += [part] if len(part) <= 24 else list(part)
    return out


def brute(text, k=winnow.K, w=winnow.W):
    tokens = [zlib.crc32(x.encode()) % winnow.PRIME + 1 for x in tokens_of(text or "")]
    spans = [tokens[i : i + k] for i in range(len(tokens) - k + 1)] or ([tokens] if tokens else [])
    grams = []
    for s in spans:
        h = 0
        for x in s:
            h = (h * winnow.BASE + x) % winnow.PRIME
        grams.append((h * 1_103_515_245 + 12_345) % winnow.PRIME)
    out = []
    for a in range(max(1, len(grams) - w + 1)) if grams else []:
        at = min(range(a, min(a + w, len(grams))), key=lambda i: (grams[i], -i))  # the rightmost of the smallest
        if (grams[at], at) not in out:
            out.append((grams[at], at))
    return out


def unpack(fp):
    return [(x >> winnow.AT, (1 << winnow.AT) - 1 - (x & ((1 << winnow.AT) - 1))) for x in fp]


def like(a, b):
    a, b = {h for h, _ in a}, {h for h, _ in b}
    return len(a & b) / len(a | b) if a | b else 1.0


def compare(rows, docs):
    got = winnow.compare_edits(docs).collect()
    signed = lambda t: (h := xxhash.xxh64_intdigest((t or "").encode(), 42)) - (h >> 63 << 64)
    ring = sorted(rows, key=lambda r: (-(-(2**63) if r[0] is None else r[0]), signed(r[1]), (r[1] or "").encode()))
    want = []
    for i, (d, t) in enumerate(ring):
        t, nxt = t or "", ring[(i + 1) % len(ring)][1] or ""
        half = len(t) // 2
        edited = t[: len(t) - half] + nxt[:half]
        want.append((d, len(t), edited, brute(t), brute(edited), round(like(brute(t), brute(edited)), 9), round(like(brute(t), brute(nxt)), 9)))
    have = [(r["id"], r["n_chars"], r["edited"], unpack(r["fp"]), unpack(r["fp_edited"]), round(r["near_edited"], 9), round(r["near_next"], 9)) for r in got]
    assert sorted(have, key=repr) == sorted(want, key=repr)


def test_random_texts(make_docs):
    rng = random.Random(5)
    rows = [(i * 3, " ".join(rng.choice(["a", "bb", "a", "cé", "x" * 30, "\U0001f600q"]) for _ in range(rng.randint(0, 60)))) for i in range(60)]
    compare(rows, make_docs(rows))


def test_odd_rows(make_docs, odd_rows):
    rows = [r[:2] for r in odd_rows if r[0] != 10]
    compare(rows, make_docs(rows, clashing=True))
    compare([(7, "an only row of a few words")], make_docs([(7, "an only row of a few words")]))


def test_ranges_join_up(make_docs):
    rows = [(i, f"text {i} " * (i % 5)) for i in range(40)] + [(None, f"no id {i}") for i in range(60)]
    df, _ = winnow.with_guests(make_docs(rows), "doc_id", "text")
    many = df.collect()
    assert len({r["bucket"] for r in many}) > 5 and sum(r["guest"] for r in many) == len({r["bucket"] for r in many})
    assert len({r["bucket"] for r in many if r["id"] is None and not r["guest"]}) > 3  # a hot id spreads
    compare(rows, make_docs(rows))


def test_what_stands_before_moves_no_token(make_docs):
    """One more character before a long text without spaces leaves most of its hashes."""
    rng = random.Random(2)
    han, code = "".join(chr(rng.randint(0x4E00, 0x9FFF)) for _ in range(900)), "".join(rng.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/") for _ in range(900))
    for text in (han, code):
        a, b = [{h for h, _ in unpack(r["fp"])} for r in winnow.fingerprint(make_docs([(1, text), (2, "x" + text)]), "text", "fp").select("fp").collect()]
        assert len(a & b) / len(a | b) > 0.95


def test_guarantee(make_docs):
    """A shared run of w + k - 1 tokens always shares a hash."""
    rng = random.Random(8)
    run = " ".join(f"r{i}" for i in range(winnow.W + winnow.K - 1))
    side = lambda: " ".join(f"z{rng.randint(0, 9999)}" for _ in range(rng.randint(0, 40)))
    rows = [(i, f"{side()} {run} {side()}") for i in range(30)]
    fps = [{h for h, _ in unpack(r["fp"])} for r in winnow.fingerprint(make_docs(rows), "text", "fp").select("fp").collect()]
    assert all(a & b for a in fps for b in fps)


def test_empty_table(make_docs):
    assert winnow.compare_edits(make_docs([])).count() == 0


def test_plan_has_no_python(make_docs):
    plan = winnow.compare_edits(make_docs([(1, "a b"), (2, "c")]))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
