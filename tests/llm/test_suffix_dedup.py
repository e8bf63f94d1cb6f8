import random

import numpy as np

from caseloom.llm import suffix_dedup
from caseloom.llm.common import NULL_ID
from caseloom.llm.suffix_dedup import LENGTH


def brute(rows):
    raw = [(NULL_ID if d is None else d, d, (t or "").encode()) for d, t in rows]
    low: dict[bytes, int] = {}
    for d, _, b in raw:
        for i in range(len(b) - LENGTH + 1):
            low[b[i : i + LENGTH]] = min(low.get(b[i : i + LENGTH], d), d)
    out = []
    for d, name, b in raw:
        gone = np.zeros(len(b) + 1, bool)
        for i in range(len(b) - LENGTH + 1):
            if low[b[i : i + LENGTH]] < d:
                gone[i : i + LENGTH] = True
        gone[-1] = False
        spans = int((gone[1:] & ~gone[:-1]).sum()) + int(gone[0])
        out.append((name, len(b), int(gone.sum()), spans, bytes(x for x, g in zip(b, gone) if not g)))
    return sorted(out, key=repr)


def found(docs):
    return sorted(((r["doc_id"], r["__n_bytes"], r["__n_removed"], r["__n_spans"], bytes(r["__kept"])) for r in suffix_dedup.remove_repeats(docs).collect()), key=repr)


def test_random_passages(make_docs):
    rng = random.Random(4)
    pool = ["".join(rng.choice("abcdé ") for _ in range(rng.randint(45, 160))) for _ in range(12)]
    rows = [(i, "".join(rng.choice(pool)[rng.randint(0, 9) :] if rng.random() < 0.6 else str(rng.random()) * 2 for _ in range(rng.randint(1, 6)))) for i in range(60)]
    assert found(make_docs(rows)) == brute(rows)


def test_few_letters_and_long_runs(make_docs):
    rng = random.Random(6)
    rows = [(i, "a" * rng.randint(40, 130) + "".join(rng.choice("ab") for _ in range(rng.randint(0, 90)))) for i in range(25)]
    assert found(make_docs(rows)) == brute(rows)


def test_odd_rows(make_docs, odd_rows):
    rows = [r[:2] for r in odd_rows]
    assert found(make_docs(rows, clashing=True)) == brute(rows)


def test_empty_table(make_docs):
    assert found(make_docs([])) == []


def test_deep_shallow_orders_like_a_plain_sort():
    rng = np.random.RandomState(2)
    shared = rng.randint(97, 99, 60).astype(np.uint8)
    texts = [np.concatenate([shared, rng.randint(97, 99, 30).astype(np.uint8)]) for _ in range(40)]
    buf = np.concatenate(texts)
    pos = np.concatenate([np.arange(41) + 90 * i for i in range(40)])
    did = np.repeat(np.arange(40), 41)
    items, cls = suffix_dedup.deep_shallow(buf, pos, did)
    by = {}
    for i, c in zip(items.tolist(), cls.tolist()):
        by.setdefault(c, []).append(i)
    string = lambda i: buf[pos[i] : pos[i] + LENGTH].tobytes()
    assert all(len({string(i) for i in v}) == 1 for v in by.values())
    every = {}
    for i in range(len(pos)):
        every.setdefault(string(i), set()).add(i)
    shared_by_two = {k: v for k, v in every.items() if len({did[i] for i in v}) > 1}
    have = {string(v[0]): set(v) for v in by.values()}
    assert all(have.get(k) == v for k, v in shared_by_two.items())


def test_blind_trie():
    rng = random.Random(1)
    strings = [("ab" * 10 + "".join(rng.choice("abc") for _ in range(6))).encode() for _ in range(80)]
    trie = suffix_dedup.BlindTrie()
    for i, s in enumerate(strings):
        trie.insert(s, i)
    classes = list(trie.classes())
    assert [strings[c[0]] for c in classes] == sorted(set(strings))
    assert sorted(i for c in classes for i in c) == list(range(80))
