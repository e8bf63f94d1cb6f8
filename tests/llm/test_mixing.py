import hashlib
import math
import random

from caseloom.llm import mixing


def brute(rows, weights=(3, 1, 2), share=1.5, times=2):
    size = [len((t or "").split()) for _, t, _ in rows]
    names = sorted({s for _, _, s in rows if s is not None}) + [None] * any(s is None for _, _, s in rows)
    total = {n: sum(z for z, r in zip(size, rows) if r[2] == n) for n in names}
    w = {n: weights[i % len(weights)] for i, n in enumerate(names)}
    budget, target, free = share * sum(size), {}, list(names)
    while free:
        level = budget / sum(w[n] for n in free)
        over = [n for n in free if level * w[n] > times * total[n] + 1e-9]
        for n in over or free:
            target[n] = times * total[n] if over else level * w[n]
        if not over:
            break
        budget -= sum(target[n] for n in over)
        free = [n for n in free if n not in over]
    return size, total, target


def simulate(rows, weights=(3, 1, 2), share=1.5, times=2):
    """A plain queue: of all sources' next packets, the one that finishes first is served, until the budget is spent.

    Rows are (id, text, source) with distinct ids or null. Returns words taken and copies begun by row.
    """
    size, total, target = brute(rows, weights, share, times)
    budget = math.floor(sum(target.values()) + 1e-6)
    taken, copies, waiting = [0] * len(rows), [0] * len(rows), []
    for rank, n in enumerate(target):
        place = lambda i: (hashlib.md5(str(rows[i][0]).encode()).hexdigest()[:12], rows[i][0])
        own, upto, queue = sorted((i for i, r in enumerate(rows) if r[2] == n and size[i]), key=place), 0, []
        for turn in range(times):
            for i in own:
                for at in range(0, size[i], mixing.PACKET):
                    upto += min(mixing.PACKET, size[i] - at)
                    queue.append((upto / target[n], i, at))
        waiting.append((rank, queue[::-1]))
    while budget > 0:
        rank, queue = min((w for w in waiting if w[1]), key=lambda w: (w[1][-1][0], w[0]))
        _, i, at = queue.pop()
        got = min(budget, mixing.PACKET, size[i] - at)
        taken[i] += got
        copies[i] += at == 0
        budget -= got
    return taken, copies


def check(rows, docs):
    got = mixing.mix(docs).collect()
    size, total, target = brute(rows)
    assert sorted(r["size"] for r in got) == sorted(size) and len(got) == len(rows)
    for r in got:
        assert r["source_size"] == total[r["source"]] and math.isclose(r["target"], target[r["source"]], abs_tol=1e-6)
        assert 0 <= r["taken"] <= 2 * r["size"]
    assert sum(r["taken"] for r in got) == math.floor(sum(target.values()) + 1e-6)
    for n in total:
        off = sum(r["taken"] for r in got if r["source"] == n) - target[n]
        assert -mixing.PACKET < off < mixing.PACKET * len(total)
    finish = [r["finish"] for r in got if r["finish"] is not None]
    assert finish == sorted(finish)
    return got


def test_equals_a_plain_queue(make_docs):
    rng = random.Random(7)
    rows = [(i, "w " * rng.choice([0, 3, 40, 511, 512, 513, 3000]), rng.choice(["hot", "hot", "hot", "b", None, "d"])) for i in range(150)]
    taken, copies = simulate(rows)
    got = {r["id"]: (r["taken"], r["copies"]) for r in check(rows, make_docs(rows))}
    assert got == {r[0]: (t, c) for r, t, c in zip(rows, taken, copies)}


def test_rows_without_an_id_spread(make_docs):
    rows = [(None, "the same words", "hot")] * 300 + [(i, "other words here", "b") for i in range(30)]
    got = check(rows, make_docs(rows))
    assert len({r["finish"] for r in got if r["source"] == "hot"}) == 300 and len({r["row"] for r in got}) == 330


def test_targets_and_takes(make_docs):
    rows = [(i, "w " * (i * 7 % 40), "hot" if i % 3 == 0 else f"s{i % 4}") for i in range(400)]
    first = check(rows, make_docs(rows))
    again = mixing.mix(make_docs(rows[::-1])).collect()
    plain = lambda found: [{k: v for k, v in r.asDict().items() if k != "row"} for r in found]
    assert plain(first) == plain(again)


def test_odd_rows(make_docs, odd_rows):
    check(odd_rows, make_docs(odd_rows, clashing=True))


def test_take_mix_repeats_whole_documents(make_docs, odd_rows):
    docs = make_docs(odd_rows, clashing=True)
    mixed = mixing.take_mix(docs)
    assert mixed.columns == docs.columns
    copies = {}
    for r in mixing.mix(docs).collect():
        copies[r["id"]] = copies.get(r["id"], 0) + r["copies"]
    got = {}
    for r in mixed.collect():
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + 1
    assert {k: v for k, v in copies.items() if v and k != 5} == {k: v for k, v in got.items() if k != 5}


def test_empty_and_wordless_tables(make_docs):
    assert mixing.mix(make_docs([])).count() == 0
    rows = [(1, None, "a"), (2, "", None)]
    assert [(r["size"], r["target"], r["taken"]) for r in mixing.mix(make_docs(rows)).collect()] == [(0, 0.0, 0)] * 2
    assert mixing.take_mix(make_docs(rows)).count() == 0
