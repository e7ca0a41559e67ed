import hashlib
import math

import pytest

from clientele.llm import mixing as M
from tests.llm.data import rows, table


def water_fill(sizes, weights=(1, 2, 3), most=3):
    names = sorted(sizes, key=lambda s: (s is None, s))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, left, open_ = {}, float(sum(sizes.values())), set(names)
    while open_:
        level = left / sum(w[s] for s in open_)
        full = [s for s in open_ if level * w[s] >= most * sizes[s]]
        if not full:
            target |= {s: level * w[s] for s in open_}
            break
        for s in full:
            target[s] = float(most * sizes[s])
            left -= target[s]
            open_.discard(s)
    return target


def brute(made, seed=7):
    docs = [(r[0], r[3], len((r[1] or "").split())) for r in made]
    sizes = {}
    for _, s, n in docs:
        sizes[s] = sizes.get(s, 0) + n
    target = water_fill(sizes)
    mark = {i: int(hashlib.md5(f"{seed}:{'' if k is None else k}:{n}".encode()).hexdigest()[:13], 16) for i, (k, _, n) in enumerate(docs)}
    sent = []
    for s in sizes:
        upto = 0
        for i in sorted((i for i, d in enumerate(docs) if d[1] == s), key=lambda i: (mark[i], docs[i][0] is None, docs[i][0] or 0, docs[i][2])):
            n = docs[i][2]
            upto += n
            for turn in range(min(3, math.ceil(target[s] / sizes[s])) if n else 0):
                sent.append(((turn * sizes[s] + upto) / target[s], (s is None, s or ""), mark[i], i, n))
    times, total = dict.fromkeys(range(len(docs)), 0), 0
    for _, _, _, i, n in sorted(sent):
        if total + n / 2 < sum(target.values()):
            times[i] += 1
        total += n
    return sorted(((k, n, sizes[s], round(target[s], 6), n * times[i]) for i, (k, s, n) in enumerate(docs)), key=str)


def test_equals_brute_force(spark):
    made = [r for r in rows() if r[1] is None or r[1].isascii()]
    got = M.mix(table(spark, made)).collect()
    assert sorted(((r.doc_id, r["size"], r.source_size, round(r.target, 6), r.taken) for r in got), key=str) == brute(made)
    assert sum(r.taken for r in got) == pytest.approx(sum(r["size"] for r in got), rel=0.5)


def test_one_hot_source_and_a_heavy_weight(spark):
    made = [(i, "w " * (1 + i % 5), None, "hot" if i % 3 else f"s{i % 9}", None, None, None, None, None) for i in range(3000)]
    got = M.mix(table(spark, made), also=["source"]).collect()
    per = {}
    for r in got:
        per.setdefault(r.source, [0, r.target])[0] += r.taken
        assert r.taken <= 3 * r["size"]
    for taken, target in per.values():
        assert abs(taken - target) <= 15
    assert sum(t for _, t in per.values()) == pytest.approx(sum(r["size"] for r in got))


def test_no_words_and_empty_table(spark):
    got = M.mix(table(spark, [(1, None, None, "a", None, None, None, None, None), (2, "", None, None, None, None, None, None, None)])).collect()
    assert [(r["size"], r.taken) for r in got] == [(0, 0), (0, 0)]
    assert M.mix(table(spark, [])).collect() == []


def test_reruns_agree(spark):
    once, again = (sorted(M.mix(table(spark).repartition(n)).collect(), key=str) for n in (1, 5))
    assert once == again
