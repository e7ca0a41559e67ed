import random
import zlib
from collections import Counter

import pytest

from clientele.llm import language_id as L
from tests.llm.data import SCHEMA, prose, rows, table


def grams(text):
    words = "".join(c if c.isalpha() else " " for c in (text or "").lower()).split()
    if not words:
        return Counter()
    s = " " + " ".join(words) + " "
    out = Counter(c for c in s if c != " ")
    for n in (2, 3):
        out.update(s[i : i + n] for i in range(len(s) - n + 1))
    return out


def code(gram):
    out = 0
    for c in gram:
        out = out << 21 | (1 if c == " " else ord(c))
    return out


def rank(counter, size):
    return [g for g, _ in sorted(counter.items(), key=lambda x: (-x[1], code(x[0])))[:size]]


def test_equals_brute_force(spark):
    made = rows()
    size = 60
    learned = {}
    for r in made:
        if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 and r[2] is not None:
            learned.setdefault(r[2], Counter()).update(grams(r[1]))
    places = {k: {g: i for i, g in enumerate(rank(c, size))} for k, c in learned.items()}

    def answer(text):
        own = rank(grams(text), size)
        if not own:
            return ("und", 0.0)
        away = {k: sum(abs(p[g] - i) if g in p else size for i, g in enumerate(own)) for k, p in places.items()}
        best = min(sorted(away), key=away.get)
        return (best, 1 - away[best] / (size * len(own)))

    docs = table(spark)
    got = L.identify(docs, L.profiles(docs.where(~L.held_out("doc_id")), size=size), size=size).collect()
    assert len(got) == len(made)
    for r in got:
        lang, score = answer(r.text)
        assert (r.lang_pred, r.score) == (lang, pytest.approx(score))
        assert 0 <= r.score <= 1


def test_held_out_rows_teach_nothing_and_accuracy_is_high(spark):
    rnd = random.Random(1)
    made = [(i, prose(rnd, 60, lang), lang, None, None, None, None, None, None) for i in range(100) for lang in [("en", "de")[i % 2]]]
    got = L.language_id(spark.createDataFrame(made, SCHEMA)).where(L.held_out("doc_id")).collect()
    assert len(got) > 5
    assert all(r.lang_pred == r.lang for r in got)
    held = table(spark).where(L.held_out("doc_id"))
    assert {r.lang_pred for r in L.language_id(held).collect()} == {"und"}


def test_empty_table(spark):
    assert L.language_id(table(spark, [])).collect() == []
