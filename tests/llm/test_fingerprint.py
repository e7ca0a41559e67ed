import hashlib
import re

from clientele.llm import fingerprint as P
from tests.llm.data import rows, table


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text.lower())
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def similarity(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def test_edited_texts_and_estimates(spark, monkeypatch):
    monkeypatch.setattr(P, "GROUP", 4)  # many groups, so that neighbours lie in different ones
    made = [r for r in rows() if r[0] is not None]
    made = sorted({r[0]: r for r in made}.values(), reverse=True)
    got = {r.doc_id: r for r in P.fingerprints(table(spark, made)).collect()}
    assert len(got) == len(made)
    away = []
    for i, r in enumerate(made):
        own, other = r[1] or "", made[(i + 1) % len(made)][1] or ""
        cut = len(own) // 3
        edited = own[: len(own) - cut] + other[:cut]
        g = got[r[0]]
        assert (g.n_chars, g.edited) == (len(own), edited)
        away += [g.near_edited - similarity(own, edited), g.near_next - similarity(own, other)]
        assert 0 <= g.near_edited <= 1 and 0 <= g.near_next <= 1
    assert max(map(abs, away)) < 0.25
    assert abs(sum(away) / len(away)) < 0.03


def test_equal_texts_have_equal_fingerprints(spark):
    got = P.fingerprints(table(spark)).collect()
    assert len(got) == len(rows())
    by_text = {}
    for r in got:
        by_text.setdefault(hashlib.sha256(r.edited.encode()).hexdigest(), set()).add(r.edited_fingerprint)
    assert all(len(x) == 1 for x in by_text.values())
    empty = [r for r in got if r.n_chars == 0]
    assert empty and all(r.fingerprint == "" and r.near_edited == 1.0 for r in empty)
    assert all(len(r.fingerprint) in (0, 256) for r in got)


def test_single_row_is_its_own_neighbour_and_empty_table(spark):
    r = P.fingerprints(spark.createDataFrame([(1, "abc")], "doc_id long, text string")).first()
    assert (r.edited, r.near_next) == ("aba", 1.0)
    assert P.fingerprints(table(spark, [])).collect() == []


def test_no_python_in_the_plan(spark):
    plan = P.fingerprints(table(spark))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
