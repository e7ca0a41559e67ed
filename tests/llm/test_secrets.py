import random
import re

import pytest

from clientele.llm import secrets as S
from tests.llm.data import rows, table

EXACT = {
    "assign": (r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    "access": (r"AKIA[A-Z0-9]+", 0, 18),
    "hex": (r"[0-9a-f]+", 0, 16),
    **{r.kind: (r.pattern, 0, 0) for r in S.MORE},
}


def brute(text):
    out = []
    for place, (kind, (pattern, group, least)) in enumerate(EXACT.items()):
        out += [(m.start(), place, kind, m.end()) for m in re.finditer(pattern, text or "") if len(m[group]) >= least]
    return ",".join(f"{k}:{a}:{b}" for a, _, k, b in sorted(out))


def texts():
    rnd = random.Random(3)
    parts = ["password", "PassWord", "passwd=", "token", "secret: ", "api_key", "apikey=", '"', "'", " ", ":", "=", "==", "AKIA", "AKIAX", "ghp_",
             "A1B2C3D4E5F6G7H8", "0123456789abcdef", "deadbeef", "é", "😀", "\n", "xoxb-", "1234567890-abc", "-----BEGIN RSA PRIVATE KEY-----",
             "eyJabcdefghij.eyJabcdefghij.abcdefghij", "a" * 40, "short", "="]
    return ["".join(rnd.choice(parts) for _ in range(rnd.randint(1, 25))) for _ in range(300)] + ["token=secret:abcdefghijklmnop", "toKen=abcdefghijkl"]


def test_spans_equal_brute_force(spark):
    made = [(i, t) for i, t in enumerate(texts())]
    got = S.scan(spark.createDataFrame(made, "doc_id long, text string")).select("doc_id", "text", S.written(S.F.col("found")).alias("s")).collect()
    assert len(got) == len(made)
    for r in got:
        assert r.s == brute(r.text)


def test_awkward_rows_and_columns_stay(spark):
    docs = table(spark)
    got = S.scan(docs).collect()
    assert len(got) == len(rows())
    assert S.scan(docs).columns == [*docs.columns, "found"]
    assert S.scan(table(spark, [])).collect() == []
    repeated = [(1, "password = abcdefghijkl1"), (1, "nothing"), (None, "token: abcdefghijkl1"), (None, None)]
    found = S.scan(spark.createDataFrame(repeated, "doc_id long, text string")).collect()
    assert sorted(len(r.found) for r in found) == [0, 0, 1, 1]


def test_trigram_queries():
    q = {r.kind: S.trigram_query(r.pattern) for r in S.BASE + S.MORE}
    assert ["kia"] not in q["access"] and q["access"] == [["aki", "kia"]]
    assert q["hex"] == []
    assert ["api", "ike", "key", "pik"] in q["assign"] and ["_ke", "api", "i_k", "key", "pi_"] in q["assign"]
    assert len(q["assign"]) == 6
    assert q["github"] and all(t.endswith("_") or len(t) == 3 for ands in q["github"] for t in ands)


@pytest.mark.parametrize("pattern, text", [("ab?cd[xy]", "zacdyz"), ("(foo|ba[rz])qux+", "bazquxx"), ("x{2}yz", "axxyzb")])
def test_every_match_holds_its_trigrams(pattern, text):
    query = S.trigram_query(pattern)
    assert re.search(pattern, text)
    assert any(all(t in text for t in ands) for ands in query)


def test_masking(spark):
    made = [(1, "a password=abcdefghijkl0123456789abcdef b"), (2, "x 0123456789abcdef y 0123456789abcdef"), (3, "clean"), (4, None)]
    found = S.scan(spark.createDataFrame(made, "doc_id long, text string"))
    got = {r.doc_id: r.m for r in found.select("doc_id", S.masked(S.F.col("text"), S.F.col("found")).alias("m")).collect()}
    assert got == {1: "a <secret> b", 2: "x <secret> y <secret>", 3: "clean", 4: None}


def test_no_python_in_the_plan(spark):
    plan = S.scan(table(spark))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
