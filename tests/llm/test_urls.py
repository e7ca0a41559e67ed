import random
import re

import numpy as np
import pytest

from clientele.llm import urls as U

SCHEMA = "page_id long, url string, html string, verdict string"
PAGES = [
    (1, "http://a.example.com/en/1", '<a href="http://b.example.com/x">'), (2, "https://EXAMPLE.com/en/77?x#y", None), (3, "http://x.net/de/1#z", ""),
    (4, "http://sub.example.net/de/8", "<a href='//other.org/1'>"), (5, "http://notexample.com/fr/", '<a href="/local">'), (6, None, "x"), (7, "no scheme/en/", "x"),
    (8, "http://com/en/", ""), (9, "http://b.example.com/fr/1", '<a href=https://bad.org/p?q>'), (10, "http://bad.org/es/1", ""), (10, "http://bad.org/es/1", ""),
    (11, "http://bad.org/es/2", ""), (12, "http://bad.org/fr/2", ""), (13, "http://links.io/1", '<a href="http://bad.org/1"><a href="http://bad.org/2">'),
    (14, "http://links.io/2", '<A HREF = "http://bad.org/1">'), (15, "http://?q", ""), (None, "http://x.org/es/", None), (16, "://odd/en/", ""),
]
RULES = {"com/en/": "block", "example.com/en/7": "allow", "net/de/": "allow", "example.net/de/8": "block", "org/es/": "block"}


def split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path


def rule(host, path):
    best = None
    for r in RULES:
        h, p = r.split("/", 1)
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and (best is None or len(r) > len(best)):
            best = r
    return best


def flown(hosts, edges, weights, d=0.85):
    """What comes to each host, in pages: the direct solution of the walk's equations."""
    at = {h: i for i, h in enumerate(hosts)}
    p = np.zeros((len(hosts), len(hosts)))
    for (a, b), n in edges.items():
        p[at[b], at[a]] += n
    for i in range(len(hosts)):
        p[i, i] += p[:, i].sum() == 0
    p /= p.sum(axis=0)
    return np.linalg.solve(np.eye(len(hosts)) - d * p, (1 - d) * np.array([float(weights.get(h, 0)) for h in hosts]))


def verdicts(pages):
    hosts, trust, distrust, edges = {}, {}, {}, {}
    for _, url, html, *_ in pages:
        host, path = split(url)
        if not host:
            continue
        hosts[host] = hosts.get(host, 0) + 1
        r = rule(host, path)
        if r:
            side = trust if RULES[r] == "allow" else distrust
            side[host] = side.get(host, 0) + 1
        for link in re.findall(r"""(?i)href\s*=\s*["']?((?:https?:)?//[^"'\s>]+)""", html or ""):
            to = split(link if "://" in link else "http:" + link)[0]
            if to and to != host:
                edges[host, to] = edges.get((host, to), 0) + 1
    known = sorted({*hosts, *[h for e in edges for h in e]})
    back = {(b, a): n for (a, b), n in edges.items()}
    with np.errstate(invalid="ignore"):
        excess = flown(known, back, distrust) / flown(known, back, hosts) - flown(known, edges, trust) / flown(known, edges, hosts)
    by_host = {h: "block" if round(x, 6) > U.RATE else "allow" for h, x in zip(known, excess.tolist(), strict=True)}
    out = []
    for i, url, *_ in pages:
        host, path = split(url)
        r = rule(host, path)
        out.append((i, host, path, r, RULES[r] if r else by_host.get(host, "allow")))
    return sorted(out, key=str)


def web(seed):
    """Pages of 40 hosts with links at random, along a ring, and of ten hosts to one whose pages are blocked."""
    rnd = random.Random(seed)
    names = [f"h{i}.{rnd.choice(['com', 'org', 'net', 'io', 'io', 'io'])}" for i in range(40)] + ["a.example.com", "bad.org"]
    made = []
    for i in range(400):
        host = rnd.choice([0, 41, rnd.randrange(42), rnd.randrange(42)])
        to = [names[41] if 30 <= host < 40 else names[(host + 1) % 30] if host % 3 else rnd.choice(names[:40]) for _ in range(rnd.randint(0, 3) if host < 41 else 0)]
        path = f"/{rnd.choice(['en', 'es', 'de', 'fr']) if host < 41 else 'es'}/{rnd.randint(0, 9)}"
        made.append((i, f"http://{names[host]}{path}", "".join(f'<a href="http://{t}/">' for t in to), ""))
    return made


def chain(n=45):
    """Hosts in a row that link towards a blocked one; a large host far away thins the distrust out."""
    made = [(i, f"http://c{i}.io/", f'<a href="http://c{i + 1}.io/">', "") for i in range(n)]
    made += [(n + i, f"http://c{n}.io/", '<a href="http://bad.org/">' if i else "", "") for i in range(3)]
    return [*made, *[(100 + i, f"http://bad.org/es/{i}", "", "") for i in range(200)]]


@pytest.mark.parametrize("pages", [PAGES, web(1), chain()], ids=["awkward", "web", "chain"])
def test_equals_brute_force(spark, pages):
    made = [(*p[:3], "clash") for p in pages]
    got = U.judge(spark.createDataFrame(made, SCHEMA)).collect()
    want = verdicts(made)
    assert sorted(((r.page_id, r.host, r.path, r.rule, r.verdict) for r in got), key=str) == want
    # not the rules alone: the graph blocks and allows
    assert {w[4] for w in want if w[3] is None and w[1]} == {"allow", "block"}


def test_ranks_of_a_small_graph(spark):
    edges = {("a", "b"): 1, ("b", "c"): 2, ("b", "a"): 1, ("d", "a"): 1, ("c", "c"): 1}
    weights, parts = {"a": 3, "d": 1}, {"a": 1}
    flows = spark.createDataFrame([("t", a, b, n) for (a, b), n in edges.items()], "kind string, source string, target string, n long")
    starts = spark.createDataFrame([("t", h, w, parts.get(h, 0)) for h, w in weights.items()], "kind string, host string, weight long, part long")
    got = {r.host: (r.score, r.part) for r in U.ranks(flows, starts).collect()}
    hosts = sorted(got)
    want = zip(flown(hosts, edges, weights), flown(hosts, edges, parts), strict=True)
    assert got == {h: (pytest.approx(x, abs=1e-7), pytest.approx(y, abs=1e-7)) for h, (x, y) in zip(hosts, want, strict=True)}
    assert sum(x for x, _ in got.values()) == pytest.approx(4)


def judged(spark, pages):
    got = U.judge(spark.createDataFrame([(i, *p, "") for i, p in enumerate(pages)], SCHEMA)).collect()
    return {r.page_id: r.verdict for r in got}


def test_verdicts_of_the_contract(spark):
    said = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")]
    assert [(r.host, r.path, r.verdict) for r in U.RULES] == said
    got = judged(spark, [(f"http://{host}{path}", "") for host, path, _ in said] + [("http://www.x.net/de/8", ""), ("http://a.example.net/de/80", "")])
    assert [got[i] for i in range(7)] == [*[v for *_, v in said], "allow", "block"]


def test_seeds_and_linking_hosts_at_the_limit_of_the_query(spark):
    link = '<a href="http://bad.org/1">'
    pages = [("http://bad.org/es/1", ""), ("http://bad.org/es/2", ""), ("http://bad.org/es/3", ""), ("http://bad.org/fr/4", ""),
             ("http://links.io/1", link), ("http://calm.io/1", ""), ("http://half.org/es/1", ""), ("http://half.org/fr/1", "")]
    got = judged(spark, pages)
    # 0.85 * 3 of 1 + 0.85 * 4 pages reach links.io; exactly half is not more than half
    assert [got[i] for i in (3, 4, 5, 7)] == ["block", "block", "allow", "allow"]
    trusted = [*pages, ("http://example.com/en/7", '<a href="http://bad.org/1">' * 3), ("http://example.com/en/71", ""), ("http://example.com/en/72", ""), ("http://example.com/en/73", "")]
    assert judged(spark, trusted)[3] == "allow"


def test_pages_elsewhere_do_not_flip_a_host(spark):
    own = [*[(f"http://bad.org/es/{i}", "") for i in range(3)], ("http://bad.org/fr/3", ""), ("http://links.io/1", '<a href="http://bad.org/1">')]
    many = [(f"http://h{i}.com/en/{i}", f'<a href="http://h{(i + 1) % 60}.com/x">' if i % 2 else "") for i in range(60)]
    fine = [(f"http://f{i}.io/{i}", "") for i in range(60)]
    for more in ([], many + fine):
        got = judged(spark, own + more)
        assert [got[3], got[4]] == ["block", "block"]


def test_empty_table_and_plan(spark):
    assert U.judge(spark.createDataFrame([], SCHEMA)).collect() == []
    plan = U.judge(spark.read.parquet("/root/testdata/sf0.001/pages.parquet"))
    assert not re.search("Python|Pandas|Arrow", plan._jdf.queryExecution().executedPlan().toString())
