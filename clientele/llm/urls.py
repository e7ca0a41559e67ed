"""URL filtering by rules and by propagation over the host link graph.

Where no rule fits, the host decides. Hosts of pages that a rule allows are trusted seeds, hosts of
pages that a rule blocks are blocked seeds, both weighted by the number of such pages. Trust flows
from the trusted seeds along links, distrust from the blocked seeds against them: a host that links to
blocked ones is suspect. Both are personalised PageRanks over one row per pair of hosts. Each is divided
by the PageRank of all pages over the same links, which gives the share of blocked (or allowed) pages
among all pages whose weight comes to a host, from 0 to 1. A host is blocked if its share of distrust
exceeds its share of trust by more than ``rate``. Weight stays where no link leads on, so only pages that
reach a host count for it, and no page elsewhere.

Only DataFrame functions are used; every few rounds the scores are written to a table, which cuts the
lineage.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clientele.operators.ordering import settled

DAMPING = 0.85
RATE = 0.5
EVERY = 8
NEAR = 1e-7
DIGITS = 6
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str


# fixed values of the contract
RULES = (
    Rule("block", "com", "/en/"),
    Rule("allow", "example.com", "/en/7"),
    Rule("allow", "net", "/de/"),
    Rule("block", "example.net", "/de/8"),
    Rule("block", "org", "/es/"),
)


def _rest(url: Column) -> Column:
    """What follows the first ``://``; null if there is none."""
    at = F.locate("://", url)
    return F.when(at > 0, F.substr(url, at + 3))


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def fitting(host: Column, path: Column, rules: tuple[Rule, ...]) -> Column:
    """The longest rule that fits, as ``(rule, verdict)``; null if none does."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for r in sorted(rules, key=lambda r: (len(r.host) + len(r.path), len(r.host), r.host, r.path)):
        fits = ((host == r.host) | F.endswith(host, F.lit(f".{r.host}"))) & F.startswith(path, F.lit(r.path))
        out = F.when(fits, F.struct(F.lit(r.host + r.path).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(out)
    return out


def host_edges(pages: DataFrame, host: str, html: str) -> DataFrame:
    """``(source, target, n)``: links between different hosts; relative links stay on their own host."""
    links = F.regexp_extract_all(F.col(html), F.lit(r"""(?i)\bhref\s*=\s*["']?\s*((?:[a-z][a-z0-9+.-]*:)?//[^"'\s>]+)"""), F.lit(1))
    found = pages.where(F.col(html).isNotNull()).select(F.col(host).alias("source"), F.explode(links).alias("link"))
    absolute = F.when(F.startswith("link", F.lit("//")), F.concat(F.lit("http:"), "link")).otherwise(F.col("link"))
    edges = found.select("source", host_of(absolute).alias("target")).where("source <> '' AND target <> '' AND source <> target")
    return edges.groupBy("source", "target").agg(F.count(F.lit(1)).alias("n"))


def ranks(edges: DataFrame, seeds: DataFrame, damping: float = DAMPING, near: float = NEAR) -> DataFrame:
    """``(kind, host, score, part)``: PageRank of each kind, restarting at the seeds in proportion to their weight.

    ``edges``: ``(kind, source, target, n)``, from every host that can be reached; ``seeds``: ``(kind, host,
    weight, part)``, numbers of pages, ``part`` of them marked. Scores are in pages and add up to the weights;
    ``part`` is what the marked pages send. Each round shrinks what is still to come to ``damping`` of what it
    was, so rounds end when all of it together is less than ``near`` of what one page gives its own host,
    at the latest when ``damping`` to the number of rounds is.
    """
    start = settled(seeds.select("kind", "host", F.col("weight").cast("double").alias("weight"), F.col("part").cast("double").alias("part")))
    total = start.agg(F.sum("weight")).first()[0]
    scores = start.select("kind", "host", F.col("weight").alias("score"), "part")
    if not total:
        return scores
    least = near * (1 - damping)
    most = math.ceil(math.log(least / (2 * total)) / math.log(damping))
    out = edges.groupBy("kind", "source").agg(F.sum("n").alias("out"))
    flow = settled(edges.join(out, ["kind", "source"]).select("kind", "source", "target", (F.col("n") / F.col("out")).alias("share")))
    zero = F.lit(0.0)
    kept, at = scores, -1  # the last scores that were written, and their round
    for i in range(most):
        moved = flow.join(scores.withColumnRenamed("host", "source"), ["kind", "source"])
        sums = moved.groupBy("kind", F.col("target").alias("host")).agg(
            F.sum(F.col("score") * F.col("share")).alias("came"), F.sum(F.col("part") * F.col("share")).alias("came_part"))
        both = start.join(sums, ["kind", "host"], "full")
        step = lambda came, own: damping * F.coalesce(came, zero) + (1 - damping) * F.coalesce(own, zero)
        fresh = both.select("kind", "host", step("came", "weight").alias("score"), step("came_part", "part").alias("part"))
        if i % EVERY and i + 1 < most:
            scores = fresh
            continue
        fresh = settled(fresh)
        old = kept.select("kind", "host", F.col("score").alias("old"), F.col("part").alias("old_part"))
        apart = lambda a, b: F.abs(F.coalesce(a, zero) - F.coalesce(b, zero))
        change = fresh.join(old, ["kind", "host"], "full").agg(F.sum(apart("score", "old") + apart("part", "old_part"))).first()[0]
        shrunk = damping ** (i - at)
        scores = kept = fresh
        at = i
        if (change or 0.0) * shrunk < least * (1 - shrunk):
            break
    return scores


def shares(hosts: DataFrame, links: DataFrame) -> DataFrame:
    """``(host, excess)``: share of distrust less share of trust among the weight that comes to each host.

    ``hosts``: ``(host, pages, trust, distrust)`` with numbers of pages; ``links``: ``(source, target, n)``.
    A host without outgoing links gets one to itself, so nothing returns to seeds elsewhere. Shares are
    exact to about ``NEAR`` and rounded to ``DIGITS``, so that ties are told from what exceeds them.
    """
    at = lambda k, a, b: links.select(F.lit(k).alias("kind"), F.col(a).alias("source"), F.col(b).alias("target"), "n")
    ways = at("trust", "source", "target").unionByName(at("distrust", "target", "source"))
    known = hosts.select("host").union(links.select("source")).union(links.select("target")).distinct()
    kinds = F.explode(F.array(F.lit("trust"), F.lit("distrust"))).alias("kind")
    ends = known.select(kinds, F.col("host").alias("source")).join(ways.select("kind", "source"), ["kind", "source"], "left_anti")
    edges = settled(ways.unionByName(ends.select("kind", "source", F.col("source").alias("target"), F.lit(1).cast("long").alias("n"))))
    part = F.when(F.col("kind") == "trust", F.col("trust")).otherwise(F.col("distrust"))
    # the same walk carries all pages and the marked ones among them
    seeds = hosts.select("host", "pages", "trust", "distrust", kinds).select("kind", "host", F.col("pages").alias("weight"), part.alias("part"))
    share = F.try_divide("part", "score") * F.when(F.col("kind") == "trust", -1).otherwise(1)
    excess = ranks(edges, seeds).groupBy("host").agg(F.sum(share).alias("excess"))
    return excess.select("host", F.round(F.coalesce("excess", F.lit(0.0)), DIGITS).alias("excess"))


def judge(pages: DataFrame, rules: tuple[Rule, ...] = RULES, url: str = "url", html: str = "html", rate: float = RATE) -> DataFrame:
    """All columns of ``pages`` but ``html``, plus ``host``, ``path``, ``rule`` and ``verdict``.

    Null urls and those without ``://`` have an empty host and path; no rule and no link reaches an
    empty host, so such pages are allowed. Columns of the new names are replaced. Null ``html`` has no
    links; equal rows are judged alike. An excess of exactly ``rate`` is allowed. Pages of any length are
    searched whole for links; an empty table gives an empty result.
    """
    parsed = pages.withColumn("host", host_of(F.col(url))).withColumn("path", path_of(F.col(url)))
    parsed = parsed.withColumn("__fit", fitting(F.col("host"), F.col("path"), rules))
    named = parsed.where("host <> ''")
    of = lambda v: F.count(F.when(F.col("__fit.verdict") == v, 1))
    hosts = settled(named.groupBy("host").agg(F.count(F.lit(1)).alias("pages"), of("allow").alias("trust"), of("block").alias("distrust")))
    links = settled(host_edges(named, "host", html))
    verdicts = settled(hosts.select("host").join(shares(hosts, links), "host").select("host", (F.col("excess") > rate).alias("__bad")))
    judged = parsed.drop(html).join(verdicts, "host", "left")
    by_host = F.when(F.coalesce("__bad", F.lit(False)), F.lit("block")).otherwise(F.lit("allow"))
    return judged.select(*[c for c in pages.columns if c not in {html, "host", "path", "rule", "verdict"}], "host", "path",
                         F.col("__fit.rule").alias("rule"), F.coalesce("__fit.verdict", by_host).alias("verdict"))
