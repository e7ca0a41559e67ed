import random
import re

import pytest
from pyspark.sql import functions as F

from clientele.llm import jaccard as J
from clientele.llm.shingles import shingle_set
from tests.llm.data import prose, rows, table


def shingles(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4)))


def brute(made, percent=80):
    sets = [shingles(r[1]) for r in made]
    root = list(range(len(made)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(made)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    groups = {}
    for i, r in enumerate(made):
        groups.setdefault(find(i), []).append(r[0])
    low = {g: min((x for x in ids if x is not None), default=None) for g, ids in groups.items()}
    return sorted(((r[0], len(sets[i]), low[find(i)]) for i, r in enumerate(made)), key=str)


def got(spark, made, percent=80):
    members, _ = J.jaccard_join(spark.createDataFrame([(r[0], r[1]) for r in made], "doc_id long, text string"), percent=percent)
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in members.collect()), key=str)


def near_copies(seed, n=160):
    """Chains and stars of near copies of all sizes, and short texts around every threshold."""
    rnd = random.Random(seed)
    made = []
    for i in range(n):
        if made and rnd.random() < 0.6:
            words = rnd.choice(made)[1].split()
            for _ in range(rnd.randint(0, 2)):
                at = rnd.randint(0, max(0, len(words) - 1))
                words[at : at + rnd.randint(0, 1)] = [prose(rnd, 1)] * rnd.randint(0, 2)
            made.append((i, " ".join(words)))
        else:
            made.append((i, prose(rnd, rnd.choice([4, 5, 6, 8, 9, 10, 13, 20, 40, 80, 150]))))
    return made


@pytest.mark.parametrize("seed", [1, 2])
def test_components_equal_brute_force(spark, seed):
    made = near_copies(seed)
    assert got(spark, made) == brute(made)


@pytest.mark.parametrize("boundary", [3, 12, 64])
def test_no_boundary_loses_a_link(spark, monkeypatch, boundary):
    real = J.statistics
    monkeypatch.setattr(J, "statistics", lambda *a: (*real(*a)[:2], boundary))
    made = near_copies(3)
    assert got(spark, made, 70) == brute(made, 70)


def test_awkward_rows(spark):
    made = rows()
    assert got(spark, made) == brute(made)
    members, links = J.jaccard_join(table(spark), also=["key", "row"])
    firsts = members.where("is_first AND n_shingles > 0").groupBy("component_id").count()
    shared = made[6][0]  # two unlinked texts have this id
    assert {r.component_id for r in firsts.where("count > 1").collect()} <= {shared, None}
    assert set(links.columns) == {"class_id", "other_id", "overlap"}


def test_empty_and_wordless_tables(spark):
    assert got(spark, []) == []
    assert got(spark, [(1, None), (2, ""), (2, " ")]) == [(1, 0, 1), (2, 0, 2), (2, 0, 2)]


def test_a_large_group_costs_one_comparison_per_member(spark):
    rnd = random.Random(4)
    base = prose(rnd, 200).split()
    made = [(i, " ".join([*base[:100], f"only{i}", *base[100:]])) for i in range(300)]
    members, links = J.jaccard_join(spark.createDataFrame(made, "doc_id long, text string"))
    assert {r.component_id for r in members.collect()} == {0}
    assert links.count() < 2 * len(made)


def test_every_link_is_counted(spark):
    rnd = random.Random(4)
    base = prose(rnd, 200).split()
    group = [(1000 + i, " ".join([*base[:100], f"only{i}", *base[100:]])) for i in range(100)]
    made = [*near_copies(5, 100), *group, group[0], (None, group[1][1]), (2000, ""), (2001, None), (2002, "one"), (2003, "one")]
    sets = [shingles(r[1]) for r in made]
    want = [(r[0], sum(1 for j, t in enumerate(sets) if j != i and sets[i] and t and 100 * len(sets[i] & t) >= 80 * len(sets[i] | t))) for i, r in enumerate(made)]
    got = J.link_counts(spark.createDataFrame(made, "doc_id long, text string")).collect()
    assert sorted(((r.doc_id, r.n_links) for r in got), key=str) == sorted(want, key=str)
    assert dict(want)[1005] == 101


def test_shingles_are_those_of_the_contract():
    for r in rows():
        assert len(shingle_set(r[1])) == len(shingles(r[1]))
    assert (shingle_set("A b\tC d e") == shingle_set("a B c D\x0be")).all()
    assert (shingle_set("É b c d e") != shingle_set("é b c d e")).all()


def test_bad_percent(spark):
    with pytest.raises(ValueError):
        J.jaccard_join(table(spark, []), percent=30)


def test_hashes_of_other_columns_stay(spark):
    members, _ = J.jaccard_join(table(spark).withColumn("th", F.lit("mine")).drop("th"), also=["size"])
    assert "size" in members.columns


def test_a_group_whose_first_member_is_far_from_most_is_joined_by_few_comparisons(spark, monkeypatch):
    """Copies with a changed word link only to copies changed near by: the first one's links join few of them."""
    words = [f"word{i}" for i in range(60)]
    made = [(100 * at + x, " ".join([*words[:at], f"new{at}x{x}", *words[at + 1 :]])) for at in range(20, 40) for x in range(8)]
    real, counts = J.close_pairs, []

    def counted(*a):
        pairs = real(*a)
        counts.append(pairs.count())
        return pairs

    monkeypatch.setattr(J, "close_pairs", counted)
    assert got(spark, made) == brute(made)
    assert counts[0] < 4 * len(made)  # without the rounds 2,030 pairs of 160 members, with them 246
