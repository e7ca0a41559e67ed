"""Deviations hold all users of their day and zone."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

import __spark_entry__ as entry

SCHEMA = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def test_no_user_of_a_cell_is_cut(spark, tmp_path):
    from check_queries import compare

    import duckdb

    start, rows = datetime(2024, 1, 5), []
    # 30 users fail and view alike; the strongest of one kind are the weakest of the other
    for u in range(30):
        for k, (kind, value) in enumerate((("error", u), ("view", 30 - u), ("purchase", 1) if u < 27 else ("click", 1))):
            for again in range(2):
                rows.append((len(rows), start + timedelta(minutes=k, seconds=u + again), u, kind, float(value), '{"k": 3}'))
    rows.append((len(rows), start, 99, "error", 1.0, '{"k": 4}'))
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{tmp_path}/events.parquet/*.parquet')")
    queries, checks = entry.queries(), entry.oracle_sql()
    got = {}
    for name in ("deviation_records_whole", "deviation_pairs_whole", "root_causes_whole"):
        df = queries[name](spark, str(tmp_path))
        got[name] = df.collect()
        assert compare(df, con, checks[name]) == []
    assert sorted(r.n_entities for r in got["deviation_records_whole"]) == [1, 27, 30, 30]
    pairs = {(r.cause[:2], r.effect[:2]): r.entity for r in got["deviation_pairs_whole"]}
    assert pairs == {("S0", "S1"): 1.0, ("S0", "S2"): 0.9, ("S1", "S2"): 0.9}
    assert {(r.node[:2], r.depth, r.entities.count(",") + 1) for r in got["root_causes_whole"]} == {("S0", 0, 30), ("S1", 1, 30), ("S2", 1, 27)}


def cells_with_a_hot_entity(spark, n=240):
    """Deviations of three strata in time, each with one common entity and some of its own neighbourhood."""
    import random

    rnd, cells, members = random.Random(7), [], []
    for i in range(n):
        name, at = f"d{i:03}", datetime(2024, 1, 1) + timedelta(minutes=rnd.randint(0, 6000))
        cells.append((name, f"S{i % 3}", f"m{i % 2}", {"zone": str(i % 4)}, at))
        group = rnd.randint(0, 20)
        own = {f"g{group}-{x}" for x in rnd.sample(range(8), rnd.randint(5, 7) if i % 20 else 0)}
        members += [(name, e) for e in sorted(own | {"everywhere"})]
    return (spark.createDataFrame(cells, "dev_id string, stratum string, metric string, locus map<string,string>, start_ts timestamp_ntz"),
            spark.createDataFrame(members, "dev_id string, entity string"))


def test_prefixes_find_what_the_full_join_finds(spark, monkeypatch):
    from pyspark.sql import functions as F

    from clientele.operators import anomaly as D

    monkeypatch.setattr(D, "MEETING_ROWS", 7)  # lists are cut as well
    cells, members = cells_with_a_hot_entity(spark)
    lists = cells.join(members.groupBy("dev_id").agg(F.collect_list("entity").alias("entities")), "dev_id")
    key = lambda df: sorted((r.cause, r.effect, round(r.score, 9)) for r in df.collect())
    full = key(D.pair_scores(lists, spread_seconds=21_600.0))
    assert key(D.pair_scores(cells, spread_seconds=21_600.0, members=members)) == full
    assert len(full) > 50
    # the entity that all hold pairs only such deviations as hold little else
    sizes = {r.dev_id: r["count"] for r in members.groupBy("dev_id").count().collect()}
    keyed = members.join(cells.select("dev_id", "stratum", F.lit(0).alias("bucket")), "dev_id").join(
        members.groupBy("dev_id").agg(F.count("*").alias("size")), "dev_id")
    met = D._meeting(keyed, 0.21).collect()
    assert len(met) < len(sizes) ** 2 / 12
    apart = [(a, b) for a, b in ((r.cause, r.effect) for r in met) if min(sizes[a], sizes[b]) > 4]
    groups = {r.dev_id: r.entity.split("-")[0] for r in members.where("entity <> 'everywhere'").collect()}
    assert apart and all(groups[a] == groups[b] for a, b in apart)


def test_only_pairs_that_can_reach_the_limit_are_counted(spark, monkeypatch):
    from clientele.operators import anomaly as D

    day = datetime(2024, 1, 1)
    # a and b share all but one of ten; c holds two of theirs, e half of theirs; f holds theirs a day later
    sets = {"a": range(10), "b": range(1, 11), "c": (1, 2), "e": (*range(3, 8), *range(50, 55)), "f": range(11)}
    cells = [(d, f"S{i}", "m", {"zone": "1"}, day + timedelta(minutes=i, hours=23 * (d == "f"))) for i, d in enumerate(sets)]
    cells = spark.createDataFrame(cells, "dev_id string, stratum string, metric string, locus map<string,string>, start_ts timestamp_ntz")
    members = spark.createDataFrame([(d, str(x)) for d, xs in sets.items() for x in xs], "dev_id string, entity string")
    counted, count = [], D._common_entities
    monkeypatch.setattr(D, "_common_entities", lambda pairs, m: counted.append({(r.cause, r.effect) for r in pairs.collect()}) or count(pairs, m))
    got = D.pair_scores(cells, spread_seconds=21_600.0, members=members).collect()
    lists = cells.join(members.groupBy("dev_id").agg(F.collect_list("entity").alias("entities")), "dev_id")
    full = D.pair_scores(lists, spread_seconds=21_600.0).collect()
    assert {(r.cause, r.effect): round(r.score, 9) for r in got} == {(r.cause, r.effect): round(r.score, 9) for r in full}
    assert {(r.cause, r.effect) for r in got} >= {("a", "b")}
    # neither the later nor the small one can reach the limit, whatever they share
    assert all("f" not in p and "c" not in p for p in counted[0])


def test_chains_over_rows(spark):
    from clientele.operators import anomaly as D

    # nine steps, a cycle behind a root, two ways to one node that keep different entities
    edges = [(f"n{i}", f"n{i + 1}") for i in range(9)] + [("r", "c1"), ("c1", "c2"), ("c2", "c1"), ("a", "b1"), ("a", "b2"), ("b1", "z"), ("b2", "z")]
    members = [(f"n{i}", "x") for i in range(10)] + [(f"n{i}", "y") for i in range(5)] + [("r", "k"), ("c1", "k"), ("c2", "k")]
    members += [("a", "p"), ("a", "q"), ("b1", "p"), ("b2", "q"), ("z", "p"), ("z", "q"), ("z", "s"), ("lonely", "x")]
    got = D.chain_entities(spark.createDataFrame(edges, "cause string, effect string"), spark.createDataFrame(members, "node string, entity string"))
    rows = {(r.root, r.node, r.entity): r.depth for r in got.collect()}
    want = {("n0", f"n{i}", "x"): i for i in range(10)} | {("n0", f"n{i}", "y"): i for i in range(5)}
    want |= {("r", "r", "k"): 0, ("r", "c1", "k"): 1, ("r", "c2", "k"): 2, ("a", "a", "p"): 0, ("a", "a", "q"): 0}
    want |= {("a", "b1", "p"): 1, ("a", "b2", "q"): 1, ("a", "z", "p"): 2, ("a", "z", "q"): 2}
    assert rows == want
