"""NULL keys are keys, new keys are reported, and nothing is cut."""

import pytest
from pyspark.sql import functions as F

from clientele.operators import adapter as A
from clientele.operators import anomaly as D
from clientele.operators import governed as V
from clientele.operators import metrics as M
from clientele.operators import ordering as O
from clientele.operators import sessions as N
from clientele.operators import signals as S
from clientele.operators import splits as L
from clientele.streaming import events as E
from tests.conftest import ts


def test_more_than_ten_thousand_sessions(spark):
    df = spark.range(10_002).select(F.lit("u").alias("user_id"), (F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(hours=F.col("id").cast("int"))).alias("event_timestamp"))
    assert N.sessionise(df).select("session_id").distinct().count() == 10_002


def test_events_without_time_or_user_stay(spark):
    rows = [("a", ts("2024-01-01T00:00:00")), ("a", None), (None, ts("2024-01-01T00:00:00"))]
    got = N.sessionise(spark.createDataFrame(rows, "user_id string, event_timestamp timestamp_ntz")).collect()
    assert sorted((r.user_id or "", r.session_id or "") for r in got) == [("", ""), ("a", "a_S0000"), ("a", "a_S0000")]


def test_positions_with_null_keys(spark):
    df = spark.createDataFrame([(None, 1), (None, 2), ("k", 3)], "k string, v int")
    got = O.row_number_in_pieces(df, ["k"], ["v"], F.lit(None).cast("int"), total="n").collect()
    assert sorted((r.k or "", r.v, r.rn, r.n) for r in got) == [("", 1, 1, 2), ("", 2, 2, 2), ("k", 3, 1, 1)]
    assert sorted((r.k or "", r.m) for r in O.quantiles(df, "v", {"m": 0.5}, ["k"]).collect()) == [("", 1.5), ("k", 3.0)]


def test_stratified_split_keeps_rows_without_label(spark):
    df = spark.createDataFrame([(i, "a" if i % 2 else None) for i in range(10)], "id long, label string")
    assert L.stratified_split(df, "label", "id").count() == 10


def test_cohorts_without_category_stay_and_later_events_do_not_count(spark):
    day = [ts("2024-01-03T10:00:00"), ts("2024-02-19T10:00:00")]
    rows = [(1, "u", d, "purchase", 5.0, c, "s") for d in day for c in ("shoes", None)]
    events = spark.createDataFrame(rows, "event_id int, user_id string, event_timestamp timestamp_ntz, event_type string, revenue double, product_category string, session_id string")
    people = spark.createDataFrame([("u", "Female", "Rome", 30)], "user_id string, gender string, city string, age int")
    got = S.micro_signals(events, people, "2024-01-05").collect()
    assert sorted((r.product_category or "", str(r.week_start)) for r in got) == [("", "2024-01-01"), ("shoes", "2024-01-01")]


def test_requests_without_key_or_latency(spark):
    log = spark.createDataFrame([(None, 5.0, "success"), ("a", None, "failed"), ("b", 1.0, "success")], "service string, latency_ms double, status string")
    got = {r.service: (r.requests, r.p50) for r in V.request_roll_up(log, ["service"]).collect()}
    assert got == {None: (1, 5.0), "a": (1, None), "b": (1, 1.0)}


def test_a_cut_answer_is_refused(spark):
    entity = {"e": V.Entity(spark.range(20).withColumn("m", F.col("id")), "id", {}, {"m": "m"}, {})}
    with pytest.raises(PermissionError):
        V.governed_request(entity, {"entity": "e", "metric": "m"}, row_limit=10)
    with pytest.raises(PermissionError):
        V.governed_request(entity, {"entity": "e", "metric": "m", "limit": 11}, row_limit=10)
    assert V.governed_request(entity, {"entity": "e", "metric": "m", "limit": 10}, row_limit=10).count() == 10


def test_metrics_of_a_group_without_key(spark):
    df = spark.createDataFrame([(None, 1, 0.9), (None, 0, 0.1), ("g", 1, 0.2), ("g", 0, 0.1)], "g string, label int, score double")
    assert {r.g for r in M.classification_metrics(df, keys=["g"]).collect()} == {None, "g"}


def test_new_keys_and_constant_baselines_deviate(spark):
    base = spark.createDataFrame([("a", 1.0), ("a", 1.0), (None, 2.0), (None, 4.0)], "k string, v double")
    now = spark.createDataFrame([("a", 100.0), ("a", 1.0), (None, 3.0), ("new", 5.0)], "k string, v double")
    got = sorted((r.k or "", r.v, r.deviates, r.no_baseline) for r in D.robust_scores(base, now, "v", ["k"]).collect())
    assert got == [("", 3.0, False, False), ("a", 1.0, False, False), ("a", 100.0, True, False), ("new", 5.0, False, True)]
    psi = {r.k: r.shifted for r in D.stability_index(base, now, "v", ["k"]).collect()}
    assert set(psi) == {"a", None, "new"} and psi["new"]


def test_long_chains_and_cycles_end(spark):
    edges = [(f"n{i}", f"n{i + 1}") for i in range(9)] + [("n5", "n3")]
    nodes = spark.createDataFrame([(f"n{i}", ["e", f"x{i}"]) for i in range(10)], "node string, entities array<string>")
    got = D.root_causes(spark.createDataFrame(edges, "cause string, effect string"), nodes).collect()
    assert max(r.depth for r in got) == 9 and {r.node for r in got} == {f"n{i}" for i in range(10)}


def test_equal_causes_are_both_missing(spark):
    causes = spark.createDataFrame([("u", ts("2024-01-01T00:00:00"))] * 2, "u string, t timestamp_ntz")
    effects = spark.createDataFrame([("w", ts("2024-01-01T00:10:00"))], "u string, t timestamp_ntz")
    assert D.missing_responses(causes, effects, "u", "t", 3600).count() == 2


def test_orders_that_share_eight_letters_keep_their_names():
    assert "short_ids" in A.journey_events.__code__.co_varnames


def test_open_sessions_of_events_without_user_stay(spark):
    times = [ts("2024-01-01T00:00:00"), ts("2024-01-01T09:00:00"), ts("2024-01-01T09:10:00")]
    events = spark.createDataFrame([(u, t) for u in (None, "a") for t in times], "user_id string, event_timestamp timestamp_ntz")
    done = E.sessions(events).where("started < '2024-01-01 06:00:00'")
    got = E.open_sessions(events, done).collect()
    assert sorted((r.user_id or "", r.events) for r in got) == [("", 2), ("a", 2)]
