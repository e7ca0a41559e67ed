"""Streams equal their batch forms, with one user that holds a third of the rows and several micro-batches."""

import datetime as dt
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clientele.operators import sliding
from clientele.operators.sessions import sessionise
from clientele.streaming import deviations as V
from clientele.streaming import events as E
from clientele.streaming import weekly as K
from tests.test_sliding import plain

SCHEMA = "event_id long, user_id string, event_timestamp timestamp_ntz, event_type string, revenue double, c string, d int"
START = dt.datetime(2024, 1, 1)
STORE = "spark.sql.streaming.stateStore.providerClass"


def log(seed=1, n=1500, days=24):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        user = "hot" if i % 3 == 0 else rnd.choice(["u", "v", "w", None])
        at = START + dt.timedelta(minutes=rnd.randint(0, days * 1440 // 5) * 5, seconds=rnd.choice([0, 0, 1]))
        rows.append((i, user, at, rnd.choice(["purchase", "page_view", "add_to_cart", "signup"]), float(i % 7), rnd.choice(["a", "b", None]), i % 2))
    # a gap of exactly half an hour joins, one second more parts; a session over midnight of a week's end
    edge = [0, 1800, 3601, 5401, 7202]
    rows += [(n + i, "edge", dt.datetime(2024, 1, 7, 22, 30) + dt.timedelta(seconds=s), "page_view", 1.0, "a", 0) for i, s in enumerate(edge)]
    return rows


@pytest.fixture(scope="module")
def arrived(spark, tmp_path_factory):
    base = str(tmp_path_factory.mktemp("events"))
    events = spark.createDataFrame(log(), SCHEMA)
    day = F.dayofyear("event_timestamp")
    for k in range(4):
        # the second file begins with rows that the first one's end overlaps by less than the lateness
        events.where((day > 6 * k) & (day <= 6 * k + 6)).coalesce(1).write.mode("append").parquet(f"{base}/in")
    return base, events


def stream(spark, base, events):
    return E.read_events(spark, f"{base}/in", events.schema, files_per_trigger=1)


def again(spark, table, path):
    return spark.readStream.schema(table.schema).parquet(path)


def expected_sessions(rows):
    by = {}
    for _, user, at, *_ in rows:
        by.setdefault(user, []).append(at)
    out = []
    for user, times in by.items():
        times.sort()
        start, last, n = times[0], times[0], 0
        for t in times:
            if (t - last).total_seconds() > 1800:
                out.append((user or "", start, last, n))
                start, n = t, 0
            last, n = t, n + 1
        out.append((user or "", start, last, n))
    return sorted(out)


def test_sessions_merged_from_fragments(spark, arrived, tmp_path):
    base, events = arrived
    parts = K.fragments(stream(spark, base, events), ["user_id"])
    E.run_once(parts, f"{tmp_path}/parts", f"{tmp_path}/s1")
    kept = spark.read.schema(parts.schema).parquet(f"{tmp_path}/parts")
    hot = kept.where("user_id = 'hot'")
    # the hot user's rows are spread over as many keys as windows, and merged within each
    assert hot.count() == hot.select("start").distinct().count() > 300
    merged = K.merged_sessions(again(spark, kept, f"{tmp_path}/parts"))
    E.run_once(merged, f"{tmp_path}/out", f"{tmp_path}/s2")
    done = spark.read.schema(merged.schema).parquet(f"{tmp_path}/out")
    rest = E.sessions(K.open_events(events, done))
    got = done.unionByName(rest).select("user_id", "started", "ended", "events").collect()
    assert sorted((r.user_id or "", r.started, r.ended, r.events) for r in got) == expected_sessions(log())
    assert done.count() > 400


def test_fragments_longer_than_the_gap_are_refused(spark, arrived):
    base, events = arrived
    with pytest.raises(ValueError, match="longer"):
        K.merged_sessions(events, piece="40 minutes")


def expected_weeks(spark, events):
    named = sessionise(events.withColumn("user_id", F.coalesce("user_id", F.lit("?"))), out="s")
    view, bought = F.col("event_type") == "page_view", F.col("event_type") == "purchase"
    week = F.date_sub(F.to_date("event_timestamp"), F.weekday("event_timestamp"))
    return named.groupBy("c", "d", week.alias("week_start")).agg(
        F.count_if(bought).alias("purchase_count"), F.count_if(view).alias("page_views"), F.count_if(F.col("event_type") == "add_to_cart").alias("add_to_cart_events"),
        F.count(F.lit(1)).alias("events"), F.sum(F.when(bought, F.col("revenue")).otherwise(0.0)).alias("total_revenue"),
        F.countDistinct(F.when(view, F.col("s"))).alias("sessions"), F.countDistinct(F.when(bought, F.col("user_id"))).alias("purchasers"),
        F.countDistinct("user_id").alias("active_users"))


def weeks(df):
    return sorted(tuple(str(r[c]) for c in sorted(df.columns)) for r in df.collect())


def test_exact_weekly_measures(spark, arrived, tmp_path):
    base, events = arrived
    by = ["user_id", "c", "d"]
    spark.conf.set(STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        parts = K.fragments(stream(spark, base, events), by)
        E.run_once(parts, f"{tmp_path}/parts", f"{tmp_path}/s1")
        kept = spark.read.schema(parts.schema).parquet(f"{tmp_path}/parts")
        rows = K.weeks_of_users(again(spark, kept, f"{tmp_path}/parts").repartition(3), by)
        E.run_once(rows, f"{tmp_path}/out", f"{tmp_path}/s2")
    finally:
        spark.conf.unset(STORE)
    done = K.weekly_of_users(spark.read.schema(rows.schema).parquet(f"{tmp_path}/out"), ["c", "d"])
    assert done.select("week_start").distinct().count() == 3
    whole = done.unionByName(K.open_weeks(events, done, by))
    assert weeks(whole) == weeks(expected_weeks(spark, events))


def test_sliding_scores_by_micro_batch(spark, tmp_path):
    rnd = random.Random(3)
    rows = []
    for i in range(600):
        at = START + dt.timedelta(minutes=rnd.randint(0, 60 * 1440))
        rows.append((i, "hot" if i % 3 else rnd.choice(["a", None]), at, rnd.choice([float(rnd.randint(0, 30)), None, 5.5])))
    rows += [(900, "hot", None, 3.0)]
    schema = "id long, k string, at timestamp_ntz, v double"
    df = spark.createDataFrame(rows, schema)
    day = F.coalesce(F.datediff("at", F.lit("2024-01-01")), F.lit(0))
    for k in range(3):
        df.where((day >= 21 * k) & (day < 21 * k + 21)).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    scores = V.SlidingScores(spark, f"{tmp_path}/out", "v", "at", ["k"])
    scores.run(E.read_events(spark, f"{tmp_path}/in", schema, files_per_trigger=1), f"{tmp_path}/state")
    done = scores.scores()
    assert 300 < done.count() < 601
    whole = plain(sliding.sliding_scores(df, "v", "at", ["k"]))
    assert plain(done.unionByName(scores.still_open())) == whole
    # a batch that is run again replaces its own output
    again = spark.read.schema(schema).parquet(f"{tmp_path}/out/rows/__batch=1").select("id", "k", "at", "v").collect()
    scores.add(spark.createDataFrame(again, schema), 1)
    assert plain(scores.scores().unionByName(scores.still_open())) == whole


class Held:
    """A state that counts the calls to it."""

    def __init__(self, calls):
        self.calls, self.rows = calls, {}

    def __getattr__(self, name):
        def call(*args):
            self.calls.append(name)
            if name in ("exists", "containsKey"):
                return False
            return iter(()) if name in ("get", "iterator") else None

        return call


class Handle:
    def __init__(self):
        self.calls, self.timers = [], []
        self.getMapState = self.getListState = self.getValueState = lambda *_: Held(self.calls)

    def listTimers(self):
        return iter(self.timers)

    def deleteTimer(self, t):
        self.timers.remove(t)

    def registerTimer(self, t):
        self.timers.append(t)


def test_fragments_of_many_days_take_one_call_to_the_state():
    days = pd.date_range("2024-01-01", periods=60, freq="D")
    part = pd.DataFrame({"user_id": "a", "c": ["x", None] * 30, "start": days, "first": days, "last": days, "purchase_count": 0, "page_views": 1,
                         "add_to_cart_events": 0, "events": 1, "total_revenue": 0.0})
    weeks, handle = K.WeeksOfUser(["user_id", "c"], T.StructType([])), Handle()
    weeks.init(handle)
    assert list(weeks.handleInputRows(("a",), iter([part]), None)) == []
    assert len(handle.calls) == 1  # one round trip, not two for each day
    assert handle.timers == [int(days[0].timestamp() * 1000) + 600_000]
