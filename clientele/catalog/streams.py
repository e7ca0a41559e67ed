"""The streaming forms over the event table as closed input."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clientele.catalog import query
from clientele.catalog.anomaly import SLIDING_SQL
from clientele.catalog.common import comparable, sql_round
from clientele.catalog.signals import ASOF, SIGNAL_OUT, WEEKLY_SQL
from clientele.operators import signals as S
from clientele.operators.ordering import settled, work_dir
from clientele.sources import star
from clientele.streaming import deviations as V
from clientele.streaming import events as T
from clientele.streaming import weekly as K

SCHEMA = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"
STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
ARRIVALS = 4


@contextmanager
def _folder(spark: SparkSession, name: str) -> Iterator[str]:
    """A new folder in the shared work folder, deleted afterwards; results are settled before that."""
    path = f"{work_dir(spark)}/{name}-{uuid.uuid4().hex}"
    yield path
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def _arriving(spark: SparkSession, root: str, base: str) -> DataFrame:
    """The events as they come: in files by equal ranges of time, one file group per micro-batch."""
    events = spark.read.parquet(f"{root}/events.parquet")
    first, last = events.agg(F.min("ts"), F.max("ts")).first()
    at = F.width_bucket(F.unix_micros(F.col("ts").cast("timestamp")).cast("double"), *[
        F.unix_micros(F.lit(x).cast("timestamp")).cast("double") for x in (first, last)], F.lit(ARRIVALS))
    part = F.least(F.coalesce(at, F.lit(1)), F.lit(ARRIVALS)).cast("int")
    for n in range(1, ARRIVALS + 1):
        events.where(part == n).coalesce(1).write.mode("append").parquet(f"{base}/in")
    return T.read_events(spark, f"{base}/in", SCHEMA, files_per_trigger=1)


def _run(spark: SparkSession, stream: DataFrame, base: str, step: str) -> DataFrame:
    T.run_once(stream, f"{base}/{step}", f"{base}/state-{step}")
    return spark.read.schema(stream.schema).parquet(f"{base}/{step}")


def _again(spark: SparkSession, table: DataFrame, base: str, step: str) -> DataFrame:
    """What one step wrote, as the stream of the next."""
    return spark.readStream.schema(table.schema).parquet(f"{base}/{step}")


@query(
    "streamed_sessions",
    """WITH g AS (SELECT *, CASE WHEN epoch_us(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts)) > 1800000000 THEN 1 ELSE 0 END AS fresh FROM events),
    s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS sid FROM g),
    f AS (SELECT user_id, min(ts) AS a, max(ts) AS b, count(*) AS events FROM s GROUP BY user_id, sid)
    SELECT user_id, strftime(a, '%Y-%m-%d %H:%M:%S') AS started, strftime(b, '%Y-%m-%d %H:%M:%S') AS ended, events FROM f""",
)
def streamed_sessions(spark: SparkSession, root: str) -> DataFrame:
    """Sessions merged from fragments by the stream, and those still open when its input ends."""
    with _folder(spark, "sessions") as base:
        stream = _arriving(spark, root, base).withColumnsRenamed({"ts": "event_timestamp", "value": "revenue"})
        parts = _run(spark, K.fragments(stream, ["user_id"]), base, "parts")
        done = _run(spark, K.merged_sessions(_again(spark, parts, base, "parts")), base, "sessions")
        events = spark.read.parquet(f"{root}/events.parquet")
        rest = T.sessions(K.open_events(events, done, time="ts"), time="ts")
        return settled(comparable(done.unionByName(rest)))


def _weeks(spark: SparkSession, root: str, enriched, cohort: list[str]) -> DataFrame:
    """Weekly measures: finished weeks from the stream, the others from the batch form of the same events."""
    by = ["user_id", *cohort]
    before = spark.conf.get(STORE, None)
    spark.conf.set(STORE, ROCKS)
    try:
        with _folder(spark, "weeks") as base:
            parts = _run(spark, K.fragments(enriched(_arriving(spark, root, base)), by), base, "parts")
            users = _run(spark, K.weeks_of_users(_again(spark, parts, base, "parts"), by), base, "weeks")
            done = K.weekly_of_users(users, cohort)
            rest = K.open_weeks(enriched(spark.read.parquet(f"{root}/events.parquet")), done, by)
            return settled(done.unionByName(rest))
    finally:
        spark.conf.unset(STORE) if before is None else spark.conf.set(STORE, before)


@query(
    "streamed_weekly_counts",
    f"""WITH s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS sid FROM (SELECT *,
        CASE WHEN epoch_us(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts)) > 1800000000 THEN 1 ELSE 0 END AS fresh FROM events)),
    w AS (SELECT event_type AS cohort, CAST(date_trunc('week', ts) AS DATE) AS week_start, count(*) FILTER (WHERE event_type = 'purchase') AS purchase_count,
        coalesce(sum("value") FILTER (WHERE event_type = 'purchase'), 0) AS rev, count(*) FILTER (WHERE event_type = 'view') AS page_views,
        count(*) FILTER (WHERE event_type = 'click') AS add_to_cart_events, count(*) AS events,
        count(DISTINCT CASE WHEN event_type = 'view' THEN user_id || ':' || sid END) AS sessions,
        count(DISTINCT CASE WHEN event_type = 'purchase' THEN user_id END) AS purchasers, count(DISTINCT user_id) AS active_users FROM s GROUP BY 1, 2)
    SELECT cohort, strftime(week_start, '%Y-%m-%d') AS week_start, purchase_count, {sql_round('rev', 2)} AS total_revenue, page_views, add_to_cart_events,
      events, sessions, purchasers, active_users FROM w""",
)
def streamed_weekly_counts(spark: SparkSession, root: str) -> DataFrame:
    """Weeks per event kind, with exact users, purchasers and sessions."""
    kind = F.col("event_type")

    def enriched(events: DataFrame) -> DataFrame:
        return events.select(
            "user_id", F.col("ts").alias("event_timestamp"), kind.alias("cohort"), F.col("value").alias("revenue"),
            F.when(kind == "view", "page_view").when(kind == "click", "add_to_cart").otherwise(kind).alias("event_type"),
        )

    return comparable(_weeks(spark, root, enriched, ["cohort"]), 2)


ALL_WEEKS_SQL = WEEKLY_SQL.replace(f"WHERE ts >= DATE '{ASOF}' - INTERVAL 56 DAY AND ts < DATE '{ASOF}' + INTERVAL 1 DAY", "").replace(
    f"WHERE week_start >= DATE '{ASOF}' - INTERVAL 28 DAY", "")


@query("streamed_weekly_signals", f"WITH {ALL_WEEKS_SQL} SELECT {SIGNAL_OUT} FROM signal")
def streamed_weekly_signals(spark: SparkSession, root: str) -> DataFrame:
    """All measures of the weekly cohorts, with trends, from the stream; profiles and products join as tables."""
    people = star.user_profiles(spark, root)

    def enriched(events: DataFrame) -> DataFrame:
        return S.with_profiles(star.with_categories(spark, root, events), people)

    return comparable(S.with_trends(_weeks(spark, root, enriched, list(S.COHORT)).drop("events")))


@query("streamed_deviations", SLIDING_SQL)
def streamed_deviations(spark: SparkSession, root: str) -> DataFrame:
    """Every event against its own 30 days, micro-batch by micro-batch."""
    with _folder(spark, "deviations") as base:
        scores = V.SlidingScores(spark, f"{base}/scored", "value", "ts", ["event_type"])
        scores.run(_arriving(spark, root, base), f"{base}/state")
        both = scores.scores().unionByName(scores.still_open())
        return settled(comparable(both.select("event_id", "baseline_rows", "median", "mad", "z", "deviates", "no_baseline")))
