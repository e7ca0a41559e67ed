"""Median and MAD over each row's own 30 days, against a plain recomputation."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from clientele.operators import sliding as S

SCHEMA = "id long, k string, at timestamp_ntz, v double"
FIRST = dt.datetime(2024, 1, 1)


def rows(seed=2, n=900, days=120, hot=0.6):
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        k = "hot" if rnd.random() < hot else rnd.choice(["a", "b", None])
        at = FIRST + dt.timedelta(days=rnd.randint(0, days), seconds=rnd.randint(0, 86399))
        v = rnd.choice([round(rnd.gauss(50, 20), 2), 50.0, float(rnd.randint(0, 9))])
        out.append((i, k, at, v))
    out += [(n, "hot", None, 1.0), (n + 1, "hot", FIRST, None), (n + 2, "new", FIRST + dt.timedelta(days=50), 3.0), (n + 3, None, None, None)]
    out += [(n + 4 + i, "flat", FIRST + dt.timedelta(days=i), 7.0 if i < 9 else 8.0) for i in range(10)]
    return out


def brute(made, days=30):
    out = []
    for i, k, at, v in made:
        base = [] if at is None else [
            y for _, l, b, y in made if l == k and b is not None and y is not None and 0 < (at.date() - b.date()).days <= days]
        if not base:
            out.append((i, 0, None, None, None, False, True))
            continue
        median = float(np.median(base))
        mad = float(np.median(np.abs(np.array(base) - median)))
        away = None if v is None else abs(v - median)
        z = None if away is None or mad == 0 else away / mad
        deviates = away is not None and (away > 0 if mad == 0 else round(z, 9) > 4.0)
        out.append((i, len(base), round(median, 6), round(mad, 6), None if z is None else round(z, 6), deviates, False))
    return sorted(out)


def plain(df):
    six = lambda x: None if x is None else round(x, 6)
    return sorted((r.id, r.baseline_rows, six(r["median"]), six(r.mad), six(r.z), r.deviates, r.no_baseline) for r in df.collect())


@pytest.mark.parametrize("piece_rows", [65_536, 40])
def test_equals_plain_recomputation_with_a_hot_key(spark, piece_rows):
    made = rows()
    df = spark.createDataFrame(made, SCHEMA).repartition(7)
    assert plain(S.sliding_scores(df, "v", "at", ["k"], piece_rows=piece_rows)) == brute(made)


def test_shorter_range_and_no_key(spark):
    made = [(i, None, at, v) for i, _, at, v in rows(5, 200)]
    df = spark.createDataFrame(made, SCHEMA)
    assert plain(S.sliding_scores(df, "v", "at", days=7, piece_rows=25)) == brute(made, 7)


def test_only_pieces_near_the_middle_meet(spark):
    """Of a large key few counts reach the units: the pieces that can hold the middle ranks."""
    df = spark.range(20_000).select(F.lit("k").alias("k"), F.lit(FIRST).cast("timestamp_ntz").alias("first"), "id")
    df = df.select("k", (F.col("first") + F.make_dt_interval(F.col("id").cast("int") % 60)).alias("at"), (F.col("id") * 7919 % 20_000).cast("double").alias("v"))
    counts = S.settled(S.with_value_piece(S.settled(S.day_counts(df, "v", "at", ["k"])), "value", ["k"], 500, "piece"))
    targets = counts.select("k", "day").distinct()
    spans = S._spans(counts, targets, ["k"], 30)
    assert spans.select("piece").distinct().count() >= 40
    near = spans.where("day > 19760").groupBy("day").agg(F.sum("n").alias("n"), F.count("piece").alias("p")).collect()
    assert all(r.p >= 40 for r in near)
    got = S.sliding_baselines(S.day_counts(df, "v", "at", ["k"]), targets, ["k"], piece_rows=500)
    values = {r.day: (r["median"], r.mad) for r in got.collect()}
    rows = df.select(F.unix_date(F.to_date("at")).alias("d"), "v").collect()
    for day in sorted(values)[5::13]:
        base = np.array([r.v for r in rows if day - 30 <= r.d < day])
        median = float(np.median(base))
        assert values[day] == (median, float(np.median(np.abs(base - median))))


def test_empty_table(spark):
    assert S.sliding_scores(spark.createDataFrame([], SCHEMA), "v", "at", ["k"]).collect() == []
