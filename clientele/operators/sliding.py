"""Median and MAD over a sliding range of days, exact, without a large key in one task.

Rows are counted by day and value. A large key's values are cut into pieces; how many rows of a piece
lie in the days before a target day, and between which bounds, is one RANGE window over a small table.
From these counts follow the few pieces that can hold the wanted ranks, for the value itself and, once
the median is known, for the distance from it. Only counts of those pieces meet, in units of a key and a
block of days; there a vector of counts slides over the days, each day's counts added and later taken away.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clientele.operators.anomaly import Z_LIMIT
from clientele.operators.ordering import PIECE_ROWS, join_keys, settled, with_value_piece

DAYS = 30


def day_counts(rows: DataFrame, value: str, time: str, keys: Sequence[str] = ()) -> DataFrame:
    """``(keys, day, value, n)``; day is a day number. Rows without a time or a value count nowhere."""
    day = F.unix_date(F.to_date(F.col(time)))
    known = rows.where(F.col(time).isNotNull() & F.col(value).isNotNull())
    return known.groupBy(*keys, day.alias("day"), F.col(value).cast("double").alias("value")).agg(F.count(F.lit(1)).alias("n"))


def _spans(pieced: DataFrame, targets: DataFrame, by: list[str], days: int) -> DataFrame:
    """``(by, day, piece, n, low, high)``: what the ``days`` days before each target day hold of each piece."""
    daily = pieced.groupBy(*by, "piece", "day").agg(F.sum("n").alias("n"), F.min("value").alias("low"), F.max("value").alias("high"))
    asked = join_keys(daily.select(*by, "piece").distinct(), targets, by)
    none = F.lit(None).cast("double")
    both = daily.withColumn("asked", F.lit(False)).unionByName(
        asked.select(*by, "piece", "day", F.lit(None).cast("long").alias("n"), none.alias("low"), none.alias("high"), F.lit(True).alias("asked")))
    before = W.partitionBy(*by, "piece").orderBy("day").rangeBetween(-days, -1)
    held = both.select(*by, "piece", "day", "asked", F.sum("n").over(before).alias("n"),
                       F.min("low").over(before).alias("low"), F.max("high").over(before).alias("high"))
    return held.where(F.col("asked") & F.col("n").isNotNull()).drop("asked")


def _middles(pieced: DataFrame, spans: DataFrame, by: list[str], days: int, center: DataFrame | None, out: str) -> DataFrame:
    """The median of a measure per ``(by, day)``: the value, or its distance from ``center``.

    ``spans`` gives for each piece the rows in range and the bounds of the measure. The wanted ranks lie
    at or above ``a``, the first lower bound up to which enough rows could lie, and at or below ``b``, the
    first upper bound up to which enough rows do lie. Pieces wholly below ``a`` only count.
    """
    of = [*by, "day"]
    group = W.partitionBy(*of)
    upto = lambda c: F.sum("n").over(group.orderBy(c).rangeBetween(W.unboundedPreceding, W.currentRow))
    ranked = spans.withColumns({"total": F.sum("n").over(group), "could": upto("low"), "do": upto("high")})
    first, last = F.floor((F.col("total") - 1) / 2), F.floor(F.col("total") / 2)
    a = F.min(F.when(F.col("could") > first, F.col("low"))).over(group)
    b = F.min(F.when(F.col("do") > last, F.col("high"))).over(group)
    ranked = ranked.withColumns({"first": first.cast("long"), "last": last.cast("long"), "a": a, "b": b})
    met = (F.col("high") >= F.col("a")) & (F.col("low") <= F.col("b"))
    asked = ranked.groupBy(*of, "total", "first", "last").agg(
        F.coalesce(F.sum(F.when(F.col("high") < F.col("a"), F.col("n"))), F.lit(0)).alias("below"),
        F.collect_list(F.when(met, F.col("piece"))).alias("pieces"))
    asked = asked.withColumn("block", F.floor(F.col("day") / days))
    if center is not None:
        asked = join_keys(asked, center, of)
    else:
        asked = asked.withColumn("center", F.lit(None).cast("double"))
    asked = settled(asked)
    wanted = asked.select(*by, "block", F.explode("pieces").alias("piece")).distinct()
    # a day stands before the target days of one or two blocks
    blocks = F.array_distinct(F.array(F.floor((F.col("day") + 1) / days), F.floor((F.col("day") + days) / days)))
    sent = join_keys(pieced.withColumn("block", F.explode(blocks)), wanted, [*by, "block", "piece"], "left_semi")
    keyed = [F.coalesce(F.to_json(F.struct(*by)), F.lit("")).alias("unit"), "block"]
    schema = T.StructType([asked.schema[c] for c in of] + [T.StructField(out, T.DoubleType()), T.StructField("total", T.LongType())])

    def slide(counts: pd.DataFrame, targets: pd.DataFrame) -> pd.DataFrame:
        counts, targets = counts.sort_values("day"), targets.sort_values("day")
        values, at = np.unique(counts["value"].to_numpy(), return_inverse=True)
        piece_of = np.zeros(len(values), np.int64)
        piece_of[at] = counts["piece"].to_numpy()
        day, n = counts["day"].to_numpy(), counts["n"].to_numpy()
        held, start, end, found = np.zeros(len(values), np.int64), 0, 0, []
        for t in targets.itertuples(index=False):
            to, gone = np.searchsorted(day, [t.day, t.day - days])
            np.add.at(held, at[end:to], n[end:to])
            np.subtract.at(held, at[start:gone], n[start:gone])
            start, end = gone, to
            here = np.flatnonzero((held > 0) & np.isin(piece_of, t.pieces))
            measure = values[here] if np.isnan(t.center) else np.abs(values[here] - t.center)
            order = np.argsort(measure, kind="stable")
            upto = t.below + np.cumsum(held[here][order])
            low, high = measure[order][np.searchsorted(upto, [t.first, t.last], side="right")]
            found.append(low + (high - low) * 0.5)
        return targets.assign(**{out: found})[[*of, out, "total"]]

    units = sent.select(*keyed, "day", "value", "n", "piece").groupBy("unit", "block")
    return units.cogroup(asked.select(*keyed[:1], "*").groupBy("unit", "block")).applyInPandas(
        lambda counts, targets: slide(counts, targets) if len(targets) else pd.DataFrame(columns=[f.name for f in schema]), schema)


def sliding_baselines(counts: DataFrame, targets: DataFrame, keys: Sequence[str] = (), days: int = DAYS,
                      piece_rows: int = PIECE_ROWS) -> DataFrame:
    """``(keys, day, median, mad, baseline_rows)`` for each ``(keys, day)`` of ``targets`` with a baseline.

    The baseline of a day are its key's rows of the ``days`` calendar days before it, as ``day_counts``
    counts them; the day itself does not count. Medians interpolate between the two middle values and
    are exact. NULL is a key; NaN is the largest value.
    """
    by = list(keys) or ["__all"]
    if not keys:
        counts, targets = counts.withColumn("__all", F.lit(1)), targets.withColumn("__all", F.lit(1))
    pieced = with_value_piece(settled(counts), "value", by, piece_rows, "piece")
    spans = settled(_spans(pieced, targets.select(*by, "day").distinct(), by, days))
    medians = settled(_middles(pieced, spans, by, days, None, "median"))
    center = medians.select(*by, "day", F.col("median").alias("center"))
    near = F.greatest(F.lit(0.0), F.col("low") - F.col("center"), F.col("center") - F.col("high"))
    far = F.greatest(F.abs(F.col("low") - F.col("center")), F.abs(F.col("high") - F.col("center")))
    apart = join_keys(spans, center, [*by, "day"]).select(*by, "day", "piece", "n", near.alias("low"), far.alias("high"))
    mads = _middles(pieced, apart, by, days, center, "mad")
    both = join_keys(medians, mads.drop("total"), [*by, "day"])
    return both.select(*keys, "day", "median", "mad", F.col("total").alias("baseline_rows"))


def scored(rows: DataFrame, baselines: DataFrame, value: str, time: str, keys: Sequence[str] = (), limit: float = Z_LIMIT) -> DataFrame:
    """Rows with the median, MAD and size of their baseline, ``z``, ``deviates`` and ``no_baseline``.

    Any difference from a constant baseline deviates (``z`` is NULL there); a row without a value, a time
    or a baseline does not.
    """
    dated = rows.withColumn("__day", F.unix_date(F.to_date(F.col(time))))
    joined = join_keys(dated, baselines.withColumnRenamed("day", "__day"), [*keys, "__day"], "left").drop("__day")
    away = F.abs(F.col(value) - F.col("median"))
    beyond: Column = F.when(F.col("mad") == 0, away > 0).otherwise(F.round("z", 9) > limit)
    return joined.withColumn("baseline_rows", F.coalesce("baseline_rows", F.lit(0))).withColumn("z", F.try_divide(away, F.col("mad"))).withColumns(
        {"deviates": F.coalesce(beyond, F.lit(False)), "no_baseline": F.col("median").isNull()})


def sliding_scores(rows: DataFrame, value: str, time: str, keys: Sequence[str] = (), days: int = DAYS, limit: float = Z_LIMIT,
                   piece_rows: int = PIECE_ROWS) -> DataFrame:
    """``|x - median| / MAD`` of every row against the ``days`` days of its key before its own day."""
    targets = rows.where(F.col(time).isNotNull()).select(*keys, F.unix_date(F.to_date(F.col(time))).alias("day")).distinct()
    baselines = sliding_baselines(day_counts(rows, value, time, keys), targets, keys, days, piece_rows)
    return scored(rows, baselines, value, time, keys, limit)
