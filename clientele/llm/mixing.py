"""Mixing sources to target weights by weighted fair queueing.

Every source is a queue of its documents in a shuffled order that a hash of the document fixes. A
document's virtual finish time is the size its source has sent up to and with it, divided by the
source's target; a source whose target exceeds its size sends its documents again, up to three times.
All queues are merged by finish time, and the merged order is cut where the total budget is reached.
Each queue reaches its own target at time 1, so the cut leaves every source close to its target.

Both orders are cut into pieces (hash ranges within a source, time ranges overall), so neither a
source with a third of all rows nor the merged order is ever sorted in one task; small tables of
piece totals link the pieces.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from clientele.llm.common import n_words, packed, unpacked
from clientele.operators.ordering import settled

WEIGHTS = (1, 2, 3)
MOST = 3  # times a document may be taken
PIECES = 4096


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """Add ``target`` to ``(source, source_size)``, one row per source.

    Weights repeat over the sources by code point, null last. Each source gets its share of the total
    of all sizes, at most ``most`` times its own size; what is cut off is shared among the others by
    weight until none is above. That is one level ``t`` with ``target = min(most * size, t * weight)``:
    with sources in the order of ``most * size / weight``, the first ones that lie below the level
    reached without them are full.
    """
    named = sizes.withColumn("__place", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("__place") - 1) % len(weights) + 1).cast("int"))
    full = F.lit(float(most)) * F.col("source_size")
    ranked = named.withColumn("__w", weight).withColumn("__full", full).withColumn("__at", F.col("__full") / F.col("__w"))
    everything = W.partitionBy()
    before = W.orderBy("__at", "__place").rowsBetween(W.unboundedPreceding, -1)
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum("__full").over(before), F.lit(0.0))) / (
        F.sum("__w").over(everything) - F.coalesce(F.sum("__w").over(before), F.lit(0.0)))
    leveled = ranked.withColumn("__level", level).withColumn("__open", F.col("__at") > F.col("__level"))
    first = F.min(F.when(F.col("__open"), F.struct("__at", "__place", "__level"))).over(everything)
    capped = leveled.withColumn("__level", first["__level"])
    target = F.when(F.col("__open"), F.col("__level") * F.col("__w")).otherwise(F.col("__full"))
    return capped.select("source", "source_size", target.alias("target"))


def _before(df: DataFrame, keys: list[str], piece: str, order: list[Column | str], value: str, out: str) -> DataFrame:
    """Running total of ``value`` before each row of its keys, computed piece by piece."""
    totals = df.groupBy(*keys, piece).agg(F.sum(value).alias("__sum"))
    earlier = W.partitionBy(*keys).orderBy(piece).rowsBetween(W.unboundedPreceding, -1)
    shifts = totals.select(*[F.col(k).alias(f"__k_{k}") for k in keys], F.col(piece).alias("__k_piece"),
                           F.coalesce(F.sum("__sum").over(earlier), F.lit(0)).alias("__shift"))
    inside = W.partitionBy(*keys, piece).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    same = F.col(piece) == F.col("__k_piece")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__k_{k}"))
    placed = df.withColumn("__in", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    return placed.join(shifts, same).withColumn(out, F.col("__in") + F.col("__shift")).drop(
        "__in", "__shift", "__k_piece", *[f"__k_{k}" for k in keys])


def mix(df: DataFrame, text: str = "text", source: str = "source", key: str = "doc_id",
        weights: tuple[float, ...] = WEIGHTS, most: int = MOST, seed: int = 7,
        also: list[str] | None = None) -> DataFrame:
    """``(key, size, source_size, target, taken)`` and ``times``: how often each row is in the mix.

    ``taken`` is ``size`` times ``times``. The document at the cut is taken if more than half of it
    fits; documents without words, and all of them if nothing has words, are taken no times. A null
    source is a source of its own. Rows are told apart by a number given when they are first kept;
    the shuffled order depends on key, size and seed only, and rows equal in all of these are
    interchangeable, so reruns agree. Of the other columns those named in ``also`` stay.
    """
    rows = df.select(F.col(key).alias("key"), F.col(source).cast("string").alias("source"), n_words(F.col(text)).alias("size"), *packed(also or []))
    rows = settled(rows.withColumn("row", F.monotonically_increasing_id()))
    shares = settled(targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most))
    # 52 bits of a hash that any engine can repeat
    mark = F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("key").cast("string"), F.lit("")), F.col("size")))
    shuffled = F.conv(F.substring(mark, 1, 13), 16, 10).cast("long")
    queue = rows.withColumn("shuffled", shuffled).withColumn("piece", F.shiftright("shuffled", 40))
    order = ["shuffled", F.col("key").asc_nulls_last(), "size", "row"]
    queued = _before(queue, ["source"], "piece", order, "size", "sent")
    known = shares.select(F.col("source").alias("__source"), "source_size", "target")
    queued = queued.join(known, F.col("source").eqNullSafe(F.col("__source"))).drop("__source", "piece")
    # pass p sends the whole source before it once more; no pass beyond the target is needed
    passes = F.sequence(F.lit(0), F.greatest(F.lit(0), F.least(F.lit(most - 1), F.ceil(F.col("target") / F.col("source_size")).cast("int") - 1)))
    sent = queued.where(F.col("size") > 0).withColumn("turn", F.explode(passes))
    finish = (F.col("turn") * F.col("source_size") + F.col("sent") + F.col("size")) / F.col("target")
    sent = sent.withColumn("finish", finish).withColumn("__all", F.lit(0))
    # the cut lies near time 1, and equal steps of time hold equal sizes; later times, which only sources
    # with small targets have, are cut into equal steps of their logarithm
    late = PIECES + F.floor(F.log2("finish") * PIECES)
    sent = sent.withColumn("piece", F.when(F.col("finish") < 2, F.floor(F.col("finish") * PIECES)).otherwise(late))
    merged = _before(sent, ["__all"], "piece", ["finish", F.col("source").asc_nulls_last(), *order[:3], "turn", "row"], "size", "total")
    budget = shares.agg(F.coalesce(F.sum("target"), F.lit(0.0)).alias("budget")).scalar()
    fits = F.col("total") + F.col("size") / 2 < budget
    times = merged.where(fits).groupBy("row").agg(F.count(F.lit(1)).alias("times"))
    counted = rows.join(known, F.col("source").eqNullSafe(F.col("__source"))).join(times, "row", "left")
    times = F.coalesce("times", F.lit(0)).cast("int")
    return counted.select(F.col("key").alias(key), "size", "source_size", "target",
                          (F.col("size") * times).cast("long").alias("taken"), times.alias("times"), *unpacked(also or []))
