"""Sessions from event gaps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from clientele.functions.timeutil import seconds_between
from clientele.operators.ordering import join_keys


def sessionise(
    events: DataFrame, user: str = "user_id", time: str = "event_timestamp", gap_seconds: int = 1800, out: str = "session_id"
) -> DataFrame:
    """Adds ``<user>_S<nnnn>``, four digits at least; a gap of more than ``gap_seconds`` opens the next session.

    Events without a time belong to the first session of their user; events without a user keep no label.

    A user's hours are handled separately and linked through one row per (user, hour), so a very
    active user is spread over many tasks.
    """
    hour = F.date_trunc("hour", time)
    cut = events.withColumn("__hour", hour)
    hours = cut.groupBy(user, "__hour").agg(F.min(time).alias("__from"), F.max(time).alias("__to"))
    by_hour = W.partitionBy(user).orderBy("__hour")
    gap = seconds_between(F.lag("__to").over(by_hour), F.col("__from"))
    entries = hours.select(user, "__hour", F.coalesce((gap > gap_seconds).cast("int"), F.lit(0)).alias("__entry"))

    inside = W.partitionBy(user, "__hour").orderBy(time)
    step = seconds_between(F.lag(time).over(inside), F.col(time))
    flagged = cut.withColumn("__new", F.coalesce((step > gap_seconds).cast("int"), F.lit(0)))
    breaks = flagged.groupBy(user, "__hour").agg(F.sum("__new").alias("__breaks"))
    earlier = by_hour.rowsBetween(W.unboundedPreceding, -1)
    starts = join_keys(entries, breaks, [user, "__hour"]).select(
        user,
        "__hour",
        (
            F.coalesce(F.sum(F.col("__breaks") + F.col("__entry")).over(earlier), F.lit(0)) + F.col("__entry")
        ).alias("__start"),
    )
    # rows at one instant belong together: a RANGE frame also gives them one number
    running = F.sum("__new").over(inside.rangeBetween(W.unboundedPreceding, W.currentRow))
    numbered = join_keys(flagged.withColumn("__in", running), starts, [user, "__hour"])
    index = F.col("__in") + F.col("__start")
    label = F.concat(F.col(user), F.format_string("_S%04d", index))
    return numbered.withColumn(out, label).drop("__hour", "__new", "__in", "__start")
