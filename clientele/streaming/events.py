"""Streams of events: reading, running, and sessions in one step.

Sessions here are a plain windowed aggregate with a watermark, so state is bounded by the open windows
and recovers from the stream's checkpoint folder. A user is one key; ``weekly`` has the form for very
active users, and the weekly measures.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from clientele.operators.ordering import join_keys


def read_events(spark: SparkSession, root: str, schema: str, glob: str = "*.parquet", files_per_trigger: int | None = None) -> DataFrame:
    """A folder of Parquet files as a stream."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", glob)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(root)


def sessions(events: DataFrame, user: str = "user_id", time: str = "event_timestamp", gap: str = "30 minutes",
             lateness: str = "1 hour") -> DataFrame:
    """One row per finished session; a gap longer than ``gap`` closes it. A gap of exactly ``gap`` does not."""
    timed = events.withColumn("__t", F.col(time).cast("timestamp")).withWatermark("__t", lateness)
    return (
        timed.groupBy(user, F.session_window("__t", gap).alias("w"))
        .agg(F.count(F.lit(1)).alias("events"), F.min("__t").alias("started"), F.max("__t").alias("ended"))
        .select(user, "started", "ended", "events")
    )


def open_sessions(events: DataFrame, finished: DataFrame, user: str = "user_id", time: str = "event_timestamp",
                  gap: str = "30 minutes", lateness: str = "1 hour") -> DataFrame:
    """The sessions of a closed input that its watermark did not finish, from the same events as a batch.

    Only users with events near the end of the input are read again; a NULL user is a user.
    """
    timed = events.withColumn("__t", F.col(time).cast("timestamp"))
    last = timed.agg(F.max("__t")).scalar()
    late = timed.where(F.col("__t") >= last - F.expr(f"INTERVAL {lateness}") - F.expr(f"INTERVAL {gap}") * 2).select(user).distinct()
    whole = sessions(join_keys(events, late, [user], "left_semi"), user, time, gap, lateness)
    return join_keys(whole, finished.select(user, "started"), [user, "started"], "left_anti")


def run_once(stream: DataFrame, out: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Process what is there, in micro-batches, into a Parquet folder; a restart continues where it stopped."""
    query = (
        stream.writeStream.format("parquet")
        .option("path", out)
        .option("checkpointLocation", checkpoint)
        .outputMode(mode)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return query
