"""Scores against each row's own sliding days, micro-batch by micro-batch.

A day is closed once the stream has seen a row more than ``lateness`` past its end. Each micro-batch keeps
its rows and its counts by day and value, and scores the kept rows of the days that it closes against the
counts of the days before them. Everything a batch writes lies in folders of its own number and follows
from its rows and from what earlier batches wrote, so a batch that is run again after a failure replaces
its own output and nothing else.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from clientele.operators import sliding
from clientele.operators.anomaly import Z_LIMIT


NO_DAY = -(1 << 30)  # of rows without a time


class SlidingScores:
    """Rows, counts, marks and scores of a stream in subfolders of ``folder``.

    ``rows`` and ``counts`` are partitioned by day, so a batch reads no more than the days it closes and
    the ``days`` before them. A row that comes after its day was closed is scored with the batch that
    brings it; rows without a time have no baseline and are scored at once.
    """

    def __init__(self, spark: SparkSession, folder: str, value: str, time: str, keys: Sequence[str] = (), days: int = sliding.DAYS,
                 lateness: str = "1 hour", limit: float = Z_LIMIT):
        self.spark, self.folder, self.value, self.time = spark, folder, value, time
        self.keys, self.days, self.lateness, self.limit = list(keys), days, lateness, limit

    def _kept(self, what: str, schema: T.StructType, until: int) -> DataFrame:
        """What batches up to one have written; the schema is given, as empty batches leave no file."""
        whole = T.StructType([*schema.fields, T.StructField("__day", T.IntegerType()), T.StructField("__batch", T.IntegerType())])
        return self.spark.read.schema(whole).parquet(f"{self.folder}/{what}").where(F.col("__batch") <= until)

    def _put(self, df: DataFrame, what: str, number: int, *by: str) -> None:
        df.write.mode("overwrite").partitionBy(*by).parquet(f"{self.folder}/{what}/__batch={number}")

    def _closed(self, until: int) -> int | None:
        """The first day (number) that is still open after a batch; None before any time was seen."""
        if until < 0:
            return None
        marks = self.spark.read.schema("open int, __batch int").parquet(f"{self.folder}/marks")
        return marks.where(F.col("__batch") <= until).agg(F.max("open")).first()[0]

    def add(self, batch: DataFrame, number: int) -> None:
        """One micro-batch; ``number`` rises by one and comes again with the same rows after a failure."""
        self.schema = batch.schema
        day = F.unix_date(F.to_date(F.col(self.time)))
        self._put(batch.withColumn("__day", F.coalesce(day, F.lit(NO_DAY))), "rows", number, "__day")
        known = self._kept("rows", batch.schema, number)
        own = known.where(F.col("__batch") == number)
        counts = sliding.day_counts(own, self.value, self.time, self.keys)
        self.counted = counts.schema
        self._put(counts.withColumn("__day", F.col("day")), "counts", number, "__day")
        opened = self._closed(number - 1)
        until = F.unix_date(F.to_date(F.max(self.time) - F.expr(f"INTERVAL {self.lateness}")))
        self._put(own.agg(F.greatest(until, F.lit(opened).cast("int")).alias("open")), "marks", number)
        closed, first = self._closed(number), NO_DAY + 1 if opened is None else opened
        day = F.col("__day")
        due = (F.col("__batch") == number) & (day < first)
        if closed is not None:
            due = due | ((day >= first) & (day < closed))
        self._put(self._scored(known.where(due), number), "scores", number)

    def _scored(self, rows: DataFrame, until: int) -> DataFrame:
        targets = rows.where(F.col("__day") > NO_DAY).select(*self.keys, F.col("__day").alias("day")).distinct()
        span = targets.agg(F.min("day").alias("a"), F.max("day").alias("z")).first()
        counts = self._kept("counts", self.counted, until)
        # literal bounds, so that only the folders of these days are read
        near = counts.where(F.col("__day").between((span.a or 0) - self.days, (span.z or 0) - 1))
        merged = near.groupBy(*self.keys, "day", "value").agg(F.sum("n").alias("n"))
        baselines = sliding.sliding_baselines(merged, targets, self.keys, self.days)
        return sliding.scored(rows.drop("__day", "__batch"), baselines, self.value, self.time, self.keys, self.limit)

    def run(self, stream: DataFrame, checkpoint: str) -> StreamingQuery:
        """Process what is there; a restart from the same checkpoint goes on where it stopped."""
        query = stream.writeStream.foreachBatch(self.add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
        return query

    def scores(self) -> DataFrame:
        """All rows of closed days, scored."""
        return self.spark.read.parquet(f"{self.folder}/scores").drop("__batch")

    def still_open(self) -> DataFrame:
        """The rows of days that a closed input leaves open, scored the same way; after ``run``."""
        marks = self.spark.read.schema("open int, __batch int").parquet(f"{self.folder}/marks")
        last = marks.agg(F.max("__batch"), F.max("open")).first()
        rows = self._kept("rows", self.schema, last[0])
        return self._scored(rows.where(F.col("__day") >= (NO_DAY + 1 if last[1] is None else last[1])), last[0])
