"""Exact sessions and weekly cohort measures of a stream, with very active users spread over tasks.

Step one cuts time into windows no longer than the session gap, so what a user does in one window belongs
to one session: a fragment (first, last, counts). It is a windowed aggregate that merges rows before they
are shuffled, so the most active user leaves one row per window. Step two reads the fragments as a stream:
sessions merge fragments that touch; weekly measures keep, for each user, the fragments that wait for the
watermark, the last session and what the user did per cohort and week.

A fragment is written once its window lies behind the watermark, so later ones start at most one window
earlier than that; a watermark of one window over the fragments' starts therefore loses none. Step two
may run as its own query, restart from its own checkpoint, and keep up at its own pace.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from clientele.functions.timeutil import week_start
from clientele.operators.ordering import join_keys
from clientele.operators.sessions import sessionise

PIECE = "10 minutes"
GAP = "30 minutes"
DAY_MS = 86_400_000
WEEK_MS = 7 * DAY_MS
MONDAY_MS = 4 * DAY_MS  # the epoch is a Thursday
COUNTS = ("purchase_count", "page_views", "add_to_cart_events", "events")


def _micros(interval: str) -> int:
    return pd.Timedelta(interval) // pd.Timedelta("1us")


def fragments(events: DataFrame, by: Sequence[str], time: str = "event_timestamp", kind: str = "event_type", revenue: str = "revenue",
              piece: str = PIECE, lateness: str = "1 hour") -> DataFrame:
    """``(by, start, first, last, counts, total_revenue)``: what happened per window of ``piece``; NULL is a key.

    ``by`` begins with the user; events later than ``lateness`` are dropped, as by any watermark.
    """
    timed = events.withColumn("__t", F.col(time).cast("timestamp")).withWatermark("__t", lateness)
    bought = F.col(kind) == "purchase"
    return timed.groupBy(*by, F.window("__t", piece).alias("w")).agg(
        F.min("__t").alias("first"), F.max("__t").alias("last"),
        F.count_if(bought).alias("purchase_count"), F.count_if(F.col(kind) == "page_view").alias("page_views"),
        F.count_if(F.col(kind) == "add_to_cart").alias("add_to_cart_events"), F.count(F.lit(1)).alias("events"),
        F.sum(F.when(bought, F.col(revenue)).otherwise(0.0)).alias("total_revenue"),
    ).withColumn("start", F.col("w.start")).drop("w")


def merged_sessions(parts: DataFrame, user: str = "user_id", gap: str = GAP, piece: str = PIECE) -> DataFrame:
    """``(user, started, ended, events)`` from a stream (or table) of fragments; ``piece`` must not exceed ``gap``.

    A fragment is a session window from its first event to ``gap`` after its last; windows that touch merge.
    """
    if _micros(piece) > _micros(gap):
        raise ValueError("fragments must not be longer than the gap that ends a session")
    length = F.concat((F.unix_micros("last") - F.unix_micros("first") + F.lit(_micros(gap))).cast("string"), F.lit(" microseconds"))
    timed = parts.withWatermark("first", piece)
    return (
        timed.groupBy(user, F.session_window("first", length).alias("w"))
        .agg(F.min("first").alias("started"), F.max("last").alias("ended"), F.sum("events").alias("events"))
        .drop("w")
    )


def open_events(events: DataFrame, finished: DataFrame, user: str = "user_id", time: str = "event_timestamp") -> DataFrame:
    """Events of a closed input behind the last finished session of their user; a user's sessions finish in order."""
    until = finished.groupBy(user).agg(F.max("ended").alias("__until"))
    return join_keys(events, until, [user], "left").where(
        F.col("__until").isNull() | (F.col(time).cast("timestamp") > F.col("__until"))).drop("__until")


# ---------------------------------------------------------------- weekly measures per user


class WeeksOfUser(StatefulProcessor):
    """Turns a user's fragments into one row per cohort and week, once the watermark has passed the week.

    State: fragments that wait (list), the session that is open (its number and last event), and
    running measures per cohort and week (map). A timer stands at the end of the first waiting window or
    open week; entries go when they are used, so a silent user keeps two numbers. Each call to the state
    costs a round trip, so new fragments are appended in one, and what still waits is written in one.
    """

    def __init__(self, by: Sequence[str], schema: T.StructType, gap: str = GAP, piece: str = PIECE):
        self.by, self.names = list(by), schema.names
        self.gap, self.piece = _micros(gap), _micros(piece) // 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "part string")
        self.weeks = handle.getMapState("weeks", "week long", "cohorts string")
        self.session = handle.getValueState("session", "number long, last long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new, first = [], None
        for part in rows:
            # plain lists: frame operations cost more than the few rows of a user
            at = zip(*[part[c].to_numpy().astype("datetime64[us]").astype("int64").tolist() for c in ("start", "first", "last")], strict=True)
            cohorts = zip(*[[None if v is None or v != v else v for v in part[c].tolist()] for c in self.by[1:]], strict=True)
            numbers = zip(*[part[c].tolist() for c in (*COUNTS, "total_revenue")], strict=True)
            for t, c, n in zip(at, cohorts, numbers, strict=True):
                start = t[0] // 1000
                first = start if first is None else min(first, start)
                new.append((json.dumps([start, t[1], t[2], c, n]),))
        if new:
            self.waiting.appendList(new)
            self._wake([*self.handle.listTimers(), first + self.piece])
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        due: dict[int, list] = {}
        ends, rest = [], []
        for (text,) in self.waiting.get():
            p = json.loads(text)
            if p[0] + self.piece <= now:
                due.setdefault(p[0], []).append(p[1:])
            else:
                rest.append((text,))
                ends.append(p[0] + self.piece)
        if due and rest:
            self.waiting.put(rest)
        elif due:
            self.waiting.clear()
        number, last = self.session.get() if self.session.exists() else (0, None)
        weeks = {week: {tuple(c): m for c, m in json.loads(text)} for (week,), (text,) in self.weeks.iterator()}
        stored = set(weeks)
        for start, parts in sorted(due.items()):
            if last is None or min(p[0] for p in parts) - last > self.gap:
                number += 1
            last = max([p[1] for p in parts] + ([last] if last is not None else []))
            held = weeks.setdefault((start - MONDAY_MS) // WEEK_MS * WEEK_MS + MONDAY_MS, {})
            for *_, cohort, n in parts:
                m = held.setdefault(tuple(cohort), [0.0] * len(n) + [0, -1])
                for i, x in enumerate(n):
                    m[i] += x
                if n[1] and m[-1] != number:  # sessions are those with a page view
                    m[-2], m[-1] = m[-2] + 1, number
        if due:
            self.session.update((number, last))
        out = []
        for week in sorted(weeks):
            if week + WEEK_MS <= now:
                for cohort, m in weeks[week].items():
                    out.append((*cohort, pd.Timestamp(week, unit="ms").date(), *map(int, m[: len(COUNTS)]), float(m[len(COUNTS)]), int(m[-2]),
                                int(m[0] > 0)))
                if week in stored:
                    self.weeks.removeKey((week,))
            else:
                ends.append(week + WEEK_MS)
                if due:
                    self.weeks.updateValue((week,), (json.dumps([[list(c), m] for c, m in weeks[week].items()]),))
        self._wake(ends)
        if out:
            yield pd.DataFrame(out, columns=self.names)

    def _wake(self, ends: list[int]) -> None:
        """One timer, at the first moment at which something is due."""
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if ends:
            self.handle.registerTimer(min(ends))

    def close(self) -> None:
        pass


def weeks_of_users(parts: DataFrame, by: Sequence[str], gap: str = GAP, piece: str = PIECE) -> DataFrame:
    """One row per user, cohort and finished week: counts, revenue, sessions with a view, and whether the user bought.

    ``by`` is the user and the cohort columns. The session must use the RocksDB state store.
    """
    kinds = {f.name: f.dataType.simpleString() for f in parts.schema}
    schema = T._parse_datatype_string(", ".join([*[f"{c} {kinds[c]}" for c in by[1:]], "week_start date", *[f"{c} long" for c in COUNTS],
                                                 "total_revenue double, sessions long, purchasers long"]))
    timed = parts.withWatermark("start", piece)
    return timed.groupBy(by[0]).transformWithStateInPandas(
        WeeksOfUser(by, schema, gap, piece), outputStructType=schema, outputMode="Append", timeMode="EventTime")


def weekly_of_users(rows: DataFrame, cohort: Sequence[str]) -> DataFrame:
    """Measures per cohort and week: each user is one row there, so users add up exactly."""
    measures = [*COUNTS, "total_revenue", "sessions", "purchasers"]
    return rows.groupBy(*cohort, "week_start").agg(*[F.sum(c).alias(c) for c in measures], F.count(F.lit(1)).alias("active_users"))


def open_weeks(events: DataFrame, finished: DataFrame, by: Sequence[str], time: str = "event_timestamp", kind: str = "event_type",
               revenue: str = "revenue", gap: str = GAP) -> DataFrame:
    """The measures of the weeks that a closed input leaves open, from the same events as a batch.

    Cutting the events at the start of a week changes no count of sessions in the weeks behind it.
    Cohort columns are strings, numbers or booleans.
    """
    last = finished.agg(F.max("week_start")).first()[0]
    user = F.coalesce(F.col(by[0]).cast("string"), F.lit("\0"))  # without a name a user is still one
    rows = events.withColumn(by[0], user).where(F.col(time).isNotNull())
    if last is not None:
        rows = rows.where(F.col(time) >= F.lit(str(last)).cast("timestamp_ntz") + F.expr("INTERVAL 7 DAYS"))
    named = sessionise(rows, by[0], time, _micros(gap) // 1_000_000, "__session")
    bought, viewed = F.col(kind) == "purchase", F.col(kind) == "page_view"
    return named.groupBy(*by[1:], week_start(time).alias("week_start")).agg(
        F.count_if(bought).alias("purchase_count"), F.count_if(viewed).alias("page_views"),
        F.count_if(F.col(kind) == "add_to_cart").alias("add_to_cart_events"), F.count(F.lit(1)).alias("events"),
        F.sum(F.when(bought, F.col(revenue)).otherwise(0.0)).alias("total_revenue"),
        F.countDistinct(F.when(viewed, F.col("__session"))).alias("sessions"),
        F.countDistinct(F.when(bought, F.col(by[0]))).alias("purchasers"), F.countDistinct(by[0]).alias("active_users"))
