"""Weekly cohort signals: aggregates, trends, quality gates and scored selections."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clientele.functions import rules as R
from clientele.functions.timeutil import as_timestamp, week_start
from clientele.operators.ordering import settled, top_rows

COHORT = ("age_group", "gender", "city", "product_category")


@dataclass(frozen=True)
class SignalSpec:
    """Roles of the columns of a signal frame and the thresholds applied to it."""

    name: str
    dimensions: tuple[str, ...]
    trend: str
    cohort: str = "active_users"
    period: str = "week_start"
    metrics: tuple[str, ...] = ()
    primary: tuple[str, ...] = ()
    rising: float = 0.10
    falling: float = -0.10
    min_cohort: int = 50
    top_per_group: int = 5
    max_rows: int = 100
    valid_values: dict[str, tuple[str, ...]] = field(default_factory=dict)

    @property
    def group(self) -> tuple[str, ...]:
        return self.primary or self.dimensions


# ---------------------------------------------------------------- weekly cohort aggregation


def with_profiles(events: DataFrame, profiles: DataFrame) -> DataFrame:
    """Events with the cohort columns of their user; users without profile drop out."""
    return events.join(profiles.select("user_id", "gender", "city", R.age_group("age").alias("age_group")), "user_id")


def weekly_cohorts(
    events: DataFrame, profiles: DataFrame, since: Column | str | None = None, until: Column | str | None = None
) -> DataFrame:
    """Counts, revenue and distinct users per cohort and Monday week; users without profile drop out.

    ``since`` is the first instant that counts, ``until`` the first one that does not.
    """
    if since is not None:
        events = events.where(F.col("event_timestamp") >= as_timestamp(since))
    if until is not None:
        events = events.where(F.col("event_timestamp") < as_timestamp(until))
    kind = F.col("event_type")
    bought, viewed = kind == "purchase", kind == "page_view"
    return (
        with_profiles(events, profiles)
        .groupBy(*COHORT, week_start("event_timestamp").alias("week_start"))
        .agg(
            F.countDistinct(F.when(bought, F.col("user_id"))).alias("purchasers"),
            F.count_if(bought).alias("purchase_count"),
            F.coalesce(F.sum(F.when(bought, F.col("revenue"))), F.lit(0.0)).alias("total_revenue"),
            F.count_if(viewed).alias("page_views"),
            F.countDistinct(F.when(viewed, F.col("session_id"))).alias("sessions"),
            F.count_if(kind == "add_to_cart").alias("add_to_cart_events"),
            F.countDistinct("user_id").alias("active_users"),
        )
    )


def with_trends(weekly: DataFrame, cohort: Sequence[str] = COHORT, category: str = "product_category") -> DataFrame:
    """Ratios, the change against the previous week present, and the share of the national average."""
    # a window and not a join: cohorts without a category stay, and the weekly frame is computed once
    national = F.avg("page_views").over(W.partitionBy(category, "week_start"))
    previous = F.lag("purchase_count").over(W.partitionBy(*cohort).orderBy("week_start"))
    velocity = R.safe_ratio(F.col("purchase_count") - F.col("prev_week_purchases"), "prev_week_purchases")
    return (
        weekly.withColumn("prev_week_purchases", previous)
        .withColumn("national_avg_page_views", national)
        .withColumns(
            {
                "purchase_rate": R.safe_ratio("purchasers", "active_users"),
                "cart_conversion_rate": R.safe_ratio("purchase_count", "add_to_cart_events"),
                "pages_per_session": R.safe_ratio("page_views", "sessions"),
                "wow_purchase_velocity_pct": velocity,
                "web_footprint_vs_national": R.safe_ratio("page_views", "national_avg_page_views"),
            }
        )
        .withColumn("trend_flag", R.trend_flag("wow_purchase_velocity_pct"))
        .drop("prev_week_purchases")
    )


def in_window(events: DataFrame, asof: Column | str, lookback_weeks: int = 8) -> DataFrame:
    """The events a report as of a day reads. Cutting before sessions are numbered changes no count."""
    day = F.to_date(as_timestamp(asof))
    since = F.date_sub(day, 7 * lookback_weeks).cast("timestamp_ntz")
    until = F.date_add(day, 1).cast("timestamp_ntz")
    return events.where((F.col("event_timestamp") >= since) & (F.col("event_timestamp") < until))


def micro_signals(
    events: DataFrame, profiles: DataFrame, asof: Column | str, lookback_weeks: int = 8, output_weeks: int = 4,
    ordered: bool = False,
) -> DataFrame:
    """The weekly micro-signal report as of the end of a day; later events do not count.

    The output window is cut after the lag, which needs older weeks.

    ``ordered`` sorts the result by age group, category and falling week, for an export.
    """
    day = F.to_date(as_timestamp(asof))
    since = F.date_sub(day, 7 * lookback_weeks).cast("timestamp_ntz")
    until = F.date_add(day, 1).cast("timestamp_ntz")
    signals = with_trends(weekly_cohorts(events, profiles, since, until))
    report = signals.where(F.col("week_start") >= F.date_sub(day, 7 * output_weeks)).select(
        *COHORT, "week_start", "active_users", "purchasers", "purchase_count", "total_revenue", "page_views",
        "sessions", "add_to_cart_events", "purchase_rate", "cart_conversion_rate", "pages_per_session",
        "national_avg_page_views", "wow_purchase_velocity_pct", "web_footprint_vs_national", "trend_flag",
    )
    return report.orderBy("age_group", "product_category", F.col("week_start").desc()) if ordered else report


def rounded_signals(weekly: DataFrame) -> DataFrame:
    """The derived block with stored precision: rates to 4 digits, averages to 2."""
    df = with_trends(weekly)
    four = ["purchase_rate", "cart_conversion_rate", "wow_purchase_velocity_pct", "web_footprint_vs_national"]
    two = ["pages_per_session", "national_avg_page_views"]
    rounded = {c: F.round(c, 4) for c in four} | {c: F.round(c, 2) for c in two}
    df = df.withColumns(rounded)
    return df.withColumn("trend_flag", R.trend_flag("wow_purchase_velocity_pct"))


# ---------------------------------------------------------------- quality gates


def gate(df: DataFrame, not_null: Sequence[str], trend: str, cohort: str, cap: float = 5.0,
         allowed: dict[str, Sequence[str]] | None = None, whitelist_first: bool = False) -> DataFrame:
    """NULLs, negative cohorts, extreme trends, duplicates and unknown categories, in that order."""
    out = df.dropna(subset=[c for c in not_null if c in df.columns])
    if cohort in df.columns:
        out = out.where(F.col(cohort) >= 0)
    if trend in df.columns:
        out = out.withColumn(trend, R.clip(trend, -cap, cap))
    allowed = {c: v for c, v in (allowed or {}).items() if c in df.columns}
    if whitelist_first:
        for c, values in allowed.items():
            out = out.where(F.col(c).isin(*values))
        return out.dropDuplicates()
    out = out.dropDuplicates()
    for c, values in allowed.items():
        out = out.where(F.col(c).isin(*values))
    return out


# The columns that may not be NULL in a micro-signal frame.
MICRO_NOT_NULL = ("wow_purchase_velocity_pct", "purchase_rate", "active_users", "trend_flag")


def clean_signals(df: DataFrame) -> DataFrame:
    return gate(df, MICRO_NOT_NULL, "wow_purchase_velocity_pct", "active_users", allowed={"age_group": R.AGE_GROUPS})


def clean_by_spec(df: DataFrame, spec: SignalSpec) -> DataFrame:
    return gate(df, (spec.trend, spec.cohort), spec.trend, spec.cohort, allowed=spec.valid_values, whitelist_first=True)


def _report(df: DataFrame, not_null: Sequence[str], trend: str, cohort: str, allowed: dict[str, Sequence[str]],
            duplicates: bool, cap: float = 5.0) -> DataFrame:
    """One pass: each row is charged to the first rule that drops it."""
    steps: list[tuple[str, Column]] = []
    alive = F.lit(True)
    for c in [c for c in not_null if c in df.columns]:
        steps.append((f"null:{c}", alive & F.col(c).isNull()))
        alive = alive & F.col(c).isNotNull()
    if cohort in df.columns:
        steps.append((f"negative:{cohort}", alive & (F.col(cohort) < 0)))
        alive = alive & (F.col(cohort) >= 0)
    if trend in df.columns:
        steps.append((f"capped:{trend}", alive & (F.abs(F.col(trend)) > cap)))
    allowed = {c: v for c, v in allowed.items() if c in df.columns}
    weight = F.col("__n")
    if duplicates:
        keyed = [F.when(alive, R.clip(c, -cap, cap) if c == trend else F.col(c)).alias(c) for c in df.columns]
        # dropped rows keep their own values for the NULL and negative counters
        grouped = df.select("*", F.struct(*keyed).alias("__key"), alive.alias("__alive"))
        counts = grouped.groupBy("__alive", "__key").agg(
            F.count(F.lit(1)).alias("__n"),
            *[F.count_if(cond).alias(name) for name, cond in steps],
        )
        live = F.col("__alive")
        aggs = [F.sum(F.col(f"`{name}`")).alias(name) for name, _ in steps]
        aggs.append(F.sum(F.when(live, weight - 1).otherwise(0)).alias("duplicate"))
        keep = live
        for c, values in allowed.items():
            ok = F.coalesce(F.col(f"__key.{c}").isin(*values), F.lit(False))
            aggs.append(F.count_if(keep & ~ok).alias(f"invalid:{c}"))
            keep = keep & ok
        names = [n for n, _ in steps] + ["duplicate"] + [f"invalid:{c}" for c in allowed]
        total = counts.agg(F.sum("__n").alias("rows_before"), F.count_if(keep).alias("rows_after"), *aggs)
    else:
        for c, values in allowed.items():
            ok = F.coalesce(F.col(c).isin(*values), F.lit(False))
            steps.append((f"invalid:{c}", alive & ~ok))
            alive = alive & ok
        names = [n for n, _ in steps]
        total = df.agg(F.count(F.lit(1)).alias("rows_before"), *[F.count_if(cond).alias(n) for n, cond in steps])
    return total.unpivot(
        [], ["rows_before", *(["rows_after"] if duplicates else []), *[f"`{n}`" for n in names]], "issue", "rows"
    ).select("issue", F.coalesce(F.col("rows"), F.lit(0)).cast("bigint").alias("rows"))


def clean_report(df: DataFrame) -> DataFrame:
    """How many rows each rule of :func:`clean_signals` dropped or changed."""
    return _report(df, MICRO_NOT_NULL, "wow_purchase_velocity_pct", "active_users",
                   {"age_group": R.AGE_GROUPS}, duplicates=True)


def spec_report(df: DataFrame, spec: SignalSpec) -> DataFrame:
    """As :func:`clean_report` for a declared signal; duplicates are dropped but not counted."""
    return _report(df, (spec.trend, spec.cohort), spec.trend, spec.cohort, spec.valid_values, duplicates=False)


# ---------------------------------------------------------------- selection


def latest_period(df: DataFrame, period: str = "week_start") -> DataFrame:
    """Rows of the newest period. A signal frame is small and read twice here, so it is settled."""
    df = settled(df)
    return df.where(F.col(period) == df.agg(F.max(period)).scalar())


def select_period(df: DataFrame, cohort: str, period: str, min_cohort: int, filter_first: bool = True) -> DataFrame:
    """Big cohorts of the newest period; ``filter_first`` says which of the two filters goes first."""
    big = F.col(cohort) >= min_cohort
    if filter_first:
        return latest_period(df.where(big), period)
    return latest_period(df, period).where(big)


def _strongest(score: Column, keys: Sequence[str]) -> list[Column]:
    return [score.desc_nulls_last(), *[F.col(k) for k in keys]]


def weighted_trim(df: DataFrame, min_users: int = 50, top_n: int = 5, max_rows: int = 100) -> DataFrame:
    """Top signals per (age group, category) by score, then the strongest rows overall."""
    latest = select_period(df, "active_users", "week_start", min_users)
    order = _strongest(R.signal_score("wow_purchase_velocity_pct", "active_users"), COHORT)
    return top_rows(latest, ["age_group", "product_category"], order, top_n).orderBy(*order).limit(max_rows)


def category_benchmark(df: DataFrame, min_users: int = 50) -> DataFrame:
    """Means and total users per category over all rows of the newest period."""
    return select_period(df, "active_users", "week_start", min_users).groupBy("product_category").agg(
        F.avg("purchase_rate").alias("avg_purchase_rate"),
        F.avg("wow_purchase_velocity_pct").alias("avg_velocity"),
        F.avg("web_footprint_vs_national").alias("avg_web_footprint"),
        F.sum("active_users").alias("total_users"),
    )


def top_movers(df: DataFrame, top_n: int = 5, min_users: int = 50) -> DataFrame:
    """Strongest moves per (age group, category), by velocity alone."""
    latest = select_period(df, "active_users", "week_start", min_users)
    return top_rows(latest, ["age_group", "product_category"],
                    _strongest(F.abs(F.col("wow_purchase_velocity_pct")), COHORT), top_n)


def prepare(df: DataFrame, spec: SignalSpec) -> DataFrame:
    """Lean preparation: newest period, then cohort size, NULL trends out, clip, flag; score attached."""
    out = select_period(df, spec.cohort, spec.period, spec.min_cohort, filter_first=False)
    return (
        out.dropna(subset=[spec.trend])
        .withColumn(spec.trend, R.clip(spec.trend, -5.0, 5.0))
        .withColumn("trend_flag", R.trend_flag(spec.trend, spec.rising, spec.falling))
        .withColumn("_score", R.signal_score(spec.trend, spec.cohort))
    )


def selected_rows(df: DataFrame, spec: SignalSpec, max_rows: int | None = None) -> DataFrame:
    """Rows a report shows for any declared signal, with their rank."""
    out = select_period(df, spec.cohort, spec.period, spec.min_cohort)
    if "trend_flag" not in df.columns:
        out = out.withColumn("trend_flag", R.trend_flag(spec.trend, spec.rising, spec.falling))
    order = _strongest(R.signal_score(spec.trend, spec.cohort), spec.dimensions)
    best = top_rows(out, spec.group, order, spec.top_per_group)
    cap = max_rows or spec.max_rows
    # bounded by the cap, which is part of the report: ranking it in one task is safe
    shown = best.orderBy(*order).limit(cap)
    ranked = shown.withColumn("rank", F.row_number().over(W.partitionBy(F.lit(0)).orderBy(*order)))
    columns = R.ordered_columns(ranked, spec.dimensions, (spec.trend, "trend_flag"), (spec.period,),
                                metric_columns(df, spec))
    return ranked.select("rank", *[c for c in columns if c != "rank"])


def benchmark(df: DataFrame, spec: SignalSpec, cohort_total: bool = False) -> DataFrame:
    """Mean trend and cohort (or total cohort) per value of the first dimension."""
    first = spec.group[0]
    size = F.sum(spec.cohort) if cohort_total else F.avg(spec.cohort)
    return df.groupBy(first).agg(F.avg(spec.trend).alias(spec.trend), size.alias(spec.cohort))


def metric_columns(df: DataFrame, spec: SignalSpec) -> list[str]:
    """Declared metrics, or every numeric column without another role."""
    if spec.metrics:
        return [c for c in spec.metrics if c in df.columns]
    return R.numeric_columns(df, (spec.trend, spec.cohort, spec.period, "trend_flag", "_score"))


# ---------------------------------------------------------------- roles and trends


def detect_roles(df: DataFrame, trend: str, period: str = "week_start", max_values: int = 30) -> DataFrame:
    """Role, kind and (for small dimensions) values of each column: one pass over the data."""
    roles = []
    for f in df.schema:
        if f.name == period:
            roles.append((f.name, "timestamp", "datetime"))
        elif f.name == trend:
            roles.append((f.name, "trend", "numeric"))
        elif isinstance(f.dataType, (T.StringType, T.BooleanType)):
            roles.append((f.name, "dimension", "categorical"))
        elif isinstance(f.dataType, T.NumericType):
            roles.append((f.name, "metric", "numeric"))
        elif isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType, T.DateType)):
            roles.append((f.name, "timestamp", "datetime"))
        else:
            roles.append((f.name, "meta", "categorical"))
    dims = [n for n, r, _ in roles if r == "dimension"]
    schema = df.sparkSession.createDataFrame(roles, "column string, role string, kind string")
    if not dims:
        return schema.select("*", F.lit(None).cast("bigint").alias("n_values"), F.lit(None).cast("string").alias("values"))
    values = distinct_values(df, dims)
    return schema.join(value_lists(values, max_values), "column", "left")


def distinct_values(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Distinct (column, value) pairs; merged on each task before the shuffle."""
    cells = [F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns]
    return df.select(F.inline(F.array(*cells))).where(F.col("value").isNotNull()).distinct()


def value_lists(values: DataFrame, limit: int) -> DataFrame:
    """Sorted value list per column when it has at most ``limit`` values, else only the count."""
    counts = values.groupBy("column").agg(F.count(F.lit(1)).alias("n_values"))
    # at most limit + 1 values per column survive, so no list can grow with the data
    few = top_rows(values, ["column"], [F.col("value")], limit + 1)
    lists = few.groupBy("column").agg(F.array_join(F.array_sort(F.collect_list("value")), ", ").alias("__list"))
    return counts.join(lists, "column").select(
        "column", "n_values", F.when(F.col("n_values") <= limit, F.col("__list")).alias("values")
    )


def _trend_rows(top: DataFrame, spec: SignalSpec, variant: str) -> DataFrame:
    seg = F.concat_ws(", ", *[F.concat(F.lit(f"{d}="), F.col(d).cast("string")) for d in spec.dimensions])
    t = F.col(spec.trend).cast("double")
    direction = R.trend_flag(t, spec.rising, spec.falling)
    pairs = [x for d in spec.dimensions for x in (F.lit(d), F.col(d).cast("string"))]
    size = F.format_string("%,d", F.col(spec.cohort).cast("bigint")) if variant == "lean" else F.col(spec.cohort).cast("string")
    noun = spec.cohort if variant == "lean" else "users"
    return top.select(
        "rank",
        F.concat_ws(" ", direction, F.lit(f"{spec.trend} for"), seg).alias("trend_title"),
        F.create_map(*pairs).alias("segment"),
        F.lit(spec.name).alias("signal_type"),
        direction.alias("direction"),
        F.round(t, 4).alias("metric_value"),
        F.lit(spec.trend).alias("metric_name"),
        F.format_string("%.0f%% %s baseline", F.rint(F.abs(t) * 100), F.when(t > 0, "above").otherwise("below")).alias(
            "benchmark_comparison"
        ),
        R.confidence_grade(t, spec.cohort, variant).alias("confidence"),
        F.format_string("%s shows %s=%.4f with %s %s.", seg, F.lit(spec.trend), t, size, F.lit(noun)).alias(
            "evidence_summary"
        ),
    )


def extract_trends(df: DataFrame, spec: SignalSpec, n: int = 5, variant: str = "generic") -> DataFrame:
    """Top trend rows with title, direction, confidence and evidence.

    ``generic`` takes the newest period by absolute trend; ``lean`` takes prepared rows by score.
    """
    if variant == "lean":
        source = prepare(df, spec)
        order = _strongest(F.col("_score"), spec.dimensions)
    else:
        source = latest_period(df, spec.period)
        order = _strongest(F.abs(F.col(spec.trend)), spec.dimensions)
    top = source.orderBy(*order).limit(n)
    ranked = top.withColumn("rank", F.row_number().over(W.partitionBy(F.lit(0)).orderBy(*order)))
    return _trend_rows(ranked, spec, variant)


def union_signals(frames: dict[str, DataFrame], specs: dict[str, SignalSpec], n: int = 5) -> DataFrame:
    """One operator over many signals of different schemas, as long rows of one schema."""
    out = None
    for name, df in frames.items():
        part = extract_trends(df, specs[name], n)
        out = part if out is None else out.unionByName(part)
    return out
