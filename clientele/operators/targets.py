"""Per-customer targets from transactions. ``end`` is the newest transaction unless given."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clientele.functions.timeutil import as_timestamp, floor_days, plus_days
from clientele.operators.ordering import quantiles, row_number_by_time, settled, top_rows


@dataclass(frozen=True)
class TargetRules:
    churn_days: int = 90
    upsell_increase: float = 0.20
    early_days: int = 30
    max_gap_days: int = 365
    risk_score: float = 2.0
    default_score: float = 3.0


RULES = TargetRules()


def data_end(txn: DataFrame, end: Column | str | None = None) -> Column:
    return as_timestamp(end) if end is not None else txn.agg(F.max("timestamp")).scalar()


def _on_spine(users: DataFrame, values: DataFrame, fill: dict[str, Column]) -> DataFrame:
    joined = users.select("user_id").join(values, "user_id", "left")
    return joined.withColumns({c: F.coalesce(F.col(c), v) for c, v in fill.items()})


def churn(users: DataFrame, txn: DataFrame, end: Column | str | None = None, rules: TargetRules = RULES) -> DataFrame:
    """1 when the last order is older than the window before the data end, or missing."""
    # settled per user, so that finding the data end does not read the transactions again
    last = settled(txn.groupBy("user_id").agg(F.max("timestamp").alias("timestamp")))
    limit = plus_days(data_end(last, end), -rules.churn_days)
    return _on_spine(users, last.select("user_id", (F.col("timestamp") < limit).cast("int").alias("churn")), {"churn": F.lit(1)})


def clv(users: DataFrame, txn: DataFrame) -> DataFrame:
    return _on_spine(users, txn.groupBy("user_id").agg(F.sum("amount").alias("clv")), {"clv": F.lit(0.0)})


def _half_means(n: Column, position: Column, total: Column) -> tuple[Column, Column]:
    middle = F.floor(n / 2)
    first = F.avg(F.when(position <= middle, total))
    second = F.avg(F.when(position > middle, total))
    return first, second


def upsell(users: DataFrame, txn: DataFrame, rules: TargetRules = RULES) -> DataFrame:
    """1 when the mean order of the second half is at least the given share above the first half.

    An order here is all spending of a user at one instant.
    """
    per_order = settled(txn.groupBy("user_id", "timestamp").agg(F.sum("amount").alias("order_total")))
    placed = row_number_by_time(per_order, ["user_id"], "timestamp", out="rn", total="n")
    first, second = _half_means(F.col("n"), F.col("rn"), F.col("order_total"))
    halves = placed.groupBy("user_id").agg(first.alias("first"), second.alias("second"))
    grew = (F.col("first") > 0) & ((F.col("second") - F.col("first")) / F.col("first") >= rules.upsell_increase)
    return _on_spine(users, halves.select("user_id", grew.cast("int").alias("upsell")), {"upsell": F.lit(0)})


def next_item(users: DataFrame, txn: DataFrame) -> DataFrame:
    """Product of the last transaction; equal times are settled by transaction and product id."""
    has = F.col("product_id").isNotNull()
    order = F.when(has, F.struct("timestamp", "transaction_id", "product_id"))
    last = txn.groupBy("user_id").agg(F.max_by("product_id", order).alias("next_item_id"))
    return _on_spine(users, last, {"next_item_id": F.lit("NONE")})


def with_first_seen(txn: DataFrame) -> DataFrame:
    """Each transaction with its product's first sale, by a pre-aggregated join (no window per product)."""
    first = txn.groupBy("product_id").agg(F.min("timestamp").alias("first_seen"))
    return txn.join(first, "product_id", "left")


def early_adopter(users: DataFrame, txn: DataFrame, rules: TargetRules = RULES) -> DataFrame:
    """1 for anyone who bought some product within the first days of its sale."""
    early = (
        with_first_seen(txn)
        .where(floor_days("first_seen", "timestamp") <= rules.early_days)
        .select("user_id")
        .distinct()
        .withColumn("early_adopter", F.lit(1))
    )
    return _on_spine(users, early, {"early_adopter": F.lit(0)})


def days_to_next(
    users: DataFrame, txn: DataFrame, end: Column | str | None = None, rules: TargetRules = RULES, dedupe: str = "none"
) -> DataFrame:
    """Gap between the last two rows (or days, with ``dedupe="day"``), capped; one row counts to the end."""
    stamps = txn.select("user_id", "timestamp").where(F.col("timestamp").isNotNull())
    if dedupe == "day":
        stamps = stamps.groupBy("user_id", F.to_date("timestamp").alias("d")).agg(F.max("timestamp").alias("timestamp"))
    last_two = top_rows(stamps, ["user_id"], [F.col("timestamp").desc()], 2)
    gaps = settled(last_two.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("n"), F.min("timestamp").alias("a"), F.max("timestamp").alias("b")
    ))
    limit = data_end(gaps.withColumnRenamed("b", "timestamp"), end)
    gap = F.when(F.col("n") >= 2, floor_days("a", "b")).otherwise(floor_days("b", limit))
    capped = F.least(gap, F.lit(rules.max_gap_days).cast("bigint")).alias("days_next_purchase")
    return _on_spine(users, gaps.select("user_id", capped),
                     {"days_next_purchase": F.lit(rules.max_gap_days).cast("bigint")})


def _at_risk(rules: TargetRules) -> Column:
    # sums of shuffled doubles differ in their last bits; rounding keeps the threshold stable
    return (F.round("avg_review_score", 9) <= rules.risk_score).cast("int")


def satisfaction_risk(users: DataFrame, txn: DataFrame, rules: TargetRules = RULES) -> DataFrame:
    score = txn.groupBy("user_id").agg(F.avg("review_score").alias("avg_review_score"))
    out = _on_spine(users, score, {"avg_review_score": F.lit(rules.default_score)})
    return out.withColumn("satisfaction_risk", _at_risk(rules))


def all_targets(
    users: DataFrame, txn: DataFrame, end: Column | str | None = None, rules: TargetRules = RULES
) -> DataFrame:
    """Every target on one spine, from one table of (user, instant) rows.

    Transactions are merged per user and instant and settled; ranks come from per-day pieces, and
    all targets follow from a single grouped aggregate.
    """
    has = F.col("product_id").isNotNull()
    early = floor_days("first_seen", "timestamp") <= rules.early_days
    instants = settled(with_first_seen(txn).groupBy("user_id", "timestamp").agg(
        F.sum("amount").alias("order_total"),
        F.count(F.lit(1)).alias("rows"),
        F.sum("review_score").alias("score_sum"),
        F.count("review_score").alias("score_n"),
        F.max(early.cast("int")).alias("early"),
        F.max_by("product_id", F.when(has, F.struct("transaction_id", "product_id"))).alias("item"),
    ))
    limit = data_end(instants, end)
    placed = row_number_by_time(instants, ["user_id"], "timestamp", out="rn", total="n")
    first, second = _half_means(F.col("n"), F.col("rn"), F.col("order_total"))
    last, before = F.col("rn") == F.col("n"), F.col("rn") == F.col("n") - 1
    per_user = placed.groupBy("user_id").agg(
        F.max("timestamp").alias("last_ts"),
        F.max(F.when(before, F.col("timestamp"))).alias("prev_ts"),
        F.max(F.when(last, F.col("rows"))).alias("last_rows"),
        F.sum("order_total").alias("clv"),
        first.alias("first"),
        second.alias("second"),
        F.max_by("item", F.when(F.col("item").isNotNull(), F.col("timestamp"))).alias("next_item_id"),
        F.max("early").alias("early_adopter"),
        (F.sum("score_sum") / F.sum("score_n")).alias("avg_review_score"),
    )
    gap = (
        F.when(F.col("last_rows") >= 2, F.lit(0).cast("bigint"))
        .when(F.col("prev_ts").isNotNull(), floor_days("prev_ts", "last_ts"))
        .otherwise(floor_days("last_ts", limit))
    )
    grew = (F.col("first") > 0) & ((F.col("second") - F.col("first")) / F.col("first") >= rules.upsell_increase)
    values = per_user.select(
        "user_id",
        (F.col("last_ts") < plus_days(limit, -rules.churn_days)).cast("int").alias("churn"),
        "clv",
        grew.cast("int").alias("upsell"),
        "next_item_id",
        "early_adopter",
        F.least(gap, F.lit(rules.max_gap_days).cast("bigint")).alias("days_next_purchase"),
        "avg_review_score",
    )
    filled = _on_spine(users, values, {
        "churn": F.lit(1), "clv": F.lit(0.0), "upsell": F.lit(0), "next_item_id": F.lit("NONE"),
        "early_adopter": F.lit(0), "days_next_purchase": F.lit(rules.max_gap_days).cast("bigint"),
        "avg_review_score": F.lit(rules.default_score),
    })
    return filled.withColumn("satisfaction_risk", _at_risk(rules))


# The binary and the continuous targets.
BINARY_TARGETS = ("churn", "upsell", "early_adopter", "satisfaction_risk")
CONTINUOUS_TARGETS = ("clv", "days_next_purchase")


def target_summary(targets: DataFrame) -> DataFrame:
    """Positive rate of binary targets, mean and exact median of continuous ones, as long rows."""
    targets = settled(targets)
    means = targets.agg(*[F.avg(c).alias(f"{c}:rate") for c in BINARY_TARGETS],
                        *[F.avg(c).alias(f"{c}:mean") for c in CONTINUOUS_TARGETS],
                        F.avg((F.col("next_item_id") != "NONE").cast("int")).alias("next_item:valid_rate"))
    out = means.unpivot([], [f"`{c}`" for c in means.columns], "item", "value")
    # both columns in one pass: the column's name is the key
    values = targets.select(*[F.col(c).cast("double").alias(c) for c in CONTINUOUS_TARGETS])
    long = values.unpivot([], list(CONTINUOUS_TARGETS), "column", "v")
    names = targets.sparkSession.createDataFrame([(c,) for c in CONTINUOUS_TARGETS], "column string")
    medians = names.join(quantiles(long, "v", {"value": 0.5}, ["column"]), "column", "left")
    out = out.unionByName(medians.select(F.concat("column", F.lit(":median")).alias("item"), "value"))
    return out


def ground_truth(
    users: DataFrame, txn: DataFrame, end: Column | str | None = None, churn_days: int = 90, legacy: bool = False
) -> DataFrame:
    """Recency churn, 365-day value, spend and order count. ``legacy`` counts never-buyers as not churned."""
    limit = data_end(txn, end)
    recent = F.col("timestamp") >= plus_days(limit, -365)
    per_user = txn.groupBy("user_id").agg(
        (floor_days(F.max("timestamp"), limit) > churn_days).cast("int").alias("churned"),
        F.sum(F.when(recent, F.col("amount"))).alias("clv"),
        F.sum("amount").alias("total_spend"),
        F.count(F.lit(1)).alias("order_count"),
    )
    return _on_spine(users, per_user, {
        "churned": F.lit(0 if legacy else 1), "clv": F.lit(0.0), "total_spend": F.lit(0.0),
        "order_count": F.lit(0).cast("bigint"),
    })


def segment_profile(truth: DataFrame, segment: str = "segment") -> DataFrame:
    names = ["churned", "clv", "total_spend", "order_count"]
    return truth.groupBy(segment).agg(*[F.round(F.avg(c), 2).alias(c) for c in names])


def price_tier_upsell(txn: DataFrame, tiers: int = 4) -> DataFrame:
    """1 when a user's last purchase lies in a higher price tier than the one before the last.

    Tiers are equal shares of all prices; the cut points are exact quantiles.
    """
    probs = {f"q{i}": i / tiers for i in range(1, tiers)}
    cuts = quantiles(txn, "price", probs)
    one = cuts.select(F.array(*probs).alias("cuts")).scalar()
    tier = F.size(F.filter("cuts", lambda c: c < F.col("price")))
    last_two = top_rows(txn.select("user_id", "timestamp", "transaction_id", "product_id", "price"), ["user_id"],
                        [F.col("timestamp").desc(), F.col("transaction_id").desc(), F.col("product_id").desc(),
                         F.col("price").desc()], 2, out="back")
    rated = last_two.withColumn("cuts", one).withColumn("tier", tier).groupBy("user_id").agg(
        F.max(F.when(F.col("back") == 1, F.col("tier"))).alias("last_tier"),
        F.max(F.when(F.col("back") == 2, F.col("tier"))).alias("prev_tier"),
    )
    higher = F.coalesce((F.col("last_tier") > F.col("prev_tier")).cast("int"), F.lit(0))
    return rated.select("user_id", "last_tier", "prev_tier", higher.alias("tier_upsell"))


def first_buyers(txn: DataFrame, category: str = "category", share: float = 0.10) -> DataFrame:
    """Users among the first share of buyers of some category, by the time of their first purchase."""
    entries = settled(txn.groupBy(category, "user_id").agg(F.min("timestamp").alias("entered")))
    placed = row_number_by_time(entries, [category], "entered", ["user_id"], out="rn", total="n")
    early = F.max((F.col("rn") <= F.ceil(F.col("n") * share)).cast("int"))
    return placed.groupBy("user_id").agg(early.alias("early_buyer"))
