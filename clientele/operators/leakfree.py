"""Labels and features on the two sides of a cutoff date.

Features read rows up to the cutoff, labels rows in ``(cutoff, cutoff + window]``. A cutoff
given as a literal reaches the Parquet filters; one derived from the data is a scalar subquery.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from clientele.functions.timeutil import as_timestamp, days_between, floor_days, midnight, plus_days
from clientele.operators.adapter import not_excluded
from clientele.operators.ordering import global_row_number, top_rows

OBSERVATION_DAYS = 90
MIN_HISTORY_DAYS = 30
CATEGORY_CLASSES = 10
SEQUENCE_LENGTH = 50

AT = "order_purchase_timestamp"
WHO = "customer_unique_id"


def suggest_cutoff(orders: DataFrame, days: int = OBSERVATION_DAYS) -> Column:
    """Midnight of the newest order minus the observation window."""
    return plus_days(midnight(orders.agg(F.max(AT)).scalar()), -days)


def many_to_one(right: DataFrame, key: str) -> DataFrame:
    """The right side of a join that may hold each key once; a repeated key fails the query."""
    values = [c for c in right.columns if c != key]
    merged = right.groupBy(key).agg(F.count(F.lit(1)).alias("__n"), *[F.first(c).alias(c) for c in values])
    repeated = F.raise_error(F.concat(F.lit(f"{key} is not unique: "), F.col(key).cast("string")))
    return merged.select(key, *[F.when(F.col("__n") > 1, repeated).otherwise(F.col(c)).alias(c) for c in values])


def owned_orders(orders: DataFrame, customers: DataFrame) -> DataFrame:
    """Valid orders with the stable customer id."""
    owner = many_to_one(customers.select("customer_id", WHO), "customer_id")
    return not_excluded(orders).join(owner, "customer_id")


def _checked(frame: DataFrame, orders: DataFrame, end: Column) -> DataFrame:
    newest = not_excluded(orders).agg(F.max(AT)).scalar()
    late = F.raise_error(F.concat(F.lit("observation window ends after the newest order, at "), end.cast("string")))
    return frame.where(F.when(end > newest, late.cast("boolean")).otherwise(F.lit(True)))


def eligible(
    orders: DataFrame, customers: DataFrame, cutoff: Column | str, min_history: int = MIN_HISTORY_DAYS
) -> DataFrame:
    """Customers with an order before the cutoff and a long enough history."""
    at = as_timestamp(cutoff)
    history = owned_orders(orders, customers).where(F.col(AT) <= at).groupBy(WHO).agg(F.min(AT).alias("first"))
    return history.where(plus_days("first", min_history) <= at).select(WHO)


def category_labels(observed: DataFrame, items: DataFrame, products: DataFrame, top_k: int = CATEGORY_CLASSES) -> DataFrame:
    """Class of the first category bought in the window: frequent ones by rank, the others share the last class."""
    first = observed.groupBy(WHO).agg(F.min_by("order_id", F.struct(AT, "order_id")).alias("order_id"))
    kinds = products.select("product_id", F.col("product_category_name").alias("category"))
    bought = first.join(items.select("order_id", "product_id"), "order_id").join(kinds, "product_id", "left")
    known = F.col("category").isNotNull()
    per_user = bought.groupBy(WHO).agg(F.min_by("category", F.when(known, F.col("product_id"))).alias("category"))
    order = [F.col("n").desc(), F.col("category")]
    # at most top_k - 1 rows: one task ranks them and a broadcast returns them
    top = per_user.where(known).groupBy("category").agg(F.count(F.lit(1)).alias("n")).orderBy(*order).limit(top_k - 1)
    classes = top.select("category", (F.row_number().over(W.partitionBy(F.lit(0)).orderBy(*order)) - 1).alias("class"))
    labelled = per_user.join(F.broadcast(classes), "category", "left")
    value = F.when(F.col("category").isNull(), -1).otherwise(F.coalesce("class", F.lit(top_k - 1)))
    return labelled.select(WHO, value.alias("category"))


def labels(
    orders: DataFrame, items: DataFrame, products: DataFrame, customers: DataFrame, cutoff: Column | str,
    days: int = OBSERVATION_DAYS, min_history: int = MIN_HISTORY_DAYS, top_k: int = CATEGORY_CLASSES,
) -> DataFrame:
    """Churn, value and next category after the cutoff, each with a validity mask, for eligible customers."""
    at = as_timestamp(cutoff)
    end = plus_days(at, days)
    owned = owned_orders(orders, customers)
    observed = owned.where((F.col(AT) > at) & (F.col(AT) <= end))
    spent = (
        observed.select("order_id", WHO)
        .join(items.select("order_id", (F.col("price") + F.col("freight_value")).alias("total")), "order_id", "left")
        .groupBy(WHO)
        .agg(F.sum("total").alias("clv"))
    )
    spine = _checked(eligible(orders, customers, at, min_history), orders, end)
    out = spine.join(spent.withColumn("__seen", F.lit(1)), WHO, "left").join(
        category_labels(observed, items, products, top_k), WHO, "left"
    )
    churn = F.when(F.col("__seen").isNull(), 1).otherwise(0)
    category = F.coalesce("category", F.lit(-1))
    return out.select(
        WHO,
        churn.alias("churn"),
        category.alias("category"),
        F.coalesce("clv", F.lit(0.0)).alias("clv"),
        F.lit(True).alias("churn_valid"),
        ((category >= 0) & (churn == 0)).alias("category_valid"),
        F.lit(True).alias("clv_valid"),
    )


def gated_orders(orders: DataFrame, customers: DataFrame, cutoff: Column | str) -> DataFrame:
    return owned_orders(orders, customers).where(F.col(AT) <= as_timestamp(cutoff))


def features(orders: DataFrame, items: DataFrame, customers: DataFrame, cutoff: Column | str) -> DataFrame:
    """Recency, frequency, money, mean order, tenure and items up to the cutoff."""
    at = as_timestamp(cutoff)
    totals = items.groupBy("order_id").agg(
        F.sum(F.col("price") + F.col("freight_value")).alias("total"), F.count("product_id").alias("n_items")
    )
    return (
        gated_orders(orders, customers, at)
        .join(totals, "order_id", "left")
        .groupBy(WHO)
        .agg(
            floor_days(F.max(AT), at).alias("recency_days"),
            F.countDistinct("order_id").alias("frequency"),
            F.coalesce(F.sum("total"), F.lit(0.0)).alias("monetary"),
            F.coalesce(F.avg("total"), F.lit(0.0)).alias("avg_order_value"),
            floor_days(F.min(AT), at).alias("tenure_days"),
            F.coalesce(F.sum("n_items"), F.lit(0)).alias("n_items"),
        )
    )


def pad_right(values: Column, length: int, zero: Column) -> Column:
    return F.concat(values, F.array_repeat(zero, F.lit(length) - F.size(values)))


def sequences(
    orders: DataFrame, items: DataFrame, customers: DataFrame, cutoff: Column | str, length: int = SEQUENCE_LENGTH
) -> DataFrame:
    """Last products, days before the cutoff and mask per customer, zero-padded on the right."""
    at = as_timestamp(cutoff)
    bought = gated_orders(orders, customers, at).join(items.select("order_id", "product_id"), "order_id")
    vocab = global_row_number(bought.select("product_id").distinct(), ["product_id"], "product_idx")
    order = [F.col(AT).desc(), F.col("order_id").desc(), F.col("product_id").desc()]
    last = top_rows(bought.select(WHO, AT, "order_id", "product_id"), [WHO], order, length, out="back")
    steps = last.join(vocab, "product_id").select(
        WHO,
        F.struct(
            (-F.col("back")).alias("at"),
            F.col("product_idx").cast("int").alias("product_idx"),
            days_between(AT, at).cast("float").alias("days"),
        ).alias("e"),
    )
    row = steps.groupBy(WHO).agg(F.array_sort(F.collect_list("e")).alias("es"))
    return row.select(
        WHO,
        pad_right(F.transform("es", lambda e: e["product_idx"]), length, F.lit(0)).alias("product_ids"),
        pad_right(F.transform("es", lambda e: e["days"]), length, F.lit(0.0).cast("float")).alias("days_before"),
        pad_right(F.transform("es", lambda e: F.lit(True)), length, F.lit(False)).alias("mask"),
    )


def time_features(days: Column | str) -> Column:
    """``[log1p(d), d/30, d/365]`` per step; negative gaps count as 0."""
    days = F.col(days) if isinstance(days, str) else days

    def expand(d: Column) -> Column:
        d = F.greatest(d.cast("double"), F.lit(0.0))
        return F.array(F.log1p(d), d / 30.0, d / 365.0)

    return F.transform(days, expand)


def top_categories(
    orders: DataFrame, items: DataFrame, products: DataFrame, customers: DataFrame, cutoff: Column | str,
    spine: DataFrame, top_k: int = 3,
) -> DataFrame:
    """Ids of each customer's most bought categories up to the cutoff, padded with 0."""
    kinds = products.select("product_id", F.col("product_category_name").alias("category"))
    bought = gated_orders(orders, customers, cutoff).join(items.select("order_id", "product_id"), "order_id").join(
        kinds, "product_id"
    )
    counts = bought.where(F.col("category").isNotNull()).groupBy(WHO, "category").agg(F.count(F.lit(1)).alias("n"))
    vocab = global_row_number(counts.select("category").distinct(), ["category"], "idx")
    best = top_rows(counts, [WHO], [F.col("n").desc(), F.col("category")], top_k, out="place")
    lists = best.join(vocab, "category").groupBy(WHO).agg(
        F.array_sort(F.collect_list(F.struct("place", F.col("idx").cast("int").alias("idx")))).alias("es")
    )
    ids = pad_right(F.coalesce(F.transform("es", lambda e: e["idx"]), F.array().cast("array<int>")), top_k, F.lit(0))
    return spine.select(WHO).join(lists, WHO, "left").select(WHO, ids.alias("category_ids"))


def aligned(labels_: DataFrame, features_: DataFrame, sequences_: DataFrame, length: int = SEQUENCE_LENGTH) -> DataFrame:
    """Labels, features and sequences of the customers that have both; an absent sequence is all padding."""
    out = labels_.join(features_, WHO).join(sequences_, WHO, "left")
    return out.withColumns({
        "product_ids": F.coalesce("product_ids", F.array_repeat(F.lit(0), length)),
        "days_before": F.coalesce("days_before", F.array_repeat(F.lit(0.0).cast("float"), length)),
        "mask": F.coalesce("mask", F.array_repeat(F.lit(False), length)),
    })


def leak_violations(labels_: DataFrame, features_: DataFrame | None = None) -> DataFrame:
    """Rows that break an invariant: churners without spend and without category, no negative recency."""
    churned = F.col("churn") == 1
    out = labels_.agg(
        F.count_if(churned & (F.col("clv") > 0)).alias("churner_with_value"),
        F.count_if(churned & F.col("category_valid")).alias("churner_with_category"),
    ).unpivot([], ["churner_with_value", "churner_with_category"], "check", "violations")
    if features_ is not None:
        late = features_.agg(F.count_if(F.col("recency_days") < 0).alias("n"))
        out = out.unionByName(late.select(F.lit("negative_recency").alias("check"), F.col("n").alias("violations")))
    return out
