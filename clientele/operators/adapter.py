"""Raw commerce tables to clean orders and the four canonical tables."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clientele.functions import rules as R
from clientele.functions.timeutil import floor_days
from clientele.operators.ordering import global_row_number, settled
from clientele.sources import contracts as C
from clientele.sources.contracts import LazyTables

# The attributes items take over from products.
PRODUCT_ATTRIBUTES = (
    "category_english", "product_weight_g", "product_length_cm", "product_height_cm", "product_width_cm",
    "product_photos_qty", "product_name_lenght", "product_description_lenght",
)


def valid_orders(orders: DataFrame, statuses: tuple[str, ...] = R.VALID_ORDER_STATUSES) -> DataFrame:
    return orders.where(F.col("order_status").isin(*statuses)).dropna(subset=["order_purchase_timestamp"])


def not_excluded(orders: DataFrame, statuses: tuple[str, ...] = R.EXCLUDED_ORDER_STATUSES) -> DataFrame:
    """Everything but the excluded states; orders without a state stay."""
    return orders.where(F.col("order_status").isNull() | ~F.col("order_status").isin(*statuses))


def payments_per_order(payments: DataFrame) -> DataFrame:
    types = F.array_sort(F.collect_set("payment_type"))
    return payments.groupBy("order_id").agg(
        F.sum("payment_value").alias("total_payment"),
        F.max("payment_installments").alias("n_installments"),
        F.array_join(types, ",").alias("payment_types"),
        F.size(types).alias("n_payment_methods"),
    )


def reviews_per_order(reviews: DataFrame) -> DataFrame:
    return reviews.groupBy("order_id").agg(
        F.avg("review_score").alias("review_score"),
        F.bool_or(F.col("review_comment_message").isNotNull()).alias("has_review_comment"),
    )


def with_delivery(orders: DataFrame) -> DataFrame:
    """Days to delivery, and days past the estimate (negative is early)."""
    return orders.withColumns(
        {
            "delivery_days": floor_days("order_purchase_timestamp", "order_delivered_customer_date"),
            "delivery_vs_estimate": floor_days("order_estimated_delivery_date", "order_delivered_customer_date"),
        }
    )


def with_owner(orders: DataFrame, customers: DataFrame, min_orders: int = 1) -> DataFrame:
    """Stable customer id per order; NULL where unknown or where the customer has too few orders."""
    people = customers.select("customer_id", "customer_unique_id")
    owner = orders.join(people, "customer_id", "left")
    if min_orders <= 1:
        return owner
    active = owner.groupBy("customer_unique_id").count().where(F.col("count") >= min_orders)
    active = active.select("customer_unique_id", F.lit(True).alias("__active"))
    return owner.join(active, "customer_unique_id", "left").withColumn(
        "customer_unique_id", F.when(F.col("__active"), F.col("customer_unique_id"))
    ).drop("__active")


def with_attributes(items: DataFrame, products: DataFrame) -> DataFrame:
    attributes = [c for c in PRODUCT_ATTRIBUTES if c in products.columns]
    if "category_english" not in attributes:
        return items
    return items.join(products.select("product_id", *attributes), "product_id", "left")


def clean(
    tables: Mapping[str, DataFrame],
    statuses: tuple[str, ...] = R.VALID_ORDER_STATUSES,
    min_orders: int = 1,
) -> LazyTables:
    """Clean tables. A left join stays in a plan even when its columns are not read, so each level is a table:

    ``owned_orders`` valid orders with customer and delivery days; ``orders`` adds payments and reviews;
    ``owned_items`` items of valid orders with their owner and time; ``order_items`` adds product attributes;
    ``payments`` and ``reviews`` of valid orders; ``all_payments`` and ``all_reviews`` as given.
    """
    kept = valid_orders(tables["orders"], statuses)
    owner = with_owner(kept, tables["customers"], min_orders)
    valid = kept.select("order_id")
    out: LazyTables

    def owned_orders() -> DataFrame:
        return with_delivery(owner.where(F.col("customer_unique_id").isNotNull()))

    def orders() -> DataFrame:
        paid = out["owned_orders"].join(payments_per_order(tables["payments"]), "order_id", "left")
        return paid.join(reviews_per_order(tables["reviews"]), "order_id", "left")

    def owned_items() -> DataFrame:
        ids = owner.select("order_id", "customer_unique_id", "order_purchase_timestamp").dropDuplicates(["order_id"])
        return tables["order_items"].join(ids, "order_id")

    base = tables if isinstance(tables, LazyTables) else LazyTables(tables)
    out = base.replaced({
        "owned_orders": owned_orders,
        "orders": orders,
        "owned_items": owned_items,
        "order_items": lambda: with_attributes(out["owned_items"], tables["products"]),
        "payments": lambda: tables["payments"].join(valid, "order_id", "left_semi"),
        "reviews": lambda: tables["reviews"].join(valid, "order_id", "left_semi"),
        "all_payments": lambda: tables["payments"],
        "all_reviews": lambda: tables["reviews"],
    })
    return out


def demographics(data: Mapping[str, DataFrame]) -> DataFrame:
    """One row per customer with first order, last known place, tenure and segment."""
    at = F.col("order_purchase_timestamp")
    # equal times are settled by the order id
    latest = F.struct(at, F.col("order_id"))
    info = data["owned_orders"].groupBy("customer_unique_id").agg(
        F.min(at).alias("first_order"),
        F.max(at).alias("last_order"),
        F.countDistinct("order_id").alias("total_orders"),
        F.max_by("customer_id", latest).alias("customer_id"),
    )
    places = data["customers"].select(
        "customer_id", "customer_city", "customer_state", "customer_zip_code_prefix"
    ).dropDuplicates(["customer_id"])
    return info.join(places, "customer_id", "left").select(
        F.col("customer_unique_id").alias("user_id"),
        F.col("first_order").alias("registration_date"),
        F.coalesce("customer_city", F.lit("unknown")).alias("city"),
        F.coalesce("customer_state", F.lit("unknown")).alias("state"),
        F.coalesce("customer_zip_code_prefix", F.lit(0)).cast("int").alias("zip_prefix"),
        floor_days("first_order", "last_order").alias("tenure_days"),
        "total_orders",
        R.order_segment("total_orders").alias("user_segment"),
        F.lit("unknown").alias("gender"),
    )


def transactions(data: Mapping[str, DataFrame], order_id: bool = False) -> DataFrame:
    """One row per order item, with the buyer, the time and the full item cost; if asked for, with its order."""
    scores = data["all_reviews"].groupBy("order_id").agg(F.avg("review_score").alias("review_score"))
    bought = data["owned_items"].where(F.col("customer_unique_id").isNotNull())
    return bought.join(scores, "order_id", "left").select(
        F.concat_ws("_", "order_id", F.col("order_item_id").cast("string")).alias("transaction_id"),
        F.col("customer_unique_id").alias("user_id"),
        "product_id",
        F.col("order_purchase_timestamp").alias("timestamp"),
        (F.col("price") + F.col("freight_value")).alias("amount"),
        F.lit(1).alias("quantity"),
        "price",
        F.col("freight_value").alias("freight"),
        "seller_id",
        "review_score",
        *(["order_id"] if order_id else []),
    )


def computed_once(data: LazyTables) -> tuple[LazyTables, DataFrame]:
    """Clean tables and transactions that read two written tables, for features that need orders and items many times.

    ``owned_items`` and ``order_items`` are then the items of known customers, without their number in the order.
    """
    sold = settled(transactions(data, order_id=True))
    items = sold.select(
        "order_id", "product_id", "seller_id", "price", F.col("freight").alias("freight_value"),
        F.col("user_id").alias("customer_unique_id"), F.col("timestamp").alias("order_purchase_timestamp"),
    )
    out = data.replaced({
        "owned_orders": settled(data["owned_orders"]),
        "owned_items": items,
        "order_items": with_attributes(items, data["products"]),
    })
    return out, sold.drop("order_id")


def journey_events(data: Mapping[str, DataFrame], short_ids: bool = False) -> DataFrame:
    """Order life as events: four order stages, one purchase per item, one review per order.

    Stages and reviews are named after their order; ``short_ids`` keeps only the first eight letters
    of its id, which lets different orders share a name.
    """
    named = F.substring("order_id", 1, 8) if short_ids else F.col("order_id")
    orders = data["owned_orders"]
    # Stage names and the order columns that hold their times.
    stages = {
        "order_placed": "order_purchase_timestamp",
        "payment_approved": "order_approved_at",
        "shipped": "order_delivered_carrier_date",
        "delivered": "order_delivered_customer_date",
    }
    steps = [F.struct(F.lit(k).alias("event_type"), F.col(c).alias("timestamp")) for k, c in stages.items()]
    placed = orders.select(
        F.col("customer_unique_id").alias("user_id"),
        F.concat(F.lit("ORDER_"), named).alias("product_id"),
        F.inline(F.array(*steps)),
        F.col("order_id").alias("session_id"),
    ).where(F.col("timestamp").isNotNull())

    bought = data["owned_items"].where(F.col("customer_unique_id").isNotNull()).select(
        F.col("customer_unique_id").alias("user_id"), "product_id", F.lit("purchase").alias("event_type"),
        F.col("order_purchase_timestamp").alias("timestamp"), F.col("order_id").alias("session_id"),
    )

    owner = orders.select("order_id", F.col("customer_unique_id").alias("user_id")).dropDuplicates(["order_id"])
    scored = F.col("review_score").isNotNull()
    first = data["all_reviews"].groupBy("order_id").agg(
        F.min("review_creation_date").alias("__created"),
        F.min_by(F.when(scored, F.col("review_score")),
                 F.when(scored, F.struct("review_creation_date", "review_score"))).alias("__score"),
    )
    reviewed = first.where(F.col("__created").isNotNull()).join(owner, "order_id").select(
        "user_id",
        F.concat(F.lit("REVIEW_"), named).alias("product_id"),
        F.concat(F.lit("review_score_"), F.col("__score").cast("int").cast("string")).alias("event_type"),
        F.col("__created").alias("timestamp"),
        F.col("order_id").alias("session_id"),
    )
    return placed.unionByName(bought).unionByName(reviewed)


def number_events(events: DataFrame) -> DataFrame:
    """Dense event ids in the order of user and time."""
    order = ["user_id", "timestamp", "session_id", "event_type", "product_id"]
    return global_row_number(events, order, out="event_id")


def web_behavior(data: Mapping[str, DataFrame], dense_ids: bool = True) -> DataFrame:
    """Journey events with an id: dense and ordered, or a hash that needs no global sort."""
    events = journey_events(data)
    if dense_ids:
        return number_events(events)
    return events.withColumn("event_id", F.xxhash64("user_id", "timestamp", "session_id", "event_type", "product_id"))


def campaigns(spark: SparkSession) -> DataFrame:
    """The commerce tables hold no campaigns: an empty table of the right schema."""
    return C.empty(spark, C.CAMPAIGN_SCHEMA)


def canonical_tables(data: Mapping[str, DataFrame], dense_ids: bool = True) -> dict[str, DataFrame]:
    return {
        "demographics": demographics(data),
        "transactions": transactions(data),
        "web_behavior": web_behavior(data, dense_ids),
        "campaigns": campaigns(data["owned_orders"].sparkSession),
    }
