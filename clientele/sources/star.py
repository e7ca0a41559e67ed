"""Adapters from the star-schema test tables to the commerce and event inputs.

Stand-ins are documented in FIXTURES.md; the check SQL in the catalog holds the same expressions.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clientele.functions.timeutil import plus_days
from clientele.sources.contracts import LazyTables


# Schemas of the test tables; stating them saves a footer-reading job per table.
SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
    "pages": "page_id bigint, url string, html string",
    "benchmark": "item_id bigint, text string",
    "labels": "doc_id bigint, quality int, toxic int",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
}


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{root}/{name}.parquet")


def customers(spark: SparkSession, root: str) -> DataFrame:
    # nation and region have a fixed size (25 and 5 rows)
    nation = table(spark, root, "nation").join(
        F.broadcast(table(spark, root, "region")), F.col("n_regionkey") == F.col("r_regionkey")
    )
    return (
        table(spark, root, "customer")
        .join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey"), "left")
        .select(
            F.col("c_custkey").cast("string").alias("customer_id"),
            F.col("c_custkey").cast("string").alias("customer_unique_id"),
            F.col("c_nationkey").alias("customer_zip_code_prefix"),
            F.col("n_name").alias("customer_city"),
            F.col("r_name").alias("customer_state"),
        )
    )


def orders(spark: SparkSession, root: str, lifecycle: bool = True) -> DataFrame:
    """Orders; with ``lifecycle`` the shipping and delivery times come from the order's lines."""
    base = table(spark, root, "orders").select(
        F.col("o_orderkey").cast("string").alias("order_id"),
        F.col("o_custkey").cast("string").alias("customer_id"),
        F.when(F.col("o_orderstatus") == "P", "canceled")
        .when(F.col("o_orderstatus") == "F", "delivered")
        .otherwise("shipped")
        .alias("order_status"),
        F.col("o_orderdate").alias("order_purchase_timestamp"),
    )
    if not lifecycle:
        return base
    shipped = (
        table(spark, root, "lineitem")
        .groupBy(F.col("l_orderkey").cast("string").alias("order_id"))
        .agg(
            F.min("l_shipdate").alias("order_delivered_carrier_date"),
            F.max("l_shipdate").alias("order_delivered_customer_date"),
        )
    )
    return base.join(shipped, "order_id", "left").select(
        "order_id",
        "customer_id",
        "order_status",
        "order_purchase_timestamp",
        F.lit(None).cast("timestamp_ntz").alias("order_approved_at"),
        "order_delivered_carrier_date",
        "order_delivered_customer_date",
        plus_days("order_purchase_timestamp", 30).alias("order_estimated_delivery_date"),
    )


def order_items(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("order_id"),
        F.col("l_linenumber").alias("order_item_id"),
        F.col("l_partkey").cast("string").alias("product_id"),
        F.col("l_suppkey").cast("string").alias("seller_id"),
        F.col("l_extendedprice").alias("price"),
        # the small shift keeps both engines on the same side of a rounding tie
        F.round(F.col("l_extendedprice") * F.col("l_tax") + 1e-7, 2).alias("freight_value"),
    )


def payments(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "orders").select(
        F.col("o_orderkey").cast("string").alias("order_id"),
        F.col("o_orderpriority").alias("payment_type"),
        F.substring("o_orderpriority", 1, 1).cast("int").alias("payment_installments"),
        F.col("o_totalprice").alias("payment_value"),
    )


def reviews(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("order_id"),
        F.when(F.col("l_returnflag") == "R", 1).when(F.col("l_returnflag") == "A", 3).otherwise(5)
        .alias("review_score"),
        F.when(F.col("l_linestatus") == "F", F.col("l_returnflag")).alias("review_comment_message"),
        plus_days("l_shipdate", 7).alias("review_creation_date"),
    )


def products(spark: SparkSession, root: str) -> DataFrame:
    size = F.col("p_size").cast("double")
    return table(spark, root, "part").select(
        F.col("p_partkey").cast("string").alias("product_id"),
        F.col("p_type").alias("product_category_name"),
        F.col("p_type").alias("category_english"),
        F.col("p_retailprice").alias("product_weight_g"),
        size.alias("product_length_cm"),
        size.alias("product_height_cm"),
        size.alias("product_width_cm"),
        F.lit(None).cast("double").alias("product_photos_qty"),
        F.length("p_name").cast("double").alias("product_name_lenght"),
        F.lit(None).cast("double").alias("product_description_lenght"),
    )


def sellers(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "supplier").select(F.col("s_suppkey").cast("string").alias("seller_id"))


def commerce(spark: SparkSession, root: str) -> LazyTables:
    makers = {"customers": customers, "orders": orders, "order_items": order_items, "payments": payments,
              "reviews": reviews, "products": products, "sellers": sellers}
    return LazyTables({name: partial(make, spark, root) for name, make in makers.items()})


def lean_commerce(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """The four tables of the cutoff-gated operators, without lifecycle times."""
    return {
        "customers": customers(spark, root),
        "orders": orders(spark, root, lifecycle=False),
        "order_items": order_items(spark, root),
        "products": products(spark, root),
    }


def user_events(spark: SparkSession, root: str) -> DataFrame:
    """The event log, with the product category looked up from the event's product."""
    return with_categories(spark, root, table(spark, root, "events"))


def with_categories(spark: SparkSession, root: str, events: DataFrame) -> DataFrame:
    """Raw events, a table or a stream, as the event log."""
    kind = F.col("event_type")
    events = events.select(
        "event_id",
        F.col("user_id").cast("string").alias("user_id"),
        F.col("ts").alias("event_timestamp"),
        F.when(kind == "view", "page_view").when(kind == "click", "add_to_cart").otherwise(kind).alias("event_type"),
        F.col("value").alias("revenue"),
        F.get_json_object("props", "$.k").alias("product_id"),
    )
    part = table(spark, root, "part").select(
        F.col("p_partkey").cast("string").alias("product_id"), F.col("p_type").alias("product_category")
    )
    return events.join(part, "product_id", "left")


def user_profiles(spark: SparkSession, root: str) -> DataFrame:
    nation = table(spark, root, "nation").select("n_nationkey", F.col("n_name").alias("city"))
    return (
        table(spark, root, "customer")
        .join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey"), "left")
        .select(
            F.col("c_custkey").cast("string").alias("user_id"),
            (F.col("c_custkey") % 60 + 16).cast("int").alias("age"),
            F.when(F.col("c_custkey") % 2 == 0, "Female").otherwise("Male").alias("gender"),
            "city",
        )
    )
