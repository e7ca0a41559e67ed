"""Explicit schemas of the input tables and the minimum columns of the canonical ones."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Column names of the raw commerce files (two are misspelt in the data itself).
RAW_SCHEMAS: dict[str, str] = {
    "customers": "customer_id string, customer_unique_id string, customer_zip_code_prefix int, "
    "customer_city string, customer_state string",
    "orders": "order_id string, customer_id string, order_status string, "
    "order_purchase_timestamp string, order_approved_at string, order_delivered_carrier_date string, "
    "order_delivered_customer_date string, order_estimated_delivery_date string",
    "order_items": "order_id string, order_item_id int, product_id string, seller_id string, "
    "shipping_limit_date string, price double, freight_value double",
    "payments": "order_id string, payment_sequential int, payment_type string, "
    "payment_installments int, payment_value double",
    "reviews": "review_id string, order_id string, review_score int, review_comment_title string, "
    "review_comment_message string, review_creation_date string, review_answer_timestamp string",
    "products": "product_id string, product_category_name string, product_name_lenght double, "
    "product_description_lenght double, product_photos_qty double, product_weight_g double, "
    "product_length_cm double, product_height_cm double, product_width_cm double",
    "sellers": "seller_id string, seller_zip_code_prefix int, seller_city string, seller_state string",
    "geolocation": "geolocation_zip_code_prefix int, geolocation_lat double, geolocation_lng double, "
    "geolocation_city string, geolocation_state string",
    "category_translation": "product_category_name string, product_category_name_english string",
}
OPTIONAL_TABLES = ("geolocation", "category_translation")
DATETIME_COLUMNS: dict[str, tuple[str, ...]] = {
    "orders": (
        "order_purchase_timestamp",
        "order_approved_at",
        "order_delivered_carrier_date",
        "order_delivered_customer_date",
        "order_estimated_delivery_date",
    ),
    "reviews": ("review_creation_date", "review_answer_timestamp"),
}
CANONICAL_COLUMNS: dict[str, tuple[str, ...]] = {
    "demographics": ("user_id", "registration_date", "city", "user_segment"),
    "transactions": ("transaction_id", "user_id", "product_id", "timestamp", "amount", "quantity"),
    "web_behavior": ("event_id", "user_id", "product_id", "event_type", "timestamp", "session_id"),
    "campaigns": ("user_id", "campaign_id", "timestamp", "clicked"),
}
CAMPAIGN_SCHEMA = "user_id string, campaign_id string, timestamp timestamp_ntz, clicked bigint"


class LazyTables(Mapping):
    """Named tables, each defined when first asked for."""

    def __init__(self, makers: Mapping[str, Callable[[], DataFrame] | DataFrame]):
        self._makers = dict(makers)
        self._made: dict[str, DataFrame] = {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._made:
            maker = self._makers[name]
            self._made[name] = maker if isinstance(maker, DataFrame) else maker()
        return self._made[name]

    def __iter__(self) -> Iterator[str]:
        return iter(self._makers)

    def __len__(self) -> int:
        return len(self._makers)

    def replaced(self, tables: Mapping[str, Callable[[], DataFrame] | DataFrame]) -> LazyTables:
        """The same tables with some replaced or added."""
        return LazyTables(self._makers | dict(tables))


def empty(spark: SparkSession, schema: str) -> DataFrame:
    return spark.createDataFrame([], T._parse_datatype_string(schema))


def coerce_datetimes(df: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """Text to timestamps without a zone; what does not parse becomes NULL."""
    present = {c: F.col(c).try_cast("timestamp_ntz") for c in columns if c in df.columns}
    return df.withColumns(present) if present else df


def category_name(original: Column | str, translated: Column | str) -> Column:
    return F.coalesce(translated if isinstance(translated, Column) else F.col(translated),
                      original if isinstance(original, Column) else F.col(original))


def missing_columns(tables: dict[str, DataFrame]) -> list[tuple[str, list[str]]]:
    """Schema probe: reads only the schemas, no rows."""
    out = []
    for name, needed in CANONICAL_COLUMNS.items():
        have = set(tables[name].columns) if name in tables else set()
        out.append((name, [c for c in needed if c not in have]))
    return out
