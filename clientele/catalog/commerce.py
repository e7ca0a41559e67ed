"""Queries of the commerce tables: cleaning, canonical tables, targets, features and sequences."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clientele.catalog import query
from clientele.catalog.common import CLEAN, comparable, sql_days, sql_round
from clientele.operators import adapter as A
from clientele.operators import features as X
from clientele.operators import targets as G
from clientele.operators.ordering import settled
from clientele.sources import readers, star

PAYMENT_FLAGS = {"uses_credit_card": "1-URGENT", "uses_boleto": "5-LOW"}


def cleaned(spark: SparkSession, root: str) -> Mapping[str, DataFrame]:
    return A.clean(star.commerce(spark, root))


def txn_of(spark: SparkSession, root: str) -> DataFrame:
    return A.transactions(cleaned(spark, root))


def spine(spark: SparkSession, root: str) -> DataFrame:
    """Every customer of the table, also those without a valid order."""
    return star.customers(spark, root).select(F.col("customer_unique_id").alias("user_id"))


SPINE_SQL = f"WITH {CLEAN}, spine AS (SELECT customer_unique_id AS user_id FROM raw_customers), " \
    "fin AS (SELECT max(ts) AS e FROM txn)"  # fmt: skip


@query(
    "load_summary",
    f"""WITH {CLEAN}
    SELECT 'orders' AS item, CAST(count(*) AS VARCHAR) AS value FROM raw_orders
    UNION ALL SELECT 'customers', CAST(count(DISTINCT customer_unique_id) AS VARCHAR) FROM raw_customers
    UNION ALL SELECT 'products', CAST(count(*) AS VARCHAR) FROM raw_products
    UNION ALL SELECT 'sellers', CAST(count(*) AS VARCHAR) FROM supplier
    UNION ALL SELECT 'first_order', strftime(min(ts), '%Y-%m-%d') FROM raw_orders
    UNION ALL SELECT 'last_order', strftime(max(ts), '%Y-%m-%d') FROM raw_orders
    UNION ALL SELECT 'status:' || order_status, CAST(count(*) AS VARCHAR) FROM raw_orders GROUP BY order_status""",
)
def load_summary(spark: SparkSession, root: str) -> DataFrame:
    return readers.load_summary(star.commerce(spark, root))


@query(
    "clean_orders",
    f"""WITH {CLEAN}
    SELECT order_id, customer_id, order_status, strftime(ts, '%Y-%m-%d %H:%M:%S') AS order_purchase_timestamp,
           customer_unique_id, {sql_round('total_payment', 2)} AS total_payment,
           CAST(n_installments AS BIGINT) AS n_installments, payment_types,
           CAST(n_payment_methods AS BIGINT) AS n_payment_methods, {sql_round('review_score')} AS review_score,
           has_review_comment, delivery_days, delivery_vs_estimate FROM clean_orders""",
)
def clean_orders(spark: SparkSession, root: str) -> DataFrame:
    df = cleaned(spark, root)["orders"].select(
        "order_id", "customer_id", "order_status", "order_purchase_timestamp", "customer_unique_id",
        F.round(F.col("total_payment") + 1e-9, 2).alias("total_payment"), "n_installments", "payment_types",
        "n_payment_methods", "review_score", "has_review_comment", "delivery_days", "delivery_vs_estimate",
    )
    return comparable(df)


@query(
    "clean_order_items",
    f"""WITH {CLEAN} SELECT product_id, category, count(*) AS n, {sql_round('sum(price)', 2)} AS price,
        {sql_round('sum(freight)', 2)} AS freight FROM clean_items GROUP BY 1, 2""",
)
def clean_order_items(spark: SparkSession, root: str) -> DataFrame:
    items = cleaned(spark, root)["order_items"]
    return comparable(
        items.groupBy("product_id", F.col("category_english").alias("category")).agg(
            F.count(F.lit(1)).alias("n"), F.sum("price").alias("price"), F.sum("freight_value").alias("freight")
        ),
        2,
    )


@query(
    "delivery_performance",
    f"""WITH {CLEAN} SELECT delivery_days, delivery_vs_estimate, count(*) AS n FROM clean_orders GROUP BY 1, 2""",
)
def delivery_performance(spark: SparkSession, root: str) -> DataFrame:
    orders = A.with_delivery(A.valid_orders(star.orders(spark, root)))
    return orders.groupBy("delivery_days", "delivery_vs_estimate").agg(F.count(F.lit(1)).alias("n"))


@query(
    "demographics",
    f"""WITH {CLEAN}, info AS (
      SELECT customer_unique_id AS user_id, min(ts) AS a, max(ts) AS b, count(DISTINCT order_id) AS n
      FROM clean_orders GROUP BY 1)
    SELECT i.user_id, strftime(a, '%Y-%m-%d %H:%M:%S') AS registration_date, coalesce(city, 'unknown') AS city,
           coalesce(state, 'unknown') AS state, CAST(coalesce(zip, 0) AS BIGINT) AS zip_prefix,
           {sql_days('a', 'b')} AS tenure_days, n AS total_orders,
           CASE WHEN n <= 1 THEN 'one_time' WHEN n <= 2 THEN 'returning' WHEN n <= 4 THEN 'regular'
                ELSE 'power_buyer' END AS user_segment, 'unknown' AS gender
    FROM info i LEFT JOIN raw_customers c ON c.customer_id = i.user_id""",
)
def demographics(spark: SparkSession, root: str) -> DataFrame:
    return comparable(A.demographics(cleaned(spark, root)))


TXN_SELECT = f"""SELECT transaction_id, user_id, product_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS "timestamp",
   {sql_round('amount', 2)} AS amount, CAST(1 AS BIGINT) AS quantity, {sql_round('price', 2)} AS price,
   {sql_round('freight', 2)} AS freight, seller_id, {sql_round('review_score', 2)} AS review_score FROM txn"""


@query("transactions", f"WITH {CLEAN} {TXN_SELECT}")
def transactions(spark: SparkSession, root: str) -> DataFrame:
    return comparable(txn_of(spark, root), 2)


EVENTS_SQL = f"""WITH {CLEAN},
placed AS (
  SELECT customer_unique_id AS user_id, 'ORDER_' || order_id AS product_id, event_type, t AS ts, order_id AS session_id
  FROM (SELECT customer_unique_id, order_id, 'order_placed' AS event_type, ts AS t FROM clean_orders
        UNION ALL SELECT customer_unique_id, order_id, 'shipped', carrier FROM clean_orders
        UNION ALL SELECT customer_unique_id, order_id, 'delivered', delivered FROM clean_orders) WHERE t IS NOT NULL),
bought AS (SELECT o.customer_unique_id AS user_id, i.product_id, 'purchase' AS event_type, o.ts, i.order_id AS session_id
           FROM clean_items i JOIN clean_orders o USING (order_id)),
first_review AS (SELECT order_id, score, created FROM raw_reviews
                 QUALIFY row_number() OVER (PARTITION BY order_id ORDER BY created, score) = 1),
reviewed AS (SELECT o.customer_unique_id AS user_id, 'REVIEW_' || order_id AS product_id,
                    'review_score_' || score AS event_type, created AS ts, order_id AS session_id
             FROM first_review JOIN clean_orders o USING (order_id)),
journey AS (SELECT * FROM placed UNION ALL SELECT * FROM bought UNION ALL SELECT * FROM reviewed),
numbered AS (SELECT *, row_number() OVER (ORDER BY user_id, ts, session_id, event_type, product_id) AS event_id FROM journey)"""


@query(
    "order_journey_events",
    EVENTS_SQL + """ SELECT event_id, user_id, product_id, event_type, strftime(ts, '%Y-%m-%d %H:%M:%S') AS "timestamp",
       session_id FROM numbered""",
)
def order_journey_events(spark: SparkSession, root: str) -> DataFrame:
    return comparable(A.web_behavior(cleaned(spark, root)))


@query(
    "journey_event_histogram",
    EVENTS_SQL + " SELECT event_type, count(*) AS n, count(DISTINCT session_id) AS sessions FROM journey GROUP BY 1",
)
def journey_event_histogram(spark: SparkSession, root: str) -> DataFrame:
    events = A.journey_events(cleaned(spark, root))
    return events.groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("session_id").alias("sessions")
    )


# ---------------------------------------------------------------- targets

CHURN = """CASE WHEN max(ts) IS NULL OR max(ts) < (SELECT e FROM fin) - INTERVAL 90 DAY THEN 1 ELSE 0 END"""


@query(
    "target_churn",
    SPINE_SQL + f" SELECT user_id, CAST({CHURN} AS BIGINT) AS churn FROM spine LEFT JOIN txn USING (user_id) GROUP BY 1",
)
def target_churn(spark: SparkSession, root: str) -> DataFrame:
    return comparable(G.churn(spine(spark, root), txn_of(spark, root)))


@query(
    "target_clv",
    SPINE_SQL + f" SELECT user_id, {sql_round('coalesce(sum(amount), 0)', 2)} AS clv FROM spine LEFT JOIN txn USING (user_id) GROUP BY 1",
)
def target_clv(spark: SparkSession, root: str) -> DataFrame:
    return comparable(G.clv(spine(spark, root), txn_of(spark, root)), 2)


UPSELL_SQL = """, per_order AS (SELECT user_id, ts, sum(amount) AS total FROM txn GROUP BY 1, 2),
placed AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS rn, count(*) OVER (PARTITION BY user_id) AS n
           FROM per_order),
halves AS (SELECT user_id, avg(total) FILTER (WHERE rn <= n // 2) AS a, avg(total) FILTER (WHERE rn > n // 2) AS b
           FROM placed GROUP BY 1),
up AS (SELECT user_id, CAST(coalesce(CASE WHEN a > 0 AND (b - a) / a >= 0.2::DOUBLE THEN 1 ELSE 0 END, 0) AS BIGINT) AS upsell
       FROM spine LEFT JOIN halves USING (user_id))"""


@query("target_upsell", SPINE_SQL + UPSELL_SQL + " SELECT * FROM up")
def target_upsell(spark: SparkSession, root: str) -> DataFrame:
    return comparable(G.upsell(spine(spark, root), txn_of(spark, root)))


ITEM_SQL = """, lastitem AS (SELECT user_id, product_id AS next_item_id FROM txn WHERE product_id IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, transaction_id DESC, product_id DESC) = 1),
nexti AS (SELECT user_id, coalesce(next_item_id, 'NONE') AS next_item_id FROM spine LEFT JOIN lastitem USING (user_id))"""


@query("target_next_item", SPINE_SQL + ITEM_SQL + " SELECT * FROM nexti")
def target_next_item(spark: SparkSession, root: str) -> DataFrame:
    return G.next_item(spine(spark, root), txn_of(spark, root))


EARLY_SQL = f""", launch AS (SELECT product_id, min(ts) AS first_seen FROM txn GROUP BY 1),
early AS (SELECT DISTINCT user_id FROM txn JOIN launch USING (product_id) WHERE {sql_days('first_seen', 'ts')} <= 30),
adopt AS (SELECT user_id, CAST(CASE WHEN user_id IN (SELECT user_id FROM early) THEN 1 ELSE 0 END AS BIGINT) AS early_adopter FROM spine)"""


@query("target_early_adopter", SPINE_SQL + EARLY_SQL + " SELECT * FROM adopt")
def target_early_adopter(spark: SparkSession, root: str) -> DataFrame:
    return comparable(G.early_adopter(spine(spark, root), txn_of(spark, root)))


GAP_SQL = f""", backs AS (SELECT user_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC) AS back FROM txn),
lasts AS (SELECT user_id, max(ts) AS b, min(ts) AS a, count(*) AS n FROM backs WHERE back <= 2 GROUP BY 1),
gap AS (SELECT user_id, coalesce(least(CASE WHEN n >= 2 THEN {sql_days('a', 'b')} ELSE {sql_days('b', '(SELECT e FROM fin)')} END, 365), 365)
               AS days_next_purchase FROM spine LEFT JOIN lasts USING (user_id))"""


@query("target_days_to_next", SPINE_SQL + GAP_SQL + " SELECT * FROM gap")
def target_days_to_next(spark: SparkSession, root: str) -> DataFrame:
    return comparable(G.days_to_next(spine(spark, root), txn_of(spark, root)))


@query(
    "target_days_to_next_by_day",
    SPINE_SQL + GAP_SQL.replace("FROM txn)", "FROM (SELECT user_id, CAST(ts AS DATE) AS d, max(ts) AS ts FROM txn GROUP BY 1, 2))")
    + " SELECT * FROM gap",
)
def target_days_to_next_by_day(spark: SparkSession, root: str) -> DataFrame:
    return comparable(G.days_to_next(spine(spark, root), txn_of(spark, root), dedupe="day"))


RISK_SQL = """, sat AS (SELECT user_id, coalesce(avg(review_score), 3.0) AS s FROM spine LEFT JOIN txn USING (user_id) GROUP BY 1)"""
RISK_COLS = f"{sql_round('s')} AS avg_review_score, CAST(CASE WHEN round(s, 9) <= 2 THEN 1 ELSE 0 END AS BIGINT) AS satisfaction_risk"


@query("target_satisfaction_risk", SPINE_SQL + RISK_SQL + f" SELECT user_id, {RISK_COLS} FROM sat")
def target_satisfaction_risk(spark: SparkSession, root: str) -> DataFrame:
    return comparable(G.satisfaction_risk(spine(spark, root), txn_of(spark, root)))


TARGETS_SQL = (
    SPINE_SQL + UPSELL_SQL + ITEM_SQL + EARLY_SQL + GAP_SQL + RISK_SQL
    + f""", money AS (SELECT user_id, CAST({CHURN} AS BIGINT) AS churn, coalesce(sum(amount), 0) AS clv
                FROM spine LEFT JOIN txn USING (user_id) GROUP BY 1),
targets AS (SELECT user_id, churn, clv, upsell, next_item_id, early_adopter, days_next_purchase,
                   s AS avg_review_score, CAST(CASE WHEN round(s, 9) <= 2 THEN 1 ELSE 0 END AS BIGINT) AS satisfaction_risk
            FROM money JOIN up USING (user_id) JOIN nexti USING (user_id) JOIN adopt USING (user_id)
                 JOIN gap USING (user_id) JOIN sat USING (user_id))"""
)


def targets_of(spark: SparkSession, root: str) -> DataFrame:
    return G.all_targets(spine(spark, root), txn_of(spark, root))


@query(
    "all_targets",
    TARGETS_SQL + f""" SELECT user_id, churn, {sql_round('clv', 2)} AS clv, upsell, next_item_id, early_adopter,
        days_next_purchase, {sql_round('avg_review_score', 2)} AS avg_review_score, satisfaction_risk FROM targets""",
)
def all_targets(spark: SparkSession, root: str) -> DataFrame:
    return comparable(targets_of(spark, root), 2)


@query(
    "target_summary",
    TARGETS_SQL + f""", t AS (
      SELECT 'churn:rate' AS item, avg(churn) AS v FROM targets UNION ALL SELECT 'upsell:rate', avg(upsell) FROM targets
      UNION ALL SELECT 'early_adopter:rate', avg(early_adopter) FROM targets
      UNION ALL SELECT 'satisfaction_risk:rate', avg(satisfaction_risk) FROM targets
      UNION ALL SELECT 'clv:mean', avg(clv) FROM targets UNION ALL SELECT 'days_next_purchase:mean', avg(days_next_purchase) FROM targets
      UNION ALL SELECT 'next_item:valid_rate', avg(CASE WHEN next_item_id <> 'NONE' THEN 1 ELSE 0 END) FROM targets
      UNION ALL SELECT 'clv:median', median(clv) FROM targets UNION ALL SELECT 'days_next_purchase:median', median(days_next_purchase) FROM targets)
    SELECT item, {sql_round('v')} AS value FROM t""",
)
def target_summary(spark: SparkSession, root: str) -> DataFrame:
    return comparable(G.target_summary(targets_of(spark, root)))


@query(
    "ground_truth_targets",
    SPINE_SQL + f""" SELECT user_id,
      CAST(CASE WHEN max(ts) IS NULL OR {sql_days('max(ts)', '(SELECT e FROM fin)')} > 90 THEN 1 ELSE 0 END AS BIGINT) AS churned,
      {sql_round("coalesce(sum(amount) FILTER (WHERE ts >= (SELECT e FROM fin) - INTERVAL 365 DAY), 0)", 2)} AS clv,
      {sql_round("coalesce(sum(amount), 0)", 2)} AS total_spend, count(transaction_id) AS order_count
    FROM spine LEFT JOIN txn USING (user_id) GROUP BY 1""",
)
def ground_truth_targets(spark: SparkSession, root: str) -> DataFrame:
    return comparable(G.ground_truth(spine(spark, root), txn_of(spark, root)), 2)


@query(
    "segment_profile",
    SPINE_SQL + f""", truth AS (SELECT user_id,
      CASE WHEN max(ts) IS NULL OR {sql_days('max(ts)', '(SELECT e FROM fin)')} > 90 THEN 1 ELSE 0 END AS churned,
      coalesce(sum(amount), 0) AS total_spend, count(transaction_id) AS order_count FROM spine LEFT JOIN txn USING (user_id) GROUP BY 1)
    SELECT c_mktsegment AS segment, {sql_round('avg(churned)', 2)} AS churned,
           {sql_round('avg(total_spend)', 2)} AS total_spend, {sql_round('avg(order_count)', 2)} AS order_count
    FROM truth JOIN customer ON CAST(c_custkey AS VARCHAR) = user_id GROUP BY 1""",
)
def segment_profile(spark: SparkSession, root: str) -> DataFrame:
    segments = star.table(spark, root, "customer").select(
        F.col("c_custkey").cast("string").alias("user_id"), F.col("c_mktsegment").alias("segment")
    )
    truth = G.ground_truth(spine(spark, root), txn_of(spark, root)).join(segments, "user_id")
    return comparable(G.segment_profile(truth).drop("clv"), 2)


@query(
    "price_tier_upsell",
    f"""WITH {CLEAN}, cuts AS (SELECT quantile_cont(price, 0.25) AS a, quantile_cont(price, 0.5) AS b,
                                      quantile_cont(price, 0.75) AS c FROM txn),
    backs AS (SELECT user_id, price, row_number() OVER (PARTITION BY user_id
                     ORDER BY ts DESC, transaction_id DESC, product_id DESC, price DESC) AS back FROM txn),
    tiers AS (SELECT user_id, back, (price > a)::INT + (price > b)::INT + (price > c)::INT AS tier
              FROM backs CROSS JOIN cuts WHERE back <= 2),
    wide AS (SELECT user_id, CAST(max(tier) FILTER (WHERE back = 1) AS BIGINT) AS last_tier,
                    CAST(max(tier) FILTER (WHERE back = 2) AS BIGINT) AS prev_tier FROM tiers GROUP BY 1)
    SELECT *, CAST(coalesce((last_tier > prev_tier)::INT, 0) AS BIGINT) AS tier_upsell FROM wide""",
)
def price_tier_upsell(spark: SparkSession, root: str) -> DataFrame:
    return comparable(G.price_tier_upsell(txn_of(spark, root)))


@query(
    "first_category_buyers",
    f"""WITH {CLEAN}, entered AS (SELECT i.category, t.user_id, min(t.ts) AS entered_at FROM
           (SELECT o.customer_unique_id AS user_id, o.ts, i.product_id FROM clean_items i JOIN clean_orders o USING (order_id)) t
           JOIN raw_products i USING (product_id) GROUP BY 1, 2),
    placed AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY entered_at, user_id) AS rn,
                      count(*) OVER (PARTITION BY category) AS n FROM entered)
    SELECT user_id, CAST(max(CASE WHEN rn <= ceil(n * 0.1::DOUBLE) THEN 1 ELSE 0 END) AS BIGINT) AS early_buyer FROM placed GROUP BY 1""",
)
def first_category_buyers(spark: SparkSession, root: str) -> DataFrame:
    category = star.products(spark, root).select("product_id", F.col("product_category_name").alias("category"))
    return comparable(G.first_buyers(txn_of(spark, root).join(category, "product_id")))


# ---------------------------------------------------------------- features and sequences

FEATURES_SQL = EVENTS_SQL + f""", fin AS (SELECT max(ts) AS e FROM txn),
spend AS (SELECT user_id, {sql_days('max(ts)', '(SELECT e FROM fin)')} AS recency_days, count(DISTINCT transaction_id) AS frequency,
   sum(amount) AS monetary, avg(amount) AS avg_order_value, max(amount) AS max_order_value, min(amount) AS min_order_value,
   coalesce(stddev_samp(amount), 0) AS std_order_value, count(transaction_id) AS total_items,
   count(DISTINCT product_id) AS n_unique_products, avg(price) AS avg_item_price, sum(freight) AS total_freight,
   avg(freight) AS avg_freight, sum(freight) AS freight_ratio, sum(freight) / greatest(sum(amount), 0.01) AS freight_pct,
   avg(review_score) AS avg_review_score, min(review_score) AS min_review_score, max(review_score) AS max_review_score,
   count(review_score) AS n_reviews, count(DISTINCT seller_id) AS n_unique_sellers FROM txn GROUP BY 1),
deliv AS (SELECT customer_unique_id AS user_id, avg(delivery_days) AS avg_delivery_days, max(delivery_days) AS max_delivery_days,
   count(*) FILTER (WHERE delivery_vs_estimate > 0) AS n_late_deliveries, avg(delivery_vs_estimate) AS avg_delivery_delta
   FROM clean_orders GROUP BY 1),
payh AS (SELECT customer_unique_id AS user_id, avg(installments) AS avg_installments, CAST(max(installments) AS BIGINT) AS max_installments,
   count(DISTINCT payment_type) AS n_payment_types, CAST(max((payment_type = '1-URGENT')::INT) AS BIGINT) AS uses_credit_card,
   CAST(max((payment_type = '5-LOW')::INT) AS BIGINT) AS uses_boleto
   FROM raw_payments JOIN clean_orders USING (order_id) GROUP BY 1),
catc AS (SELECT o.customer_unique_id AS user_id, category, count(*) AS n FROM clean_items JOIN clean_orders o USING (order_id) GROUP BY 1, 2),
cats AS (SELECT user_id, count(category) AS n_unique_categories, coalesce(max(CASE WHEN r = 1 THEN category END), 'unknown') AS top_category
   FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, category) AS r FROM catc) GROUP BY 1),
jour AS (SELECT user_id, count(*) AS total_journey_events, count(DISTINCT session_id) AS n_order_sessions FROM journey GROUP BY 1),
info AS (SELECT customer_unique_id AS user_id, {sql_days('min(ts)', 'max(ts)')} AS tenure_days, count(DISTINCT order_id) AS n
   FROM clean_orders GROUP BY 1),
demo AS (SELECT i.user_id, coalesce(city, 'unknown') AS city, coalesce(state, 'unknown') AS state,
   CASE WHEN n <= 1 THEN 'one_time' WHEN n <= 2 THEN 'returning' WHEN n <= 4 THEN 'regular' ELSE 'power_buyer' END AS user_segment,
   tenure_days FROM info i LEFT JOIN raw_customers c ON c.customer_id = i.user_id),
feats AS (SELECT * FROM demo LEFT JOIN spend USING (user_id) LEFT JOIN deliv USING (user_id) LEFT JOIN payh USING (user_id)
   LEFT JOIN cats USING (user_id) LEFT JOIN jour USING (user_id))"""

DOUBLE_FEATURES = (
    "monetary", "avg_order_value", "max_order_value", "min_order_value", "std_order_value", "avg_item_price",
    "total_freight", "avg_freight", "freight_ratio", "freight_pct", "avg_review_score", "min_review_score",
    "max_review_score", "avg_delivery_days", "avg_delivery_delta", "avg_installments",
)
LONG_FEATURES = (
    "tenure_days", "recency_days", "frequency", "total_items", "n_unique_products", "n_reviews", "n_unique_sellers",
    "max_delivery_days", "n_late_deliveries", "max_installments", "n_payment_types", "uses_credit_card", "uses_boleto",
    "n_unique_categories", "total_journey_events", "n_order_sessions",
)
FEATURES_OUT = ", ".join(
    ["user_id", "city", "state", "user_segment", "coalesce(top_category, 'unknown') AS top_category"]
    + [f"{sql_round(f'coalesce({c}, 0)', 3)} AS {c}" for c in DOUBLE_FEATURES]
    + [f"CAST(coalesce({c}, 0) AS BIGINT) AS {c}" for c in LONG_FEATURES]
)


def features_of(spark: SparkSession, root: str) -> DataFrame:
    data, txn = A.computed_once(cleaned(spark, root))
    return X.customer_features(A.demographics(data), txn, A.journey_events(data), data, G.data_end(txn), PAYMENT_FLAGS)


def features_and_targets(spark: SparkSession, root: str) -> tuple[Mapping[str, DataFrame], DataFrame, DataFrame, DataFrame]:
    """Clean tables, transactions, features and targets; the transactions are written once, for all that reads them."""
    data = cleaned(spark, root)
    txn = settled(A.transactions(data))
    feats = X.customer_features(A.demographics(data), txn, A.journey_events(data), data, G.data_end(txn), PAYMENT_FLAGS)
    return data, txn, feats, G.all_targets(spine(spark, root), txn)


@query("customer_features", FEATURES_SQL + f" SELECT {FEATURES_OUT} FROM feats")
def customer_features(spark: SparkSession, root: str) -> DataFrame:
    return comparable(features_of(spark, root), 3)


@query(
    "product_features",
    f"""WITH {CLEAN},
    sales AS (SELECT product_id, count(DISTINCT order_id) AS n_orders, sum(price) AS total_revenue, avg(price) AS avg_price,
                     avg(freight) AS avg_freight, count(DISTINCT seller_id) AS n_sellers FROM clean_items GROUP BY 1),
    revs AS (SELECT product_id, avg(review_score) AS r, count(review_score) AS n FROM txn GROUP BY 1)
    SELECT product_id, category AS category_english, {sql_round('weight', 3)} AS product_weight_g,
           {sql_round('size * size * size', 3)} AS product_volume_cm3, coalesce(n_orders, 0) AS n_orders,
           {sql_round('coalesce(total_revenue, 0)', 3)} AS total_revenue, {sql_round('coalesce(avg_price, 0)', 3)} AS avg_price,
           {sql_round('coalesce(avg_freight, 0)', 3)} AS avg_freight, coalesce(n_sellers, 0) AS n_sellers,
           {sql_round('coalesce(r, 0)', 3)} AS product_avg_review, coalesce(n, 0) AS product_n_reviews,
           {sql_round('0', 3)} AS product_photos_qty
    FROM raw_products LEFT JOIN sales USING (product_id) LEFT JOIN revs USING (product_id)""",
)
def product_features(spark: SparkSession, root: str) -> DataFrame:
    data = cleaned(spark, root)
    df = X.product_features(data, A.transactions(data))
    return comparable(df.select("product_id", "category_english", "product_weight_g", "product_volume_cm3", "n_orders",
                                "total_revenue", "avg_price", "avg_freight", "n_sellers", "product_avg_review",
                                "product_n_reviews", "product_photos_qty"), 3)


KIND_SQL = "CASE event_type " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in X.EVENT_TYPE_IDS.items()) + " ELSE 0 END"
SEQ_SQL = EVENTS_SQL + f""",
vocab AS (SELECT product_id, row_number() OVER (ORDER BY product_id) AS idx FROM (SELECT DISTINCT product_id FROM journey)),
typed AS (SELECT user_id, ts, product_id, {KIND_SQL} AS kind, min(ts) OVER (PARTITION BY user_id) AS first_ts FROM journey),
backs AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, kind DESC, product_id DESC) AS back FROM typed),
seqs AS (SELECT user_id, string_agg(kind || ':' || idx || ':' || CAST(CAST(epoch_us(ts - first_ts) / 1000000 AS BIGINT) AS VARCHAR), ' ' ORDER BY back DESC) AS events,
                count(*) AS n FROM backs JOIN vocab USING (product_id) WHERE back <= 128 GROUP BY 1)"""


@query("interaction_sequences", SEQ_SQL + " SELECT user_id, n, events FROM seqs")
def interaction_sequences(spark: SparkSession, root: str) -> DataFrame:
    seq = X.interaction_sequences(settled(A.journey_events(cleaned(spark, root))))
    text = F.transform("events", lambda e: F.concat_ws(
        ":", e["event_type_id"].cast("string"), e["product_idx"].cast("string"), e["time_delta"].cast("bigint").cast("string")))
    return seq.select("user_id", F.size("events").cast("bigint").alias("n"), F.array_join(text, " ").alias("events"))
