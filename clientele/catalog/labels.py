"""Queries of the cutoff-gated labels, features, sequences and of the splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clientele.catalog import query
from clientele.catalog.commerce import spine, txn_of
from clientele.catalog.common import CLEAN, CUSTOMERS, ITEMS, ORDERS, PRODUCTS, comparable, sql_days, sql_round
from clientele.operators import adapter as A
from clientele.operators import leakfree as L
from clientele.operators import splits as P
from clientele.sources import star

GATED = f"""WITH {CUSTOMERS}, {ORDERS}, {ITEMS}, {PRODUCTS},
o AS (SELECT r.*, c.customer_unique_id AS who FROM raw_orders r JOIN raw_customers c USING (customer_id)
      WHERE order_status IS NULL OR order_status NOT IN ('canceled', 'unavailable')),
cut AS (SELECT date_trunc('day', max(ts)) - INTERVAL 90 DAY AS c FROM o),
feat AS (SELECT o.* FROM o, cut WHERE ts <= c),
obs AS (SELECT o.* FROM o, cut WHERE ts > c AND ts <= c + INTERVAL 90 DAY),
elig AS (SELECT who FROM feat, cut GROUP BY who, c HAVING min(ts) + INTERVAL 30 DAY <= c),
clvs AS (SELECT who, sum(price + freight) AS clv, count(DISTINCT order_id) AS n FROM obs LEFT JOIN raw_items USING (order_id) GROUP BY 1),
firsts AS (SELECT who, order_id FROM obs QUALIFY row_number() OVER (PARTITION BY who ORDER BY ts, order_id) = 1),
firstcat AS (SELECT who, arg_min(category, product_id) FILTER (WHERE category IS NOT NULL) AS category
             FROM firsts JOIN raw_items USING (order_id) LEFT JOIN raw_products USING (product_id) GROUP BY 1),
topcat AS (SELECT category, row_number() OVER (ORDER BY count(*) DESC, category) - 1 AS class FROM firstcat
           WHERE category IS NOT NULL GROUP BY 1 ORDER BY class LIMIT 9),
cats AS (SELECT who, CASE WHEN category IS NULL THEN -1 ELSE coalesce(class, 9) END AS category
         FROM firstcat LEFT JOIN topcat USING (category)),
lab AS (SELECT who, CASE WHEN n IS NULL THEN 1 ELSE 0 END AS churn, coalesce(category, -1) AS category, coalesce(clv, 0) AS clv,
               TRUE AS churn_valid, coalesce(category, -1) >= 0 AND n IS NOT NULL AS category_valid, TRUE AS clv_valid
        FROM elig LEFT JOIN clvs USING (who) LEFT JOIN cats USING (who)),
tot AS (SELECT order_id, sum(price + freight) AS total, count(product_id) AS n FROM raw_items GROUP BY 1),
fx AS (SELECT who, {sql_days('max(ts)', 'any_value(c)')} AS recency_days, count(DISTINCT order_id) AS frequency,
              coalesce(sum(total), 0) AS monetary, coalesce(avg(total), 0) AS avg_order_value,
              {sql_days('min(ts)', 'any_value(c)')} AS tenure_days, CAST(coalesce(sum(n), 0) AS BIGINT) AS n_items
       FROM feat LEFT JOIN tot USING (order_id), cut GROUP BY who),
vocab AS (SELECT product_id, row_number() OVER (ORDER BY product_id) AS idx
          FROM (SELECT DISTINCT product_id FROM feat JOIN raw_items USING (order_id))),
steps AS (SELECT who, ts, order_id, product_id, row_number() OVER (PARTITION BY who ORDER BY ts DESC, order_id DESC, product_id DESC) AS back
          FROM feat JOIN raw_items USING (order_id)),
seq AS (SELECT who, string_agg(idx || ':' || {sql_days('ts', 'c')}, ' ' ORDER BY back DESC) AS steps, count(*) AS n
        FROM steps JOIN vocab USING (product_id), cut WHERE back <= 50 GROUP BY 1)"""


def tables(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    return star.lean_commerce(spark, root)


def cutoff_of(t: dict[str, DataFrame]) -> Column:
    """The suggested cutoff over valid orders, so that the observation window is always complete."""
    return L.suggest_cutoff(A.not_excluded(t["orders"]))


def labels_of(t: dict[str, DataFrame]) -> DataFrame:
    return L.labels(t["orders"], t["order_items"], t["products"], t["customers"], cutoff_of(t))


def features_of(t: dict[str, DataFrame]) -> DataFrame:
    return L.features(t["orders"], t["order_items"], t["customers"], cutoff_of(t))


@query("suggested_cutoff", GATED + " SELECT strftime(c, '%Y-%m-%d %H:%M:%S') AS cutoff FROM cut")
def suggested_cutoff(spark: SparkSession, root: str) -> DataFrame:
    orders = A.not_excluded(star.orders(spark, root, lifecycle=False))
    return comparable(orders.agg(F.max(L.AT).alias("m")).select(L.plus_days(L.midnight("m"), -90).alias("cutoff")))


@query(
    "cutoff_labels",
    GATED + f""" SELECT who AS customer_unique_id, CAST(churn AS BIGINT) AS churn, CAST(category AS BIGINT) AS category,
       {sql_round('clv', 2)} AS clv, churn_valid, category_valid, clv_valid FROM lab""",
)
def cutoff_labels(spark: SparkSession, root: str) -> DataFrame:
    return comparable(labels_of(tables(spark, root)), 2)


@query(
    "cutoff_features",
    GATED + f""" SELECT who AS customer_unique_id, recency_days, frequency, {sql_round('monetary', 2)} AS monetary,
       {sql_round('avg_order_value', 2)} AS avg_order_value, tenure_days, n_items FROM fx""",
)
def cutoff_features(spark: SparkSession, root: str) -> DataFrame:
    return comparable(features_of(tables(spark, root)), 2)


def sequences_of(t: dict[str, DataFrame]) -> DataFrame:
    return L.sequences(t["orders"], t["order_items"], t["customers"], cutoff_of(t))


@query(
    "cutoff_sequences",
    GATED + " SELECT who AS customer_unique_id, steps, n, CAST(50 AS BIGINT) AS padded FROM seq",
)
def cutoff_sequences(spark: SparkSession, root: str) -> DataFrame:
    seq = sequences_of(tables(spark, root))
    live = F.size(F.filter("mask", lambda m: m))
    pairs = F.slice(F.zip_with("product_ids", "days_before", lambda p, d: F.concat_ws(
        ":", p.cast("string"), F.floor(d).cast("string"))), F.lit(1), live)
    return seq.select("customer_unique_id", F.array_join(pairs, " ").alias("steps"), live.cast("bigint").alias("n"),
                      F.size("product_ids").cast("bigint").alias("padded"))


@query(
    "sequence_time_features",
    GATED + f""" SELECT who AS customer_unique_id, {sql_round(f"sum(ln(1 + epoch_us(c - ts) / 86400000000.0))", 3)} AS log_days,
      {sql_round("sum(epoch_us(c - ts) / 86400000000.0 / 30)", 3)} AS months, {sql_round("sum(epoch_us(c - ts) / 86400000000.0 / 365)", 3)} AS years
      FROM steps, cut WHERE back <= 50 GROUP BY 1""",
)
def sequence_time_features(spark: SparkSession, root: str) -> DataFrame:
    expanded = sequences_of(tables(spark, root)).select(
        "customer_unique_id", L.time_features("days_before").alias("t")
    )

    def total(i: int) -> Column:
        return F.aggregate("t", F.lit(0.0), lambda acc, x: acc + x[i])

    return comparable(expanded.select("customer_unique_id", total(0).alias("log_days"), total(1).alias("months"),
                                      total(2).alias("years")), 3)


@query(
    "top_category_ids",
    GATED + """, kinds AS (SELECT who, category, count(*) AS n FROM feat JOIN raw_items USING (order_id)
       JOIN raw_products USING (product_id) WHERE category IS NOT NULL GROUP BY 1, 2),
    ids AS (SELECT category, row_number() OVER (ORDER BY category) AS idx FROM (SELECT DISTINCT category FROM kinds)),
    best AS (SELECT *, row_number() OVER (PARTITION BY who ORDER BY n DESC, category) AS place FROM kinds JOIN ids USING (category))
    SELECT who AS customer_unique_id,
           coalesce(max(idx) FILTER (WHERE place = 1), 0) || ' ' || coalesce(max(idx) FILTER (WHERE place = 2), 0) || ' ' ||
           coalesce(max(idx) FILTER (WHERE place = 3), 0) AS category_ids
    FROM elig LEFT JOIN best USING (who) GROUP BY 1""",
)
def top_category_ids(spark: SparkSession, root: str) -> DataFrame:
    t = tables(spark, root)
    cutoff = cutoff_of(t)
    people = L.eligible(t["orders"], t["customers"], cutoff)
    out = L.top_categories(t["orders"], t["order_items"], t["products"], t["customers"], cutoff, people)
    return out.withColumn("category_ids", F.array_join(F.col("category_ids").cast("array<string>"), " "))


@query(
    "aligned_model_frame",
    GATED + f""" SELECT who AS customer_unique_id, CAST(churn AS BIGINT) AS churn, {sql_round('clv', 2)} AS clv, recency_days,
      coalesce(n, 0) AS steps FROM lab JOIN fx USING (who) LEFT JOIN seq USING (who)""".replace("coalesce(n, 0)", "coalesce(seq.n, 0)"),
)
def aligned_model_frame(spark: SparkSession, root: str) -> DataFrame:
    t = tables(spark, root)
    out = L.aligned(labels_of(t), features_of(t), sequences_of(t))
    live = F.size(F.filter("mask", lambda m: m))
    return comparable(out.select("customer_unique_id", "churn", "clv", "recency_days", live.alias("steps")), 2)


@query(
    "leak_invariants",
    GATED + """ SELECT 'churner_with_value' AS "check", count(*) FILTER (WHERE churn = 1 AND clv > 0) AS violations FROM lab
      UNION ALL SELECT 'churner_with_category', count(*) FILTER (WHERE churn = 1 AND category_valid) FROM lab
      UNION ALL SELECT 'negative_recency', count(*) FILTER (WHERE recency_days < 0) FROM fx""",
)
def leak_invariants(spark: SparkSession, root: str) -> DataFrame:
    t = tables(spark, root)
    return L.leak_violations(labels_of(t), features_of(t))


# ---------------------------------------------------------------- splits

UNIT_SQL = "CAST(('0x' || substr(md5('{seed}|' || {key}), 1, 8)) AS BIGINT) / 4294967296.0::DOUBLE"


@query(
    "exact_split",
    f"""WITH {CUSTOMERS}, placed AS (SELECT customer_unique_id AS user_id, row_number() OVER (ORDER BY
          {UNIT_SQL.format(seed=42, key='customer_unique_id')}, customer_unique_id) AS pos, count(*) OVER () AS n FROM raw_customers)
    SELECT user_id, CASE WHEN pos <= floor(n * 0.7::DOUBLE) THEN 'train'
                         WHEN pos <= floor(n * 0.7::DOUBLE) + floor(n * 0.15::DOUBLE) THEN 'val' ELSE 'test' END AS split FROM placed""",
)
def exact_split(spark: SparkSession, root: str) -> DataFrame:
    return P.exact_split(spine(spark, root))


@query(
    "hash_split",
    f"""WITH {CUSTOMERS}, u AS (SELECT customer_unique_id AS user_id, {UNIT_SQL.format(seed=7, key='customer_unique_id')} AS u FROM raw_customers)
    SELECT user_id, CASE WHEN u < 0.8::DOUBLE THEN 'train' ELSE 'val' END AS split FROM u""",
)
def hash_split(spark: SparkSession, root: str) -> DataFrame:
    return P.hash_split(spine(spark, root), seed=7, names=("train", "val"), ratios=(0.8, 0.2))


@query(
    "temporal_split",
    f"""WITH {CLEAN}, cuts AS (SELECT quantile_cont(epoch_us(ts), 0.7) AS a, quantile_cont(epoch_us(ts), 0.85) AS b FROM txn)
    SELECT CASE WHEN epoch_us(ts) <= a THEN 'train' WHEN epoch_us(ts) <= b THEN 'val' ELSE 'test' END AS split,
           count(*) AS n, count(DISTINCT user_id) AS users FROM txn, cuts GROUP BY 1""",
)
def temporal_split(spark: SparkSession, root: str) -> DataFrame:
    return P.temporal_split(txn_of(spark, root), "timestamp").groupBy("split").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("user_id").alias("users")
    )


@query(
    "stratified_folds",
    f"""WITH placed AS (SELECT c_custkey, c_mktsegment, row_number() OVER (PARTITION BY c_mktsegment
          ORDER BY {UNIT_SQL.format(seed=42, key='CAST(c_custkey AS VARCHAR)')}, c_custkey) AS pos,
          count(*) OVER (PARTITION BY c_mktsegment) AS n FROM customer)
    SELECT c_custkey, CAST((pos - 1) % 5 AS BIGINT) AS fold, CASE WHEN pos <= round(n * 0.2::DOUBLE) THEN 'test' ELSE 'train' END AS split FROM placed""",
)
def stratified_folds(spark: SparkSession, root: str) -> DataFrame:
    people = star.table(spark, root, "customer").select("c_custkey", "c_mktsegment")
    folds = P.stratified_folds(people, "c_mktsegment", "c_custkey")
    split = P.stratified_split(people, "c_mktsegment", "c_custkey").select("c_custkey", "split")
    return folds.join(split, "c_custkey").select("c_custkey", F.col("fold").cast("bigint").alias("fold"), "split")
