"""Shared pieces of the catalog: SQL of the table stand-ins and rounding for comparison."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# a small shift before rounding keeps both engines on one side of a decimal tie
EPS = "1e-9"

CUSTOMERS = """raw_customers AS (
  SELECT CAST(c_custkey AS VARCHAR) AS customer_id, CAST(c_custkey AS VARCHAR) AS customer_unique_id,
         c_nationkey AS zip, n_name AS city, r_name AS state
  FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey)"""

ORDERS = """raw_orders AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS order_id, CAST(o_custkey AS VARCHAR) AS customer_id,
         CASE o_orderstatus WHEN 'P' THEN 'canceled' WHEN 'F' THEN 'delivered' ELSE 'shipped' END AS order_status,
         o_orderdate AS ts, carrier, delivered, o_orderdate + INTERVAL 30 DAY AS estimated
  FROM orders LEFT JOIN (SELECT l_orderkey, min(l_shipdate) AS carrier, max(l_shipdate) AS delivered
                         FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey)"""

ITEMS = """raw_items AS (
  SELECT CAST(l_orderkey AS VARCHAR) AS order_id, l_linenumber AS order_item_id,
         CAST(l_partkey AS VARCHAR) AS product_id, CAST(l_suppkey AS VARCHAR) AS seller_id,
         l_extendedprice AS price, round(l_extendedprice * l_tax + 1e-7::DOUBLE, 2) AS freight
  FROM lineitem)"""

PAYMENTS = """raw_payments AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS order_id, o_orderpriority AS payment_type,
         CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS installments, o_totalprice AS value
  FROM orders)"""

REVIEWS = """raw_reviews AS (
  SELECT CAST(l_orderkey AS VARCHAR) AS order_id,
         CASE l_returnflag WHEN 'R' THEN 1 WHEN 'A' THEN 3 ELSE 5 END AS score,
         CASE WHEN l_linestatus = 'F' THEN l_returnflag END AS comment, l_shipdate + INTERVAL 7 DAY AS created
  FROM lineitem)"""

PRODUCTS = """raw_products AS (
  SELECT CAST(p_partkey AS VARCHAR) AS product_id, p_type AS category, CAST(p_size AS DOUBLE) AS size,
         p_retailprice AS weight, CAST(length(p_name) AS DOUBLE) AS name_length FROM part)"""

CLEAN = f"""{CUSTOMERS}, {ORDERS}, {ITEMS}, {PAYMENTS}, {REVIEWS}, {PRODUCTS},
pay AS (SELECT order_id, sum(value) AS total_payment, max(installments) AS n_installments,
               string_agg(DISTINCT payment_type, ',' ORDER BY payment_type) AS payment_types,
               count(DISTINCT payment_type) AS n_payment_methods FROM raw_payments GROUP BY 1),
rev AS (SELECT order_id, avg(score) AS review_score, bool_or(comment IS NOT NULL) AS has_review_comment
        FROM raw_reviews GROUP BY 1),
clean_orders AS (
  SELECT o.*, c.customer_unique_id, p.total_payment, p.n_installments, p.payment_types, p.n_payment_methods,
         r.review_score, r.has_review_comment,
         CAST(floor(epoch_us(delivered - ts) / 86400000000.0) AS BIGINT) AS delivery_days,
         CAST(floor(epoch_us(delivered - estimated) / 86400000000.0) AS BIGINT) AS delivery_vs_estimate
  FROM raw_orders o JOIN raw_customers c USING (customer_id) LEFT JOIN pay p USING (order_id)
       LEFT JOIN rev r USING (order_id)
  WHERE order_status IN ('delivered', 'shipped', 'invoiced', 'processing') AND ts IS NOT NULL),
clean_items AS (SELECT i.*, p.category FROM raw_items i SEMI JOIN clean_orders USING (order_id)
                LEFT JOIN raw_products p USING (product_id)),
txn AS (SELECT i.order_id || '_' || i.order_item_id AS transaction_id, o.customer_unique_id AS user_id,
               i.product_id, o.ts, i.price + i.freight AS amount, i.price, i.freight, i.seller_id, o.review_score
        FROM clean_items i JOIN clean_orders o USING (order_id)),
people AS (SELECT DISTINCT customer_unique_id AS user_id FROM clean_orders)"""

DAYS = "CAST(floor(epoch_us({b} - {a}) / 86400000000.0) AS BIGINT)"


def sql_days(a: str, b: str) -> str:
    return DAYS.format(a=a, b=b)


# cumulative Poisson(1) probabilities, as the sampling weights of the bootstrap use them
POISSON_STEPS = tuple(sum(math.exp(-1.0) / math.factorial(k) for k in range(n + 1)) for n in range(12))


def sql_seeds(key: str, seed: int = 42) -> str:
    digest = f"md5('{seed}|' || {key})"
    return ", ".join(f"CAST(('0x' || substr({digest}, {at}, 8)) AS BIGINT) AS {name}" for at, name in ((1, "h1"), (9, "h2")))


def sql_poisson(replicate: str = "r") -> str:
    """The Poisson(1) draw of a row with seeds h1 and h2 in a replicate."""
    u = (f"((h1 % 2147483647 + {replicate} * (h2 % 2147483647) + {replicate} * {replicate} * ((h1 + h2) % 65521)) % 2147483647"
         " / 2147483647.0::DOUBLE)")  # fmt: skip
    cases = " ".join(f"WHEN {u} < {limit!r}::DOUBLE THEN {k}" for k, limit in enumerate(POISSON_STEPS))
    return f"CASE {cases} ELSE {len(POISSON_STEPS)} END"


def sql_round(expr: str, digits: int = 4) -> str:
    return f"round(CAST({expr} AS DOUBLE) + {EPS}::DOUBLE, {digits})"


def rounded(c: Column | str, digits: int = 4) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c.cast("double") + F.lit(1e-9), digits)


def comparable(df: DataFrame, digits: int = 4) -> DataFrame:
    """Round doubles and give integers and dates one type each, so that two engines' values compare."""
    out = []
    for f in df.schema:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            out.append(rounded(c, digits).alias(f.name))
        elif isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            out.append(c.cast("bigint").alias(f.name))
        elif isinstance(f.dataType, (T.DateType, T.TimestampNTZType, T.TimestampType)):
            fmt = "yyyy-MM-dd" if isinstance(f.dataType, T.DateType) else "yyyy-MM-dd HH:mm:ss"
            out.append(F.date_format(c, fmt).alias(f.name))
        else:
            out.append(c.alias(f.name))
    return df.select(*out)
