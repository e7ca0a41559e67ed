"""Queries of quality checks and of exact metrics on prediction tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from clientele.catalog import query
from clientele.catalog.commerce import (
    DOUBLE_FEATURES, EVENTS_SQL, FEATURES_SQL, LONG_FEATURES, TARGETS_SQL, cleaned, features_and_targets, features_of, spine,
    targets_of, txn_of,
)
from clientele.catalog.common import CLEAN, CUSTOMERS, comparable, sql_round, sql_seeds
from clientele.catalog.labels import UNIT_SQL
from clientele.functions import rules as R
from clientele.operators import adapter as A
from clientele.operators import features as X
from clientele.operators import metrics as M
from clientele.operators import quality as Q
from clientele.operators import splits as P
from clientele.operators.ordering import settled
from clientele.sources import star

CHECK_OUT = '"check", "column", {v} AS "value", status'.format(v=sql_round('"value"'))


def _cells(rows: list[tuple[str, str, str, str]], source: str) -> str:
    """SQL of check rows: (check, column, aggregate, kind of status)."""
    status = {
        "zero": "CASE WHEN coalesce(v, 0) = 0 THEN 'ok' ELSE 'error' END",
        "rate": "CASE WHEN v < 0.05::DOUBLE OR v > 0.95::DOUBLE THEN 'warning' ELSE 'ok' END",
        "info": "'ok'",
        "var": "CASE WHEN v = 0 THEN 'ok' ELSE 'warning' END",
        "nulls": "CASE WHEN v > 0.1::DOUBLE THEN 'warning' ELSE 'ok' END",
        "text": "'warning'",
    }
    parts = [
        f"SELECT '{c}' AS \"check\", '{col}' AS \"column\", v AS \"value\", {status[kind]} AS status "
        f"FROM (SELECT CAST({agg} AS DOUBLE) AS v FROM {source})"
        for c, col, agg, kind in rows
    ]
    return " UNION ALL ".join(parts)


TARGET_CELLS = (
    [(k, c, a, s) for c in ("churn", "upsell", "early_adopter", "satisfaction_risk") for k, a, s in (
        ("non_binary", f"count(*) FILTER (WHERE {c} IS NULL OR {c} NOT IN (0, 1))", "zero"), ("positive_rate", f"avg({c})", "rate"))]
    + [(k, c, a, s) for c in ("clv", "days_next_purchase") for k, a, s in (
        ("nulls", f"count(*) FILTER (WHERE {c} IS NULL)", "zero"), ("negatives", f"count(*) FILTER (WHERE {c} < 0)", "zero"),
        ("infinite", f"count(*) FILTER (WHERE isinf(CAST({c} AS DOUBLE)))", "zero"), ("mean", f"avg({c})", "info"))]
    + [("rows", "user_id", "count(*)", "info"), ("duplicates", "user_id", "count(user_id) - count(DISTINCT user_id)", "zero")]
)


@query("target_checks", TARGETS_SQL + f", c AS ({_cells(TARGET_CELLS, 'targets')}) SELECT {CHECK_OUT} FROM c")
def target_checks(spark: SparkSession, root: str) -> DataFrame:
    return comparable(Q.check_targets(targets_of(spark, root)))


def faulty_features(spark: SparkSession, root: str) -> DataFrame:
    """All features, with the faults the check looks for: a constant, a sparse, an infinite and a huge column."""
    n = F.col("user_id").cast("bigint")
    return features_of(spark, root).withColumns({
        "constant": F.lit(1.0), "sparse": F.when(n % 3 > 0, F.col("monetary")),
        "endless": F.when(n % 100 == 0, F.lit(float("inf"))).otherwise(1.0 * n), "large": F.col("monetary") * 1e6,
    })


ALL_FEATURES = (*DOUBLE_FEATURES, *LONG_FEATURES, "constant", "sparse", "endless", "large")
FEATURE_CELLS = [(k, c, a.format(c=c), s) for c in ALL_FEATURES for k, a, s in (
    ("zero_variance", "CASE WHEN min({c}) = max({c}) THEN 1 ELSE 0 END", "var"),
    ("all_null", "CASE WHEN count({c}) = 0 THEN 1 ELSE 0 END", "zero"),
    ("infinite", "count(*) FILTER (WHERE isinf(CAST({c} AS DOUBLE)))", "zero"),
    ("null_rate", "avg(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0.0 END)", "nulls"),
    ("huge", "count(*) FILTER (WHERE abs({c}) > 1e10 AND NOT isinf(CAST({c} AS DOUBLE)))", "zero"))]
FEATURE_CELLS += [("text_column", c, "max(1)", "text") for c in ("city", "state", "user_segment", "top_category")]
FAULTY_SQL = FEATURES_SQL + f""", faulty AS MATERIALIZED (SELECT user_id, city, state, user_segment, top_category,
   {', '.join(f'coalesce({c}, 0) AS {c}' for c in (*DOUBLE_FEATURES, *LONG_FEATURES))}, 1.0::DOUBLE AS constant,
   CASE WHEN CAST(user_id AS BIGINT) % 3 > 0 THEN coalesce(monetary, 0) END AS sparse,
   CASE WHEN CAST(user_id AS BIGINT) % 100 = 0 THEN 'infinity'::DOUBLE ELSE CAST(user_id AS DOUBLE) END AS endless, coalesce(monetary, 0) * 1e6 AS large
   FROM feats)"""


@query("feature_checks", FAULTY_SQL + f", c AS ({_cells(FEATURE_CELLS, 'faulty')}) SELECT {CHECK_OUT} FROM c")
def feature_checks(spark: SparkSession, root: str) -> DataFrame:
    return comparable(Q.check_features(faulty_features(spark, root)))


def odd_splits(spark: SparkSession, root: str) -> DataFrame:
    """A hash split where some users are left out and some appear twice."""
    s = P.hash_split(spine(spark, root), seed=3)
    n = F.col("user_id").cast("bigint")
    return s.where(n % 50 > 0).unionByName(s.where((n % 40 == 7) & (F.col("split") != "train")).withColumn("split", F.lit("train")))


SPLIT_SQL = f"""WITH {CUSTOMERS}, s0 AS (SELECT customer_unique_id AS user_id, {UNIT_SQL.format(seed=3, key='customer_unique_id')} AS u FROM raw_customers),
s1 AS (SELECT user_id, CASE WHEN u < 0.7::DOUBLE THEN 'train' WHEN u < 0.7::DOUBLE + 0.15::DOUBLE THEN 'val' ELSE 'test' END AS split FROM s0),
sp AS (SELECT * FROM s1 WHERE CAST(user_id AS BIGINT) % 50 > 0
       UNION ALL SELECT user_id, 'train' FROM s1 WHERE CAST(user_id AS BIGINT) % 40 = 7 AND split <> 'train'),
m AS (SELECT user_id, max((split = 'train')::INT) AS train, max((split = 'val')::INT) AS val, max((split = 'test')::INT) AS test FROM sp GROUP BY 1),
lost AS (SELECT count(*) AS n FROM raw_customers WHERE customer_unique_id NOT IN (SELECT user_id FROM sp))"""
SPLIT_CELLS = [("overlap", f"{a}-{b}", f"count(*) FILTER (WHERE {a} = 1 AND {b} = 1)", "zero") for a, b in (
    ("train", "val"), ("train", "test"), ("val", "test"))] + [c for n in ("train", "val", "test") for c in (
    ("size", n, f"sum({n})", "info"), ("share", n, f"sum({n}) / (sum(train) + sum(val) + sum(test))::DOUBLE", "info"))]


@query(
    "split_checks",
    SPLIT_SQL + f", c AS ({_cells(SPLIT_CELLS, 'm')} UNION ALL SELECT 'uncovered', 'user_id', n::DOUBLE, "
    f"CASE WHEN n = 0 THEN 'ok' ELSE 'warning' END FROM lost) SELECT {CHECK_OUT} FROM c",
)
def split_checks(spark: SparkSession, root: str) -> DataFrame:
    return comparable(Q.check_splits(odd_splits(spark, root), spine(spark, root)))


ALIGN_SQL = SPLIT_SQL + """, f AS (SELECT DISTINCT CAST(o_custkey AS VARCHAR) AS user_id FROM orders WHERE o_orderstatus <> 'P'),
t AS (SELECT DISTINCT CAST(o_custkey AS VARCHAR) AS user_id FROM orders WHERE o_orderstatus <> 'F'),
k AS (SELECT user_id FROM f UNION SELECT user_id FROM t UNION SELECT user_id FROM sp),
w AS (SELECT user_id, user_id IN (SELECT user_id FROM f) AS f, user_id IN (SELECT user_id FROM t) AS t, user_id IN (SELECT user_id FROM sp) AS s FROM k)"""
ALIGN_CELLS = [("aligned", "both", "count(*) FILTER (WHERE f AND t)", "info"), ("aligned", "features_only", "count(*) FILTER (WHERE f AND NOT t)", "zero"),
               ("aligned", "targets_only", "count(*) FILTER (WHERE t AND NOT f)", "zero"), ("orphans", "split", "count(*) FILTER (WHERE s AND NOT (f AND t))", "zero")]


@query("id_alignment", ALIGN_SQL + f", c AS ({_cells(ALIGN_CELLS, 'w')}) SELECT {CHECK_OUT} FROM c")
def id_alignment(spark: SparkSession, root: str) -> DataFrame:
    orders = star.table(spark, root, "orders").withColumn("user_id", F.col("o_custkey").cast("string"))
    left = orders.where("o_orderstatus <> 'P'").select("user_id").distinct()
    right = orders.where("o_orderstatus <> 'F'").select("user_id").distinct()
    return comparable(Q.alignment(left, right, odd_splits(spark, root)))


SEQ_TABLE_SQL = EVENTS_SQL + f""",
vocab AS (SELECT product_id, row_number() OVER (ORDER BY product_id) AS idx FROM (SELECT DISTINCT product_id FROM journey)),
typed AS (SELECT user_id, ts, product_id, CASE event_type {" ".join(f"WHEN '{k}' THEN {v}" for k, v in X.EVENT_TYPE_IDS.items())} ELSE 0 END AS kind FROM journey),
kept AS (SELECT * FROM typed JOIN vocab USING (product_id) QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, kind DESC, product_id DESC) <= 128),
lens AS (SELECT user_id, count(*) AS n, max(kind) AS k, max(idx) AS p FROM kept GROUP BY 1)"""
SEQ_CELLS = [("sequences", "events", "count(*)", "info"), ("max_length", "events", "max(n)", "info"), ("mean_length", "events", "avg(n)", "info"),
             ("max_id", "event_type_id", "max(k)", "info"), ("max_id", "product_idx", "max(p)", "info"), ("negative", "ids", "0 * count(*)", "zero"),
             ("null", "time_delta", "0 * count(*)", "zero"), ("arity", "events", "0 * count(*)", "zero")]


@query("sequence_checks", SEQ_TABLE_SQL + f", c AS ({_cells(SEQ_CELLS, 'lens')}) SELECT {CHECK_OUT} FROM c")
def sequence_checks(spark: SparkSession, root: str) -> DataFrame:
    seq = settled(X.interaction_sequences(settled(A.journey_events(cleaned(spark, root)))))
    return comparable(Q.check_sequences(seq, max_product=10_000_000))


META_SQL = FEATURES_SQL.replace("WITH ", "WITH ", 1) + """, m AS (SELECT
  (SELECT count(*) FROM demo) AS n_users, (SELECT count(*) FROM txn) AS n_transactions, (SELECT count(*) FROM journey) AS n_web_events,
  (SELECT count(DISTINCT product_id) FROM txn) AS n_products, (SELECT count(DISTINCT city) FROM feats) AS cities,
  (SELECT count(DISTINCT user_segment) FROM feats) AS segments, (SELECT count(DISTINCT top_category) FROM feats) AS top_categories)"""


def meta_of(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    data, txn, feats, targets = features_and_targets(spark, root)
    return Q.metadata(A.demographics(data), txn, A.journey_events(data), feats, targets), feats, targets


@query("run_metadata", META_SQL + " SELECT * FROM m")
def run_metadata(spark: SparkSession, root: str) -> DataFrame:
    meta, _, _ = meta_of(spark, root)
    return meta.select("stats.*", F.col("categorical_cardinalities.city").alias("cities"),
                       F.col("categorical_cardinalities.user_segment").alias("segments"),
                       F.col("categorical_cardinalities.top_category").alias("top_categories"))


@query(
    "metadata_checks",
    f"""WITH {CLEAN}, p AS (SELECT count(*) AS n FROM people), c AS (SELECT count(*) AS n FROM customer)
    SELECT 'rows' AS "check", 'targets' AS "column", {sql_round('p.n - c.n')} AS "value", CASE WHEN p.n = c.n THEN 'ok' ELSE 'error' END AS status FROM p, c
    UNION ALL SELECT 'rows', 'features', {sql_round('c.n - p.n')}, CASE WHEN p.n = c.n THEN 'ok' ELSE 'error' END FROM p, c
    UNION ALL SELECT 'cardinality', x, {sql_round('0')}, 'ok' FROM (VALUES ('city'), ('state'), ('user_segment'), ('top_category')) AS v(x)""",
)
def metadata_checks(spark: SparkSession, root: str) -> DataFrame:
    return comparable(Q.check_metadata(*meta_of(spark, root)))


@query("quality_report",
       TARGETS_SQL + f""", c AS ({_cells(TARGET_CELLS, 'targets')}), s AS ({_cells(SPLIT_CELLS, 'm')} UNION ALL SELECT 'uncovered', 'user_id', n::DOUBLE,
       CASE WHEN n = 0 THEN 'ok' ELSE 'warning' END FROM lost), u AS (SELECT 'targets' AS area, * FROM c UNION ALL SELECT 'splits', * FROM s)
       SELECT area, count(*) AS checks, count(*) FILTER (WHERE status = 'error') AS errors, count(*) FILTER (WHERE status = 'warning') AS warnings
       FROM u GROUP BY 1""".replace(", c AS", ", " + SPLIT_SQL.split(", s0 AS", 1)[1].join(["s0 AS", ", c AS"]), 1))  # fmt: skip
def quality_report(spark: SparkSession, root: str) -> DataFrame:
    parts = {"targets": Q.check_targets(targets_of(spark, root)),
             "splits": Q.check_splits(odd_splits(spark, root), spine(spark, root))}
    return Q.report_summary(Q.quality_report(parts))


# every thirteenth order carries a wrong nation, every seventeenth a wrong region; lines of every nineteenth are early
PLANTED_SQL = """po AS (SELECT o.*, c_mktsegment AS segment, CASE WHEN o_orderkey % 13 = 0 THEN (c_nationkey + 1) % 25 ELSE c_nationkey END AS nation,
    CASE WHEN o_orderkey % 17 = 0 THEN -1 ELSE n_regionkey END AS region FROM orders o LEFT JOIN customer ON c_custkey = o_custkey LEFT JOIN nation ON n_nationkey = c_nationkey),
  lines AS (SELECT l_orderkey, min(CASE WHEN l_orderkey % 19 = 0 THEN l_shipdate - INTERVAL 9000 DAY ELSE l_shipdate END) AS shipped, sum(l_quantity) AS quantity
    FROM lineitem GROUP BY 1),
  dep AS (SELECT 'o_custkey -> nation' AS rule, o_custkey::VARCHAR AS d, nation::VARCHAR AS v FROM po UNION ALL SELECT 'o_custkey -> segment', o_custkey::VARCHAR, segment FROM po
    UNION ALL SELECT 'segment, nation -> region', segment || ':' || nation, region::VARCHAR FROM po),
  held AS (SELECT rule, sum(n)::BIGINT AS checked, sum(n - m)::BIGINT AS violations FROM (SELECT rule, d, sum(n) AS n, max(n) AS m FROM
      (SELECT rule, d, v, count(*) AS n FROM dep WHERE d IS NOT NULL AND v IS NOT NULL GROUP BY ALL) GROUP BY ALL) GROUP BY 1
    UNION ALL SELECT 'shipped after the order', count(*), count(*) FILTER (WHERE NOT shipped >= o_orderdate) FROM po JOIN lines ON l_orderkey = o_orderkey
    UNION ALL SELECT 'at most 175 pieces', count(*), count(*) FILTER (WHERE NOT quantity <= 175) FROM po JOIN lines ON l_orderkey = o_orderkey)"""


def _planted(spark: SparkSession, root: str) -> tuple[DataFrame, dict, list[Q.CrossRule]]:
    """Orders with their customer's segment, nation and region, some of them wrong, and the rules they should keep."""
    people = star.table(spark, root, "customer").join(star.table(spark, root, "nation"), F.col("c_nationkey") == F.col("n_nationkey"), "left")
    orders = star.table(spark, root, "orders").join(people, F.col("o_custkey") == F.col("c_custkey"), "left")
    orders = orders.withColumns({
        "segment": F.col("c_mktsegment"),
        "nation": F.when(F.col("o_orderkey") % 13 == 0, (F.col("c_nationkey") + 1) % 25).otherwise(F.col("c_nationkey")),
        "region": F.when(F.col("o_orderkey") % 17 == 0, -1).otherwise(F.col("n_regionkey")),
    })
    early = F.when(F.col("l_orderkey") % 19 == 0, F.col("l_shipdate") - F.expr("INTERVAL 9000 DAYS")).otherwise(F.col("l_shipdate"))
    lines, on = star.table(spark, root, "lineitem"), (("o_orderkey", "l_orderkey"),)
    rules = [Q.CrossRule("shipped after the order", lines, on, {"shipped": F.min(early)}, F.col("shipped") >= F.col("o_orderdate")),
             Q.CrossRule("at most 175 pieces", lines, on, {"quantity": F.sum("l_quantity")}, F.col("quantity") <= 175)]
    return orders, {("o_custkey",): ["nation", "segment"], ("segment", "nation"): ["region"]}, rules


@query("consistency_checks", f"WITH {PLANTED_SQL} SELECT rule, checked, violations, {sql_round('1.0::DOUBLE - violations / checked::DOUBLE')} AS share FROM held")
def consistency_checks(spark: SparkSession, root: str) -> DataFrame:
    orders, dependencies, rules = _planted(spark, root)
    return comparable(Q.consistency(orders, dependencies, rules))


@query(
    "order_scorecard",
    f"""WITH {PLANTED_SQL}, o AS (SELECT *, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderpriority END AS priority FROM orders)
    SELECT 'orders' AS "table", 'completeness' AS dimension, {sql_round('avg(((o_custkey IS NOT NULL)::INT + (priority IS NOT NULL)::INT) / 2.0::DOUBLE)')} AS "value" FROM o
    UNION ALL SELECT 'orders', 'uniqueness', {sql_round('count(DISTINCT o_orderkey) / count(*)::DOUBLE')} FROM o
    UNION ALL SELECT 'orders', 'validity', {sql_round('avg(((o_totalprice > 50000)::INT + (o_orderstatus IN (chr(70), chr(79)))::INT) / 2.0::DOUBLE)')} FROM o
    UNION ALL SELECT 'orders', 'freshness_days', {sql_round("date_diff('second', max(o_orderdate), TIMESTAMP '2001-09-01') / 86400.0::DOUBLE")} FROM o
    UNION ALL SELECT 'orders', 'referential_integrity', {sql_round("avg(CASE WHEN c_custkey IS NOT NULL THEN 1.0 ELSE 0.0 END)")}
      FROM o LEFT JOIN (SELECT c_custkey FROM customer WHERE c_custkey % 11 > 0) ON c_custkey = o_custkey
    UNION ALL SELECT 'orders', 'consistency', {sql_round('avg(1.0::DOUBLE - violations / checked::DOUBLE)')} FROM held""",
)
def order_scorecard(spark: SparkSession, root: str) -> DataFrame:
    orders, dependencies, rules = _planted(spark, root)
    orders = orders.withColumn("priority", F.when(F.col("o_orderkey") % 7 != 0, F.col("o_orderpriority")))
    valid = {"price": F.col("o_totalprice") > 50000, "status": F.col("o_orderstatus").isin("F", "O")}
    parents = star.table(spark, root, "customer").where("c_custkey % 11 > 0")
    return comparable(Q.scorecard(
        orders, "orders", "o_orderkey", ["o_custkey", "priority"], valid, "o_orderdate", F.lit("2001-09-01").cast("timestamp_ntz"),
        (parents, "o_custkey", "c_custkey"), dependencies, rules))


def campaigns(spark: SparkSession, root: str) -> DataFrame:
    """A signup counts as sent; a click of the same user within a day counts as clicked."""
    e = star.table(spark, root, "events")
    sent = e.where("event_type = 'signup'").select(F.col("event_id").alias("campaign_id"), "user_id", "ts")
    # matched by user and day bucket, so the range condition never meets a user's whole history
    clicks = e.where("event_type = 'click'").select("user_id", F.col("ts").alias("at"))
    clicks = clicks.withColumn("day", F.explode(F.array(F.to_date("at"), F.date_sub(F.to_date("at"), 1))))
    hits = sent.withColumn("day", F.to_date("ts")).join(clicks, ["user_id", "day"]).where(
        (F.col("at") >= F.col("ts")) & (F.col("at") <= F.col("ts") + F.make_dt_interval(F.lit(1)))
    ).select("campaign_id").distinct().withColumn("clicked", F.lit(1))
    return sent.join(hits, "campaign_id", "left").select("campaign_id", "user_id", "ts", F.coalesce("clicked", F.lit(0)).alias("clicked"))


CAMPAIGN_SQL = """camp AS (SELECT s.event_id AS campaign_id, s.user_id, max(CASE WHEN c.event_id IS NULL THEN 0 ELSE 1 END) AS clicked
  FROM (SELECT * FROM events WHERE event_type = 'signup') s LEFT JOIN (SELECT * FROM events WHERE event_type = 'click') c
    ON c.user_id = s.user_id AND c.ts >= s.ts AND c.ts <= s.ts + INTERVAL 1 DAY GROUP BY 1, 2)"""


@query(
    "campaign_summary",
    f"""WITH {CAMPAIGN_SQL} SELECT count(*) AS records, {sql_round('avg(clicked)')} AS ctr, count(DISTINCT user_id) AS reached,
        {sql_round('count(DISTINCT user_id) / (SELECT count(*) FROM customer)::DOUBLE')} AS coverage FROM camp""",
)
def campaign_summary(spark: SparkSession, root: str) -> DataFrame:
    return comparable(Q.campaign_summary(campaigns(spark, root), spine(spark, root)))


@query(
    "dataset_statistics",
    EVENTS_SQL + f""", {CAMPAIGN_SQL}, stats AS (
    SELECT 'transactions' AS area, 'rows' AS item, count(*)::DOUBLE AS v FROM txn UNION ALL SELECT 'transactions', 'unique_users', count(DISTINCT user_id) FROM txn
    UNION ALL SELECT 'transactions', 'unique_products', count(DISTINCT product_id) FROM txn UNION ALL SELECT 'transactions', 'avg_amount', avg(amount) FROM txn
    UNION ALL SELECT 'transactions', 'total_revenue', sum(amount) FROM txn
    UNION ALL SELECT 'web_behavior', 'rows', count(*) FROM journey UNION ALL SELECT 'web_behavior', 'unique_users', count(DISTINCT user_id) FROM journey
    UNION ALL SELECT 'web_behavior', 'event_type:' || event_type, count(*) FROM journey GROUP BY event_type
    UNION ALL SELECT 'campaigns', 'rows', count(*) FROM camp UNION ALL SELECT 'campaigns', 'unique_users', count(DISTINCT user_id) FROM camp
    UNION ALL SELECT 'campaigns', 'ctr', avg(clicked) FROM camp
    UNION ALL SELECT 'products', 'rows', count(*) FROM part UNION ALL SELECT 'products', 'avg_price', avg(p_retailprice) FROM part
    UNION ALL SELECT 'products', 'category:' || p_type, count(*) FROM part GROUP BY p_type)
    SELECT area, item, {sql_round('v', 2)} AS "value" FROM stats""",
)
def dataset_statistics(spark: SparkSession, root: str) -> DataFrame:
    data = cleaned(spark, root)
    part = star.table(spark, root, "part").select(F.col("p_type").alias("category"), F.col("p_retailprice").alias("price"))
    return comparable(Q.dataset_statistics({
        "products": part, "transactions": A.transactions(data), "web_behavior": A.journey_events(data),
        "campaigns": campaigns(spark, root).drop("campaign_id"),
    }), 2)


# ---------------------------------------------------------------- metrics on prediction tables

SCORED_SQL = TARGETS_SQL + """, scored AS (SELECT t.*, c_mktsegment AS variant, (c_custkey * 37 % 101) / 100.0::DOUBLE AS a,
   CASE WHEN (c_custkey * 53 % 89) / 100.0::DOUBLE < 0.3::DOUBLE THEN churn * 0.9::DOUBLE ELSE (c_custkey * 53 % 89) / 100.0::DOUBLE END AS b,
   c_custkey FROM targets t JOIN customer ON CAST(c_custkey AS VARCHAR) = user_id)"""


def scored(spark: SparkSession, root: str) -> DataFrame:
    """Churn with two made scores that have ties, per market segment."""
    people = star.table(spark, root, "customer").select(
        F.col("c_custkey").cast("string").alias("user_id"), "c_custkey", F.col("c_mktsegment").alias("variant")
    )
    other = F.col("c_custkey") * 53 % 89 / 100.0
    # stands for a stored prediction table
    return settled(targets_of(spark, root).join(people, "user_id").withColumns({
        "a": F.col("c_custkey") * 37 % 101 / 100.0,
        "b": F.when(other < 0.3, F.col("churn") * 0.9).otherwise(other),
    }))


def _class_sql(score: str, key: str, source: str = "scored") -> str:
    return f"""d AS (SELECT {key} AS k, {score} AS s, sum(churn)::DOUBLE AS p, sum(1 - churn)::DOUBLE AS n FROM {source} GROUP BY 1, 2),
    r AS (SELECT *, sum(n) OVER (PARTITION BY k ORDER BY s) - n AS nb, sum(p) OVER (PARTITION BY k ORDER BY s DESC) AS pa,
                 sum(n) OVER (PARTITION BY k ORDER BY s DESC) AS na FROM d),
    curve AS (SELECT k, CASE WHEN sum(p) * sum(n) > 0 THEN sum(p * (nb + n / 2)) / (sum(p) * sum(n)) ELSE 0.5 END AS auc_roc,
                     CASE WHEN sum(p) > 0 THEN sum(p * pa / (pa + na)) / sum(p) ELSE 0 END AS avg_precision FROM r GROUP BY 1),
    cm AS (SELECT {key} AS k, count(*) FILTER (WHERE {score} >= 0.5 AND churn = 1) AS tp, count(*) FILTER (WHERE {score} >= 0.5 AND churn <> 1) AS fp,
                  count(*) FILTER (WHERE {score} < 0.5 AND churn = 1) AS fn, count(*) FILTER (WHERE {score} < 0.5 AND churn <> 1) AS tn FROM {source} GROUP BY 1)"""


@query(
    "classification_metrics",
    SCORED_SQL + f""", {_class_sql('a', 'variant')} SELECT k AS variant, tp, fp, fn, tn, {sql_round('auc_roc')} AS auc_roc, {sql_round('avg_precision')} AS avg_precision,
      {sql_round('coalesce(tp / nullif(tp + fp, 0)::DOUBLE, 0)')} AS "precision", {sql_round('coalesce(tp / nullif(tp + fn, 0)::DOUBLE, 0)')} AS recall,
      {sql_round('coalesce(2 * tp / nullif(2 * tp + fp + fn, 0)::DOUBLE, 0)')} AS f1, {sql_round('(tp + tn) / (tp + fp + fn + tn)::DOUBLE')} AS accuracy
      FROM cm JOIN curve USING (k)""",
)
def classification_metrics(spark: SparkSession, root: str) -> DataFrame:
    return comparable(M.classification_metrics(scored(spark, root), "churn", "a", ["variant"]))


@query("overall_auc", SCORED_SQL + f""", {_class_sql('b', '1')} SELECT {sql_round('auc_roc')} AS auc_roc, {sql_round('avg_precision')} AS avg_precision FROM curve""")
def overall_auc(spark: SparkSession, root: str) -> DataFrame:
    return comparable(M.auc_and_ap(scored(spark, root), "churn", "b"))


@query(
    "leak_alarm",
    SCORED_SQL + f""", {_class_sql('b', 'variant')} SELECT k AS variant, CASE WHEN auc_roc > 0.95 THEN 'leak' WHEN auc_roc < 0.55 THEN 'chance' ELSE 'healthy' END AS alarm FROM curve""",
)
def leak_alarm(spark: SparkSession, root: str) -> DataFrame:
    return Q.leak_alarm(M.auc_and_ap(scored(spark, root), "churn", "b", ["variant"])).select("variant", "alarm")


REG_SQL = """reg AS (SELECT variant, CAST(days_next_purchase AS DOUBLE) AS y, a * 300 AS p FROM scored)"""


@query(
    "regression_metrics",
    SCORED_SQL + f""", {REG_SQL} SELECT variant, {sql_round('sqrt(avg((y - p) * (y - p)))')} AS rmse, {sql_round('avg(abs(y - p))')} AS mae,
      {sql_round('1 - sum((y - p) * (y - p)) / (var_pop(y) * count(*))')} AS r2, {sql_round('avg(y)')} AS target_mean, count(*) AS n_valid FROM reg GROUP BY 1""",
)
def regression_metrics(spark: SparkSession, root: str) -> DataFrame:
    df = scored(spark, root).withColumn("p", F.col("a") * 300)
    return comparable(M.regression_metrics(df, "days_next_purchase", "p", ["variant"]))


@query(
    "log_target_round_trip",
    TARGETS_SQL + f" SELECT user_id, {sql_round('ln(1 + greatest(clv, 0))', 3)} AS log_clv, {sql_round('greatest(exp(ln(1 + greatest(clv, 0))) - 1, 0)', 2)} AS clv FROM targets",
)
def log_target_round_trip(spark: SparkSession, root: str) -> DataFrame:
    t = targets_of(spark, root).withColumn("log_clv", R.to_log_target("clv"))
    return t.select("user_id", F.round(F.col("log_clv") + 1e-9, 3).alias("log_clv"),
                    F.round(R.from_log_target("log_clv") + 1e-9, 2).alias("clv"))


@query(
    "multiclass_metrics",
    f"""WITH m AS (SELECT c_mktsegment AS y, CASE c_custkey % 4 WHEN 0 THEN 'BUILDING' WHEN 1 THEN 'MACHINERY' ELSE c_mktsegment END AS p FROM customer),
    cls AS (SELECT y AS c FROM m UNION SELECT p FROM m),
    per AS (SELECT c, (SELECT count(*) FROM m WHERE y = c) AS s, (SELECT count(*) FROM m WHERE p = c) AS g, (SELECT count(*) FROM m WHERE y = c AND p = c) AS h FROM cls)
    SELECT {sql_round('sum(h) / sum(s)::DOUBLE')} AS accuracy, {sql_round('avg(coalesce(2 * h / nullif(g + s, 0)::DOUBLE, 0))')} AS f1_macro,
      {sql_round('sum(coalesce(2 * h / nullif(g + s, 0)::DOUBLE, 0) * s) / sum(s)')} AS f1_weighted,
      {sql_round('sum(coalesce(h / nullif(g, 0)::DOUBLE, 0) * s) / sum(s)')} AS precision_weighted,
      {sql_round('sum(coalesce(h / nullif(s, 0)::DOUBLE, 0) * s) / sum(s)')} AS recall_weighted, CAST(sum(s) AS BIGINT) AS n_valid FROM per""",
)
def multiclass_metrics(spark: SparkSession, root: str) -> DataFrame:
    k = F.col("c_custkey") % 4
    df = star.table(spark, root, "customer").select(
        F.col("c_mktsegment").alias("y"),
        F.when(k == 0, "BUILDING").when(k == 1, "MACHINERY").otherwise(F.col("c_mktsegment")).alias("p"),
    )
    return comparable(M.multiclass_metrics(df, "y", "p"))


RANKED_SQL = """ranked AS (SELECT user_id, l_partkey, row_number() OVER (PARTITION BY user_id ORDER BY l_partkey * 7919 % 1009 DESC, l_partkey) AS rank,
   CASE WHEN l_partkey % 5 = 0 THEN 1 ELSE 0 END AS relevant
   FROM (SELECT DISTINCT CAST(o_custkey AS VARCHAR) AS user_id, l_partkey FROM orders JOIN lineitem ON l_orderkey = o_orderkey))"""


@query(
    "ranking_metrics",
    f"""WITH {RANKED_SQL}, g AS (SELECT user_id, sum(CASE WHEN rank <= 10 AND relevant = 1 THEN 1 / log2(rank + 1) ELSE 0 END) AS dcg, sum(relevant) AS n,
        max(CASE WHEN rank <= 10 AND relevant = 1 THEN 1 ELSE 0 END) AS hit FROM ranked GROUP BY 1),
    i AS (SELECT m, sum(1 / log2(r + 1)) OVER (ORDER BY r) AS ideal FROM (SELECT unnest(range(1, 11)) AS r, unnest(range(1, 11)) AS m))
    SELECT {sql_round('avg(CASE WHEN n > 0 THEN dcg / ideal ELSE 0 END)')} AS ndcg_at_10, {sql_round('avg(hit)')} AS hit_rate_at_10, count(*) AS queries
    FROM g LEFT JOIN i ON m = least(n, 10)""",
)
def ranking_metrics(spark: SparkSession, root: str) -> DataFrame:
    o = star.table(spark, root, "orders").select(F.col("o_custkey").cast("string").alias("user_id"), "o_orderkey")
    li = star.table(spark, root, "lineitem").select("l_orderkey", "l_partkey")
    pairs = o.join(li, F.col("l_orderkey") == F.col("o_orderkey")).select("user_id", "l_partkey").distinct()
    score = F.col("l_partkey") * 7919 % 1009
    ranked = pairs.select("user_id", F.row_number().over(W.partitionBy("user_id").orderBy(score.desc(), "l_partkey")).alias("rank"),
                          F.when(F.col("l_partkey") % 5 == 0, 1).otherwise(0).alias("relevant"))
    return comparable(M.ranking_metrics(ranked))


def _primary(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    s = scored(spark, root)
    auc_a = M.auc_and_ap(s, "churn", "a", ["variant"]).select(F.col("variant").alias("task"), F.lit("auc_roc").alias("metric"), F.col("auc_roc").alias("value"))
    auc_b = M.auc_and_ap(s, "churn", "b", ["variant"]).select(F.col("variant").alias("task"), F.lit("auc_roc").alias("metric"), F.col("auc_roc").alias("value"))
    return auc_b, auc_a.withColumn("model", F.lit("random_forest"))


TWO_CURVES = SCORED_SQL + ", " + _class_sql("a", "variant").replace("curve AS", "curve_a AS") + ", " + _class_sql("b", "variant").replace(
    "d AS", "d2 AS").replace("FROM d)", "FROM d2)").replace("r AS (SELECT *", "r2 AS (SELECT *").replace("FROM r GROUP", "FROM r2 GROUP").replace(
    "curve AS", "curve_b AS").replace("cm AS", "cm2 AS")


@query(
    "model_comparison",
    TWO_CURVES + """ SELECT b.k AS task, 'auc_roc' AS metric, 'random_forest' AS baseline, round(b.auc_roc + 1e-9::DOUBLE, 4) AS model_score,
      round(a.auc_roc + 1e-9::DOUBLE, 4) AS baseline_score, round(round(b.auc_roc - a.auc_roc, 4) + 1e-9::DOUBLE, 4) AS absolute_diff,
      round(round((b.auc_roc - a.auc_roc) / abs(a.auc_roc) * 100, 2) + 1e-9::DOUBLE, 4) AS relative_pct, b.auc_roc > a.auc_roc AS wins
      FROM curve_a a JOIN curve_b b USING (k)""",
)
def model_comparison(spark: SparkSession, root: str) -> DataFrame:
    mine, base = _primary(spark, root)
    return comparable(M.compare(mine, base))


@query(
    "result_matrix",
    TWO_CURVES + f""" SELECT a.k AS task, 'auc_roc' AS metric, {sql_round('a.auc_roc')} AS random_forest, {sql_round('b.auc_roc')} AS proposed,
      CASE WHEN b.auc_roc > a.auc_roc THEN 'proposed' ELSE 'random_forest' END AS best, {sql_round('b.auc_roc - a.auc_roc')} AS delta
      FROM curve_a a JOIN curve_b b USING (k)""",
)
def result_matrix(spark: SparkSession, root: str) -> DataFrame:
    mine, base = _primary(spark, root)
    rows = base.unionByName(mine.withColumn("model", F.lit("proposed")))
    return comparable(M.result_matrix(rows, ["random_forest", "proposed"], "proposed"))


@query(
    "best_models",
    TWO_CURVES + f""" SELECT a.k AS task, 'auc_roc' AS metric, CASE WHEN b.auc_roc > a.auc_roc THEN 'proposed' ELSE 'random_forest' END AS model,
      {sql_round('greatest(a.auc_roc, b.auc_roc)')} AS "value" FROM curve_a a JOIN curve_b b USING (k)""",
)
def best_models(spark: SparkSession, root: str) -> DataFrame:
    mine, base = _primary(spark, root)
    return comparable(M.best_models(base.unionByName(mine.withColumn("model", F.lit("proposed")))))


@query(
    "variant_metrics",
    SCORED_SQL + f""", {_class_sql('a', 'variant')}, {REG_SQL},
    rr AS (SELECT variant, sqrt(avg((y - p) * (y - p))) AS rmse, 1 - sum((y - p) * (y - p)) / (var_pop(y) * count(*)) AS r2 FROM reg GROUP BY 1)
    SELECT k AS variant, 'churn_auc' AS metric, {sql_round('auc_roc')} AS "value" FROM curve
    UNION ALL SELECT variant, 'days_r2', {sql_round('r2')} FROM rr UNION ALL SELECT variant, 'days_rmse', {sql_round('rmse')} FROM rr""",
)
def variant_metrics(spark: SparkSession, root: str) -> DataFrame:
    s = scored(spark, root).withColumn("p", F.col("a") * 300)
    c = M.auc_and_ap(s, "churn", "a", ["variant"]).withColumn("task", F.lit("churn"))
    r = M.regression_metrics(s, "days_next_purchase", "p", ["variant"]).withColumn("task", F.lit("days"))
    return comparable(M.variant_rows(c, r))


@query(
    "metric_grades",
    TWO_CURVES + """ SELECT b.k AS variant, CASE WHEN auc_roc >= 0.90 AND f1 >= 0.80 THEN 'STATE_OF_ART' WHEN auc_roc >= 0.85 AND f1 >= 0.70 THEN 'EXCELLENT'
      WHEN auc_roc >= 0.80 AND f1 >= 0.60 THEN 'GOOD' WHEN auc_roc >= 0.70 AND f1 >= 0.50 THEN 'ACCEPTABLE' ELSE 'POOR' END AS grade
      FROM curve_b b JOIN (SELECT k, coalesce(2 * tp / nullif(2 * tp + fp + fn, 0)::DOUBLE, 0) AS f1 FROM cm2) USING (k)""",
)
def metric_grades(spark: SparkSession, root: str) -> DataFrame:
    m = M.classification_metrics(scored(spark, root), "churn", "b", ["variant"])
    return m.select("variant", M.grade({"auc_roc": F.col("auc_roc"), "f1": F.col("f1")}, "churn_prediction").alias("grade"))


@query(
    "rank_correlation",
    SCORED_SQL + f""", pts AS (SELECT CAST(days_next_purchase AS DOUBLE) AS x, b AS y FROM scored),
    rk AS (SELECT x, y, rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0::DOUBLE AS rx,
                  rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0::DOUBLE AS ry FROM pts),
    w AS (SELECT x, y, count(*)::DOUBLE AS w FROM pts GROUP BY 1, 2),
    net AS (SELECT sum(p.w * q.w * sign(p.x - q.x) * sign(p.y - q.y)) / 2 AS s FROM w p, w q),
    tx AS (SELECT sum(n * (n - 1) / 2) AS t FROM (SELECT count(*)::DOUBLE AS n FROM pts GROUP BY x)),
    ty AS (SELECT sum(n * (n - 1) / 2) AS t FROM (SELECT count(*)::DOUBLE AS n FROM pts GROUP BY y)),
    n AS (SELECT count(*)::DOUBLE * (count(*) - 1) / 2 AS n FROM pts)
    SELECT {sql_round('(SELECT corr(rx, ry) FROM rk)')} AS spearman, {sql_round('s / sqrt((n - tx.t) * (n - ty.t))')} AS kendall FROM net, tx, ty, n""",
)
def rank_correlation(spark: SparkSession, root: str) -> DataFrame:
    df = scored(spark, root).select(F.col("days_next_purchase").cast("double").alias("x"), F.col("b").alias("y"))
    one = M.spearman(df, "x", "y")
    return comparable(one.withColumn("kendall", M.kendall(df, "x", "y").scalar()))


REPLICATES = 10_000
BOOT_SEEDS = sql_seeds("churn || '|' || (CASE WHEN b THEN '1.0' ELSE '0.0' END) || '|' || (CASE WHEN a THEN '1.0' ELSE '0.0' END)")


@query(
    "paired_bootstrap",
    SCORED_SQL + f""", cells AS (SELECT churn, a, b, n, {BOOT_SEEDS}, 12 * CAST(floor(sqrt(n)) AS BIGINT) + 30 AS wide FROM
        (SELECT churn, a >= 0.5 AS a, b >= 0.5 AS b, count(*) AS n FROM scored GROUP BY ALL)),
    pmf AS (SELECT churn, a, b, k, exp(k * ln(n) - n - lgamma(k + 1)) AS p FROM (SELECT *, unnest(range(greatest(0, n - wide), n + wide + 1)) AS k FROM cells)),
    cdf AS (SELECT churn, a, b, list(c ORDER BY k) AS cs, min(k) AS low FROM
        (SELECT *, sum(p) OVER (PARTITION BY churn, a, b ORDER BY k ROWS UNBOUNDED PRECEDING) AS c FROM pmf) GROUP BY 1, 2, 3),
    u AS (SELECT churn, a, b, r, ((h1 % 2147483647 + r * (h2 % 2147483647) + r * r * ((h1 + h2) % 65521)) % 2147483647) / 2147483647.0::DOUBLE AS u
        FROM cells, (SELECT unnest(range(1, {REPLICATES + 1})) AS r)),
    pois AS (SELECT r, churn, a, b, low + len(list_filter(cs, lambda x: x <= u)) AS w FROM u JOIN cdf USING (churn, a, b)),
    per AS (SELECT r, (sum(w * (b::INT = churn)::INT) - sum(w * (a::INT = churn)::INT)) / sum(w)::DOUBLE AS diff FROM pois GROUP BY 1),
    obs AS (SELECT avg(((b >= 0.5)::INT = churn)::INT) AS sb, avg(((a >= 0.5)::INT = churn)::INT) AS sa FROM scored)
    SELECT {sql_round('sb')} AS score_a, {sql_round('sa')} AS score_b, {sql_round('sb - sa')} AS observed_diff,
      {sql_round('count(*) FILTER (WHERE round(diff, 12) <= 0) / count(*)::DOUBLE')} AS p_value, {sql_round('quantile_cont(diff, 0.025)')} AS ci_95_lower,
      {sql_round('quantile_cont(diff, 0.975)')} AS ci_95_upper, count(*) FILTER (WHERE round(diff, 12) <= 0) / count(*)::DOUBLE < 0.05 AS significant
    FROM per, obs GROUP BY sa, sb""",
)
def paired_bootstrap(spark: SparkSession, root: str) -> DataFrame:
    return comparable(M.paired_bootstrap(scored(spark, root), "churn", "b", "a", replicates=REPLICATES))


@query(
    "evaluation_summary",
    TWO_CURVES + f""" SELECT b.k AS variant, {sql_round('b.auc_roc - a.auc_roc')} AS difference,
      CASE WHEN b.auc_roc > a.auc_roc THEN 'BETTER' WHEN b.auc_roc < a.auc_roc THEN 'WORSE' ELSE 'EQUAL' END AS verdict,
      {sql_round('b.auc_roc - 0.5')} AS improvement_over_random, b.auc_roc > 0.5::DOUBLE + 0.05::DOUBLE AS sanity_passed FROM curve_a a JOIN curve_b b USING (k)""",
)
def evaluation_summary(spark: SparkSession, root: str) -> DataFrame:
    s = scored(spark, root)
    ours = M.auc_and_ap(s, "churn", "b", ["variant"]).select("variant", F.col("auc_roc").alias("embedding_auc"))
    tree = M.auc_and_ap(s, "churn", "a", ["variant"]).select("variant", F.col("auc_roc").alias("tree_auc"))
    out = M.evaluation_summary(ours.join(tree, "variant").withColumn("random_auc", F.lit(0.5)))
    return comparable(out.select("variant", "difference", "verdict", "improvement_over_random", "sanity_passed"))


@query(
    "record_fields",
    """SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'segment' ELSE '' END AS missing, CASE WHEN c_custkey % 2 = 0 THEN 'note' ELSE '' END AS extra FROM customer""",
)
def record_fields(spark: SparkSession, root: str) -> DataFrame:
    """Fields a record lacks or has in excess, from its map of values."""
    k = F.col("c_custkey")
    pairs = F.array(
        F.struct(F.lit("name").alias("k"), F.col("c_name").alias("v")),
        F.when(k % 3 > 0, F.struct(F.lit("segment").alias("k"), F.col("c_mktsegment").alias("v"))),
        F.when(k % 2 == 0, F.struct(F.lit("note").alias("k"), F.lit("x").alias("v"))),
    )
    records = star.table(spark, root, "customer").select(k, F.map_from_entries(F.filter(pairs, lambda p: p.isNotNull())).alias("fields"))
    out = Q.missing_fields(records, "fields", ["name", "segment"])
    return out.select("c_custkey", F.array_join("missing", ",").alias("missing"), F.array_join("extra", ",").alias("extra"))
