"""Queries that write tables to a fresh folder and read them back: CSV load, formats, splits, frames and result tables."""

from __future__ import annotations

import uuid
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clientele.catalog import labels, query
from clientele.catalog.commerce import SEQ_SQL, cleaned, spine, txn_of
from clientele.catalog.common import CLEAN, CUSTOMERS, comparable, sql_round
from clientele.catalog.labels import GATED, UNIT_SQL
from clientele.catalog.signals import SIGNAL_OUT, WEEKLY_SQL, signal_frame
from clientele.functions import rules as R
from clientele.operators import adapter as A
from clientele.operators import features as X
from clientele.operators import leakfree as L
from clientele.operators import signals as S
from clientele.operators import splits as P
from clientele.operators.ordering import settled, work_dir
from clientele.plans import runs
from clientele.sources import contracts, readers, sinks, star


def fresh_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the shared work folder, deleted when the session's JVM ends."""
    path = f"{work_dir(spark)}/{name}-{uuid.uuid4().hex}"
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(folder)
    return path


# ---------------------------------------------------------------- CSV star

APPROVED = """CASE WHEN o_orderkey % 7 <> 0 AND o_orderkey % 7 <> 1 THEN o_orderdate END"""
TRANSLATED = "SELECT DISTINCT p_type AS name, lower(p_type) AS english FROM part WHERE length(p_type) % 2 = 0"


def csv_folder(spark: SparkSession, root: str) -> str:
    """The commerce tables as CSV files. Some approval times are empty or no dates, geolocation is missing, and categories
    with a name of even length have a translation."""
    tables = dict(star.commerce(spark, root))
    number = F.col("order_id").cast("bigint") % 7
    tables["orders"] = tables["orders"].withColumn(
        "order_approved_at", F.when(number == 0, "not a date").when(number != 1, F.col("order_purchase_timestamp").cast("string"))
    )
    name = F.col("product_category_name")
    tables["category_translation"] = tables["products"].where(F.length(name) % 2 == 0).select(
        name, F.lower(name).alias("product_category_name_english")
    ).distinct()
    path = fresh_folder(spark, "csv")
    for table, schema in contracts.RAW_SCHEMAS.items():
        if table in tables and table != "geolocation":
            whole = tables[table]
            columns = [f.split()[0] for f in schema.split(", ")]
            rows = whole.select(*[F.col(c) if c in whole.columns else F.lit(None).cast("string").alias(c) for c in columns])
            sinks.write_table(rows, f"{path}/{table}.csv", "csv")
    return path


@query(
    "csv_orders",
    f"""WITH {CLEAN} SELECT r.order_id, r.order_status, strftime(ts, '%Y-%m-%d %H:%M:%S') AS order_purchase_timestamp,
      strftime({APPROVED}, '%Y-%m-%d %H:%M:%S') AS order_approved_at, strftime(delivered, '%Y-%m-%d %H:%M:%S') AS order_delivered_customer_date
    FROM raw_orders r JOIN orders ON CAST(o_orderkey AS VARCHAR) = r.order_id""",
)
def csv_orders(spark: SparkSession, root: str) -> DataFrame:
    """Orders read from CSV; times that do not parse are empty."""
    orders = readers.read_commerce_csv(spark, csv_folder(spark, root))["orders"]
    return comparable(orders.select("order_id", "order_status", "order_purchase_timestamp", "order_approved_at", "order_delivered_customer_date"))


@query(
    "csv_categories",
    f"""WITH t AS ({TRANSLATED}) SELECT CAST(p_partkey AS VARCHAR) AS product_id, coalesce(english, p_type) AS category_english
    FROM part LEFT JOIN t ON name = p_type""",
)
def csv_categories(spark: SparkSession, root: str) -> DataFrame:
    """Products read from CSV with the translated category where there is one."""
    return readers.read_commerce_csv(spark, csv_folder(spark, root))["products"].select("product_id", "category_english")


@query(
    "csv_files",
    f"""SELECT 'customers' AS name, true AS ok, count(*) AS n FROM customer UNION ALL SELECT 'orders', true, count(*) FROM orders
    UNION ALL SELECT 'order_items', true, count(*) FROM lineitem UNION ALL SELECT 'payments', true, count(*) FROM orders
    UNION ALL SELECT 'reviews', true, count(*) FROM lineitem UNION ALL SELECT 'products', true, count(*) FROM part
    UNION ALL SELECT 'sellers', true, count(*) FROM supplier UNION ALL SELECT 'geolocation', false, 0
    UNION ALL SELECT 'category_translation', true, count(*) FROM ({TRANSLATED})""",
)
def csv_files(spark: SparkSession, root: str) -> DataFrame:
    """Which of the nine files are there and not empty, and how many rows each table is read with."""
    path = csv_folder(spark, root)
    files = readers.expected_files(spark, path, [f"{n}.csv" for n in contracts.RAW_SCHEMAS])
    counts = None
    for name, table in readers.read_commerce_csv(spark, path).items():
        one = table.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n")
        counts = one if counts is None else counts.unionByName(one)
    return files.select(F.regexp_replace("name", r"\.csv$", "").alias("name"), "ok").join(counts, "name")


# ---------------------------------------------------------------- formats, splits, frames

FORMATS = (("csv", "gzip"), ("json", "gzip"), ("parquet", "snappy"))


@query(
    "stored_formats",
    f"""WITH {CLEAN} SELECT format, user_id, count(*) AS n, {sql_round('sum(amount)', 2)} AS amount, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last
    FROM txn, (VALUES ('csv'), ('json'), ('parquet')) f(format) GROUP BY 1, 2""",
)
def stored_formats(spark: SparkSession, root: str) -> DataFrame:
    """Transactions written in every format with a codec and read back."""
    txn = settled(txn_of(spark, root).select("transaction_id", "user_id", "amount", "timestamp"))
    path, out = fresh_folder(spark, "formats"), None
    for fmt, codec in FORMATS:
        stored = spark.read.schema(txn.schema).option("header", True).format(fmt).load(sinks.write_table(txn, f"{path}/{fmt}", fmt, codec))
        stored = stored.withColumn("format", F.lit(fmt))
        out = stored if out is None else out.unionByName(stored)
    return comparable(out.groupBy("format", "user_id").agg(F.count(F.lit(1)).alias("n"), F.sum("amount").alias("amount"), F.max("timestamp").alias("last")), 2)


@query("stored_sequences", SEQ_SQL + " SELECT user_id, n, events FROM seqs")
def stored_sequences(spark: SparkSession, root: str) -> DataFrame:
    """Event sequences from the JSON lines of one object per user."""
    seq = X.interaction_sequences(settled(A.journey_events(cleaned(spark, root))))
    stored = spark.read.schema(seq.schema).json(sinks.write_sequences(seq, fresh_folder(spark, "sequences")))
    text = F.transform("events", lambda e: F.concat_ws(
        ":", e["event_type_id"].cast("string"), e["product_idx"].cast("string"), e["time_delta"].cast("bigint").cast("string")))
    return stored.select("user_id", F.size("events").cast("bigint").alias("n"), F.array_join(text, " ").alias("events"))


@query(
    "stored_splits",
    f"""WITH {CUSTOMERS}, u AS (SELECT customer_unique_id AS user_id, {UNIT_SQL.format(seed=7, key='customer_unique_id')} AS u FROM raw_customers)
    SELECT user_id, 'val' AS split FROM u WHERE u >= 0.8::DOUBLE""",
)
def stored_splits(spark: SparkSession, root: str) -> DataFrame:
    """One split read back; the folders of the others are pruned."""
    split = P.hash_split(spine(spark, root), seed=7, names=("train", "val"), ratios=(0.8, 0.2))
    return spark.read.parquet(sinks.write_splits(split, fresh_folder(spark, "splits"))).where("split = 'val'")


@query(
    "stored_model_frame",
    GATED + f""", u AS (SELECT who, {UNIT_SQL.format(seed=42, key='who')} AS u FROM lab)
    SELECT who AS customer_unique_id, recency_days, frequency, {sql_round('monetary', 2)} AS monetary, tenure_days, n_items,
      CAST(churn AS BIGINT) AS churn, {sql_round('clv', 2)} AS clv, CASE WHEN u < 0.8::DOUBLE THEN 'train' ELSE 'val' END AS split
    FROM fx JOIN lab USING (who) JOIN u USING (who)""",
)
def stored_model_frame(spark: SparkSession, root: str) -> DataFrame:
    """Features, targets and splits written, read back and joined."""
    t, path = labels.tables(spark, root), fresh_folder(spark, "run")
    targets = settled(labels.labels_of(t))
    sinks.write_table(labels.features_of(t), f"{path}/features/customers")
    sinks.write_table(targets, f"{path}/targets")
    sinks.write_splits(P.hash_split(targets.select(L.WHO), L.WHO, names=("train", "val"), ratios=(0.8, 0.2)), f"{path}/splits")
    frame, names = runs.read_model_frame(spark, path, L.WHO)
    features = [c for c in names if c != "avg_order_value"]
    return comparable(frame.select(L.WHO, *features, "churn", "clv", "split"), 2)


@query(
    "stored_results",
    f"""WITH w AS (SELECT o_orderstatus AS task, o_orderpriority AS model, CAST(count(*) AS DOUBLE) AS n, {sql_round('avg(o_totalprice)', 2)} AS mean,
      max(o_totalprice) AS top FROM orders GROUP BY 1, 2),
    r AS (SELECT task, model, 'n' AS metric, n AS value FROM w UNION ALL SELECT task, model, 'mean', mean FROM w UNION ALL SELECT task, model, 'top', top FROM w)
    SELECT place, task, model, metric, value FROM r, (VALUES ('combined'), ('per_task')) p(place)""",
)
def stored_results(spark: SparkSession, root: str) -> DataFrame:
    """A wide result table as long rows, written by task and combined, and both read back."""
    wide = star.table(spark, root, "orders").groupBy(F.col("o_orderstatus").alias("task"), F.col("o_orderpriority").alias("model")).agg(
        F.count(F.lit(1)).cast("double").alias("n"), F.round(F.avg("o_totalprice") + 1e-9, 2).alias("mean"), F.max("o_totalprice").alias("top")
    )
    path = fresh_folder(spark, "results")
    rows = sinks.result_rows(wide)
    sinks.write_results(settled(rows), path)
    one = spark.read.parquet(f"{path}/all_results").withColumn("place", F.lit("combined"))
    schema = "model string, metric string, value double, task string"
    return one.unionByName(spark.read.schema(schema).json(f"{path}/per_task").withColumn("place", F.lit("per_task")))


# ---------------------------------------------------------------- signals and values


@query("stored_signal", f"WITH {WEEKLY_SQL} SELECT {SIGNAL_OUT} FROM signal")
def stored_signal(spark: SparkSession, root: str) -> DataFrame:
    """The weekly signals exported under a time stamp in the fixed column order and read back."""
    signal = signal_frame(spark, root)
    path = sinks.write_signal(signal, fresh_folder(spark, "signal"), datetime(2024, 1, 2, 3, 4, 5))
    order = [c for c in sinks.SIGNAL_COLUMNS if c in signal.columns]
    return comparable(spark.read.schema(signal.select(*order).schema).option("header", True).csv(path))


METRICS = ("purchasers", "purchase_count", "total_revenue", "page_views", "sessions", "add_to_cart_events", "purchase_rate",
           "cart_conversion_rate", "pages_per_session", "national_avg_page_views", "web_footprint_vs_national")


@query(
    "signal_metrics",
    f"WITH {WEEKLY_SQL} " + " UNION ALL ".join(f"SELECT '{m}' AS metric, {sql_round(f'max({m})')} AS top FROM signal" for m in METRICS),
)
def signal_metrics(spark: SparkSession, root: str) -> DataFrame:
    """The columns taken as metrics when none are declared, with the largest value of each."""
    signal = signal_frame(spark, root)
    spec = S.SignalSpec(name="all", dimensions=S.COHORT, trend="wow_purchase_velocity_pct", cohort="active_users", period="week_start")
    names = S.metric_columns(signal, spec)
    tops = signal.agg(*[F.max(F.col(c).cast("double")).alias(c) for c in names])
    return comparable(tops.select(F.inline(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).alias("top")) for c in names]))))


@query(
    "sanitised_values",
    """SELECT event_id, CASE WHEN event_id % 5 = 0 OR event_id % 7 = 0 THEN 0 ELSE coalesce(value, 0) END AS value,
      coalesce(TRY_CAST(event_type AS DOUBLE), 0) AS from_text FROM events""",
)
def sanitised_values(spark: SparkSession, root: str) -> DataFrame:
    """Event values of which some became infinite or no number, and a text, all made finite numbers."""
    value = F.when(F.col("event_id") % 5 == 0, float("-inf")).when(F.col("event_id") % 7 == 0, float("nan")).otherwise(F.col("value"))
    return star.table(spark, root, "events").select(
        "event_id", R.sanitised(value).alias("value"), R.sanitised("event_type").alias("from_text")
    )


@query(
    "campaign_contacts",
    f"WITH {CUSTOMERS} SELECT customer_unique_id AS user_id, CAST(0 AS BIGINT) AS contacts, CAST(0 AS BIGINT) AS clicks FROM raw_customers",
)
def campaign_contacts(spark: SparkSession, root: str) -> DataFrame:
    """Campaign contacts and clicks of every customer; the commerce tables hold no campaigns, so all are 0."""
    per_user = A.campaigns(spark).groupBy("user_id").agg(F.count(F.lit(1)).alias("contacts"), F.sum("clicked").alias("clicks"))
    return spine(spark, root).join(per_user, "user_id", "left").fillna(0, ["contacts", "clicks"])
