import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from clientele.operators import signals as S
from clientele.plans import runs
from clientele.sources import contracts, readers, sinks, star

QUERIES, CHECKS = entry.queries(), entry.oracle_sql()
# too slow to train in every test run; tools/check_queries.py runs them
SLOW = {"baseline_models", "segment_models", "cutoff_models", "cluster_sweep", "feature_group_ablation", "value_group_ablation",
        "feature_set_comparison", "value_set_comparison"}


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(CHECKS))
def test_query_equals_its_sql(spark, root, name):
    from check_queries import compare, connect

    assert compare(QUERIES[name](spark, root), connect(root), CHECKS[name]) == []


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(CHECKS) - SLOW))
def test_query_without_sql_gives_rows(spark, root, name):
    assert QUERIES[name](spark, root).count() > 0


def test_names_are_unique_and_paired():
    assert set(CHECKS) <= set(QUERIES)


LAZY = ("cohort_micro_signals", "transactions", "customer_features", "all_targets", "cutoff_labels", "cutoff_features", "demographics")


@pytest.mark.parametrize("name", LAZY)
def test_plans_stay_in_the_engine(spark, root, name):
    plan = QUERIES[name](spark, root)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert "Python" not in plan


def test_groups_are_limited_before_the_shuffle(spark, root):
    for name in ("top_movers", "cutoff_sequences"):
        plan = QUERIES[name](spark, root)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("WindowGroupLimit") >= 2, name


def test_scans_read_only_needed_columns(spark, root):
    plan = QUERIES["cutoff_features"](spark, root)._jdf.queryExecution().executedPlan().toString()
    schemas = re.findall(r"ReadSchema: struct<([^>]*)>", plan)
    assert any("l_extendedprice" in s and "l_shipdate" not in s for s in schemas)


def test_literal_cutoff_reaches_the_scan(spark, root):
    from clientele.operators import leakfree as L

    t = star.lean_commerce(spark, root)
    plan = L.gated_orders(t["orders"], t["customers"], "2000-01-01")._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PushedFilters: \[[^\]]*LessThanOrEqual\(o_orderdate", plan)


def test_csv_round_trip(spark, root, tmp_path):
    tables = star.commerce(spark, root)
    for name in ("customers", "orders", "order_items", "payments", "reviews", "products", "sellers"):
        columns = [re.split(r"\s+", c.strip())[0] for c in contracts.RAW_SCHEMAS[name].split(", ")]
        df = tables[name]
        full = df.select(*[F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in columns])
        sinks.write_table(full.coalesce(1), str(tmp_path / f"{name}.csv"), "csv")
    back = readers.read_commerce_csv(spark, str(tmp_path))
    assert back["orders"].schema["order_purchase_timestamp"].dataType.simpleString() == "timestamp_ntz"
    assert back["geolocation"].count() == 0
    same = back["orders"].select("order_id", "order_purchase_timestamp").exceptAll(tables["orders"].select("order_id", "order_purchase_timestamp"))
    assert same.isEmpty()
    (tmp_path / "bad").mkdir()
    with pytest.raises(FileNotFoundError):
        readers.read_commerce_csv(spark, str(tmp_path / "bad"))


def test_bad_dates_become_null(spark):
    df = spark.createDataFrame([("2020-01-01 10:00:00",), ("never",), (None,)], "order_approved_at string")
    assert [r[0] is None for r in contracts.coerce_datetimes(df, ("order_approved_at",)).collect()] == [False, True, True]


def test_translation(spark):
    products = spark.createDataFrame([("p", "moveis"), ("q", "novo")], "product_id string, product_category_name string")
    names = spark.createDataFrame([("moveis", "furniture")], "product_category_name string, product_category_name_english string")
    got = {r.product_id: r.category_english for r in readers.translate_categories(products, names).collect()}
    assert got == {"p": "furniture", "q": "novo"}


def test_commerce_run_writes_and_reads_back(spark, root, tmp_path):
    out = runs.commerce_run(star.commerce(spark, root))
    assert runs.commerce_checks(out).where("status = 'error'").select("area", "check", "column").collect() == []
    runs.write_commerce_run(out, str(tmp_path))
    frame, names = runs.read_model_frame(spark, str(tmp_path))
    assert frame.count() == out["targets"].count() and "churn" not in names and "recency_days" in names
    files = readers.expected_files(spark, str(tmp_path), ["targets", "splits", "metadata", "nothing"])
    assert {r.name: r.ok for r in files.collect()} == {"targets": True, "splits": True, "metadata": True, "nothing": False}
    assert dict(contracts.missing_columns(out)) == {k: [] for k in contracts.CANONICAL_COLUMNS}


def test_signal_and_label_runs(spark, root):
    spec = S.SignalSpec("micro_signal", S.COHORT, "wow_purchase_velocity_pct", min_cohort=1)
    out = runs.signal_run(star.user_events(spark, root), star.user_profiles(spark, root), "2024-01-30", spec)
    assert out["signals"].count() > out["selected"].count() > 0 and out["trends"].count() > 0
    t = star.lean_commerce(spark, root)
    labels = runs.label_run(t)
    assert all(r.violations == 0 for r in labels["violations"].collect())
    assert labels["frame"].count() == labels["labels"].count()


@pytest.mark.parametrize("fmt,codec", [("csv", "gzip"), ("parquet", "snappy"), ("json", None)])
def test_sink_formats(spark, tmp_path, fmt, codec):
    path = sinks.write_table(spark.range(3), str(tmp_path / fmt), fmt, codec)
    reader = spark.read.option("header", True) if fmt == "csv" else spark.read
    assert reader.format(fmt).load(path).count() == 3
