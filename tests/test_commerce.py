import pytest
from tests.conftest import ts
from pyspark.sql import functions as F

from clientele.catalog import commerce, models, quality
from clientele.operators import adapter as A
from clientele.operators import features as X
from clientele.operators import leakfree as L
from clientele.operators import quality as Q
from clientele.operators import splits as P
from clientele.operators import targets as G

TXN = "transaction_id string, user_id string, product_id string, timestamp timestamp_ntz, amount double, price double, freight double, seller_id string, review_score double"


def txn(spark, rows):
    full = [(f"t{i}", u, p, ts(t), a, a, 0.0, "s", r) for i, (u, p, t, a, r) in enumerate(rows)]
    return spark.createDataFrame(full, TXN)


def users(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "user_id string")


def values(df, column):
    return {r.user_id: r[column] for r in df.collect()}


def test_churn_is_strict_and_missing_users_churn(spark):
    t = txn(spark, [("end", "p", "2020-12-31T00:00:00", 1.0, None), ("edge", "p", "2020-10-02T00:00:00", 1.0, None),
                    ("late", "p", "2020-10-01T23:59:59", 1.0, None)])
    got = values(G.churn(users(spark, "end", "edge", "late", "none"), t), "churn")
    assert got == {"end": 0, "edge": 0, "late": 1, "none": 1}


def test_upsell_rules(spark):
    t = txn(spark, [
        ("one", "p", "2020-01-01T00:00:00", 9.0, None),
        ("up", "p", "2020-01-01T00:00:00", 100.0, None), ("up", "p", "2020-01-02T00:00:00", 120.0, None),
        ("flat", "p", "2020-01-01T00:00:00", 100.0, None), ("flat", "p", "2020-01-02T00:00:00", 119.0, None),
        ("free", "p", "2020-01-01T00:00:00", 0.0, None), ("free", "p", "2020-01-02T00:00:00", 9.0, None),
        ("same", "p", "2020-01-01T00:00:00", 5.0, None), ("same", "q", "2020-01-01T00:00:00", 50.0, None),
    ])
    people = users(spark, "one", "up", "flat", "free", "same", "none")
    expected = {"one": 0, "up": 1, "flat": 0, "free": 0, "same": 0, "none": 0}
    assert values(G.upsell(people, t), "upsell") == expected
    assert values(G.all_targets(people, t), "upsell") == expected


def test_days_to_next_counts_item_rows(spark):
    t = txn(spark, [
        ("pair", "p", "2020-01-01T00:00:00", 1.0, None), ("pair", "q", "2020-01-01T00:00:00", 1.0, None), ("pair", "q", "2019-12-01T00:00:00", 1.0, None),
        ("solo", "p", "2020-01-01T12:00:00", 1.0, None), ("end", "p", "2020-01-11T00:00:00", 1.0, None), ("end", "p", "2018-01-11T00:00:00", 1.0, None),
    ])
    people = users(spark, "pair", "solo", "end", "none")
    expected = {"pair": 0, "solo": 9, "end": 365, "none": 365}
    assert values(G.days_to_next(people, t), "days_next_purchase") == expected
    assert values(G.all_targets(people, t), "days_next_purchase") == expected
    assert values(G.days_to_next(people, t, dedupe="day"), "days_next_purchase")["pair"] == 31


def test_early_adopter_bounds(spark):
    t = txn(spark, [("first", "p", "2020-01-01T12:00:00", 1.0, None), ("in", "p", "2020-02-01T11:00:00", 1.0, None),
                    ("out", "p", "2020-02-01T12:00:00", 1.0, None)])
    assert values(G.early_adopter(users(spark, "first", "in", "out", "none"), t), "early_adopter") == {"first": 1, "in": 1, "out": 0, "none": 0}


def test_satisfaction_default_and_limit(spark):
    t = txn(spark, [("low", "p", "2020-01-01T00:00:00", 1.0, 2.0), ("mid", "p", "2020-01-01T00:00:00", 1.0, 2.5), ("mute", "p", "2020-01-01T00:00:00", 1.0, None)])
    out = G.satisfaction_risk(users(spark, "low", "mid", "mute"), t)
    assert values(out, "satisfaction_risk") == {"low": 1, "mid": 0, "mute": 0}
    assert values(out, "avg_review_score")["mute"] == 3.0


def test_ground_truth_flag_for_never_buyers(spark):
    t = txn(spark, [("a", "p", "2020-01-01T00:00:00", 1.0, None)])
    people = users(spark, "a", "none")
    assert values(G.ground_truth(people, t), "churned") == {"a": 0, "none": 1}
    assert values(G.ground_truth(people, t, legacy=True), "churned") == {"a": 0, "none": 0}


def test_features_of_a_single_row_user(spark):
    t = txn(spark, [("a", "p", "2020-01-01T00:00:00", 10.0, None)])
    r = X.spending(t).first()
    assert (r.std_order_value, r.total_items, r.frequency, r.avg_review_score, r.freight_pct) == (0.0, 1, 1, None, 0.0)


def test_category_mode_takes_smallest_on_tie(spark):
    rows = [("a", "y"), ("a", "x"), ("a", None), ("b", None)]
    items = spark.createDataFrame(rows, "customer_unique_id string, category_english string")
    out = X.category_taste(items)
    assert values(out, "top_category") == {"a": "x", "b": "unknown"}
    assert values(out, "n_unique_categories") == {"a": 2, "b": 0}


def small_tables(spark):
    o = [("o1", "c1", "delivered", ts("2020-01-01T10:00:00"), ts("2020-01-03T09:00:00"), ts("2020-01-04T00:00:00")),
         ("o2", "c2", "canceled", ts("2020-01-02T10:00:00"), None, None), ("o3", "c3", "shipped", None, None, None),
         ("o4", "c9", "shipped", ts("2020-01-05T00:00:00"), None, None), ("o5", "c1", None, ts("2020-01-06T00:00:00"), None, None)]
    orders = spark.createDataFrame(o, "order_id string, customer_id string, order_status string, order_purchase_timestamp timestamp_ntz, order_delivered_customer_date timestamp_ntz, order_estimated_delivery_date timestamp_ntz")
    orders = orders.withColumn("order_approved_at", F.lit(None).cast("timestamp_ntz")).withColumn("order_delivered_carrier_date", F.lit(None).cast("timestamp_ntz"))
    return {
        "orders": orders,
        "customers": spark.createDataFrame([("c1", "u1", 1, "x", "y"), ("c2", "u2", 1, "x", "y"), ("c3", "u3", 1, None, None)], "customer_id string, customer_unique_id string, customer_zip_code_prefix int, customer_city string, customer_state string"),
        "order_items": spark.createDataFrame([("o1", 1, "p1", "s", 10.0, 1.0), ("o2", 1, "p1", "s", 10.0, 1.0), ("o4", 1, "p2", "s", 5.0, 1.0)], "order_id string, order_item_id int, product_id string, seller_id string, price double, freight_value double"),
        "payments": spark.createDataFrame([("o1", "card", 2, 6.0), ("o1", "boleto", 1, 5.0)], "order_id string, payment_type string, payment_installments int, payment_value double"),
        "reviews": spark.createDataFrame([("o1", 5, None, ts("2020-02-01T00:00:00")), ("o1", 4, "fine", ts("2020-02-02T00:00:00"))], "order_id string, review_score int, review_comment_message string, review_creation_date timestamp_ntz"),
        "products": spark.createDataFrame([("p1", "k1")], "product_id string, category_english string"),
    }


def test_cleaning(spark):
    d = A.clean(small_tables(spark))
    orders = d["orders"].collect()
    # canceled, undated, unknown customers and unlisted states drop out
    assert [r.order_id for r in orders] == ["o1"]
    r = orders[0]
    assert (r.total_payment, r.n_installments, r.payment_types, r.n_payment_methods) == (11.0, 2, "boleto,card", 2)
    assert (r.review_score, r.has_review_comment, r.delivery_days, r.delivery_vs_estimate) == (4.5, True, 1, -1)
    # items of valid orders stay even when the customer is unknown, but are no transactions
    assert sorted(r.order_id for r in d["order_items"].collect()) == ["o1", "o4"]
    assert [r.transaction_id for r in A.transactions(d).collect()] == ["o1_1"]
    kinds = sorted((r.event_type, r.product_id) for r in A.journey_events(d).collect())
    assert kinds == [("delivered", "ORDER_o1"), ("order_placed", "ORDER_o1"), ("purchase", "p1"), ("review_score_5", "REVIEW_o1")]
    assert A.clean(small_tables(spark), min_orders=2)["orders"].count() == 0
    assert A.campaigns(spark).columns == ["user_id", "campaign_id", "timestamp", "clicked"]


def test_states_without_a_value_stay_in_the_deny_list(spark):
    assert sorted(r.order_id for r in A.not_excluded(small_tables(spark)["orders"]).collect()) == ["o1", "o3", "o4", "o5"]


def test_repeated_key_fails_the_join(spark):
    right = spark.createDataFrame([("a", 1), ("a", 2)], "k string, v int")
    with pytest.raises(Exception, match="not unique"):
        L.many_to_one(right, "k").collect()


def test_late_cutoff_fails(spark):
    t = small_tables(spark)
    products = t["products"].withColumnRenamed("category_english", "product_category_name")
    with pytest.raises(Exception, match="observation window"):
        L.labels(t["orders"], t["order_items"], products, t["customers"], "2020-01-05", min_history=0).collect()


def test_padding(spark):
    seq = spark.createDataFrame([([(1, 2, 3.0)],)], "events array<struct<event_type_id:int,product_idx:int,time_delta:double>>")
    padded = seq.select(X.pad_left("events", 3).alias("e")).first().e
    assert [tuple(e) for e in padded] == [(0, 0, 0.0), (0, 0, 0.0), (1, 2, 3.0)]
    assert len(seq.select(X.pad_left("events", 1).alias("e")).first().e) == 1


def test_time_features(spark):
    got = spark.range(1).select(L.time_features(F.array(F.lit(-3.0), F.lit(30.0))).alias("t")).first().t
    assert got[0] == [0.0, 0.0, 0.0] and abs(got[1][1] - 1.0) < 1e-12


def test_split_sizes_and_checks(spark):
    people = spark.range(103).selectExpr("cast(id as string) as user_id")
    split = P.exact_split(people)
    sizes = {r.split: r["count"] for r in split.groupBy("split").count().collect()}
    assert sizes == {"train": 72, "val": 15, "test": 16}
    report = {(r.check, r.column): (r.value, r.status) for r in Q.check_splits(split, people).collect()}
    assert report["overlap", "train-val"] == (0.0, "ok") and report["uncovered", "user_id"] == (0.0, "ok")
    bad = split.where("user_id <> '5'").unionByName(split.where("user_id = '7'").withColumn("split", F.lit("zzz")))
    bad = bad.unionByName(split.where("split = 'val'").limit(1).withColumn("split", F.lit("train")))
    report = {(r.check, r.column): (r.value, r.status) for r in Q.check_splits(bad, people).collect()}
    assert report["overlap", "train-val"] == (1.0, "error") and report["uncovered", "user_id"] == (1.0, "warning")


def test_feature_faults(spark):
    rows = [(str(i), 1.0, None, float("inf") if i == 3 else 1.0 * i, 1e11 if i == 2 else 0.5) for i in range(10)]
    df = spark.createDataFrame(rows, "user_id string, constant double, empty double, endless double, huge double")
    status = {(r.check, r.column): r.status for r in Q.check_features(df).collect()}
    assert status["zero_variance", "constant"] == "warning" and status["all_null", "empty"] == "error"
    assert status["infinite", "endless"] == "error" and status["huge", "huge"] == "error" and status["huge", "constant"] == "ok"


@pytest.mark.parametrize("make", ["meta_of", "model_data"])
def test_features_and_targets_share_their_transactions(spark, root, monkeypatch, make):
    """items were joined with orders and reviews up to three times."""
    made = []
    whole = A.transactions
    monkeypatch.setattr(A, "transactions", lambda data: made.append(1) or whole(data))
    if make == "model_data":
        monkeypatch.setattr(models.B, "prepared", lambda frame, names: frame)
        rows = models.model_data(spark, root)
        cells = ["user_id", F.round("clv", 4)]
        assert rows.select(*cells).exceptAll(commerce.targets_of(spark, root).select(*cells)).count() == 0
        assert len(made) == 2  # one of them for this comparison
    else:
        _, feats, targets = quality.meta_of(spark, root)
        assert len(made) == 1 and {"monetary", "top_category"} <= set(feats.columns) and "upsell" in targets.columns


def test_spending_counts_distinct_values_apart(spark):
    """one aggregate with three distinct counts shuffled every row once per count, and spilled."""
    rows = [
        (u, f"t{i // 2}" if i % 7 else None, f"p{i % 3}" if u != "b" else None, f"s{i % 4}", 1.0 * i)
        for u in ("a", "b", None) for i in range(12)
    ]
    t = spark.createDataFrame(rows, "user_id string, transaction_id string, product_id string, seller_id string, amount double").withColumns({
        "timestamp": F.lit("2020-01-01").cast("timestamp_ntz"), "price": F.col("amount"), "freight": F.lit(1.0), "review_score": F.lit(None).cast("double"),
    })
    got = X.spending(t)
    names = {"frequency": "transaction_id", "n_unique_products": "product_id", "n_unique_sellers": "seller_id"}
    want = t.groupBy("user_id").agg(*[F.countDistinct(c).alias(n) for n, c in names.items()], F.count("transaction_id").alias("total_items"))
    key = lambda df: sorted(tuple(map(str, r)) for r in df.select("user_id", *names, "total_items").collect())
    assert key(got) == key(want) and len(key(got)) == 3
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert all("isnull(user_id" in below for below in plan.split("Expand")[1:])  # only rows without a user


def test_features_read_orders_and_items_once(spark, root):
    """items were joined with orders three times, and the times of orders computed four times."""
    plan = commerce.features_of(spark, root)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("lineitem.parquet") == 1  # the reviews
    data = commerce.cleaned(spark, root)
    once, sold = A.computed_once(data)
    assert sold.columns == A.transactions(data).columns
    for name, cells in (("owned_orders", data["owned_orders"].columns),
                        ("order_items", ["order_id", "customer_unique_id", "product_id", "category_english", "price", "freight_value"])):
        was, now = (d[name].where(F.col("customer_unique_id").isNotNull()).select(*cells) for d in (data, once))
        rows = sorted(map(str, was.collect()))
        assert rows and rows == sorted(map(str, now.collect()))
