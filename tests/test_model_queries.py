"""The model queries get all of what they compare, and stored predictions score as independent engines score them."""

import duckdb
import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from clientele.catalog import models as C
from clientele.operators import models as B
from clientele.operators.ordering import settled

SMALL = B.ModelSizes(trees=5, depth=3, leaf_rows=1, rounds=3, boost_depth=2, step=0.1, max_iter=50)
TASKS = (
    B.Task("late", "late", "binary"),
    B.Task("kind", "kind", "multiclass", valid="kind_valid"),
    B.Task("spent", "spent", "regression", log=True),
    B.Task("one", "one", "binary"),
    B.Task("few", "few", "regression"),
    B.Task("gone", "gone", "binary"),
)


@pytest.fixture(scope="module")
def made(spark):
    """Users with two features: the others depend on them; a class that counts only for some, and targets that cannot be fitted."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 2))
    rows = [
        (str(i), float(a), float(b), int(a + 0.3 * b > 0), int(a > 0) + int(b > 0), i % 3 != 0, float(np.exp(a + 2)), 1,
         1.0 if i < 10 else None, ("train", "train", "val", "test")[i % 4])
        for i, (a, b) in enumerate(x)
    ]
    names = "user_id string, a double, b double, late int, kind int, kind_valid boolean, spent double, one int, few double, split string"
    return settled(B.prepared(spark.createDataFrame(rows, names), ["a", "b"]))


def test_stored_predictions_score_the_same_in_sql(made):
    pred, skipped = B.baseline_predictions(made, TASKS, SMALL)
    pred = settled(pred)
    assert {(t, why) for t, _, why, _ in skipped} == {("one", "one class"), ("few", "too few rows"), ("gone", "no target")}
    found = {(r["task"], r["model"], r["metric"]): r["value"] for r in B.baseline_scores(pred).collect()}
    con = duckdb.connect()
    con.register("p", pred.where("split = 'test'").toPandas())
    con.register("v", pred.where("split = 'val'").toPandas())
    right = con.execute("SELECT task, model, avg((label = prediction)::INT) FROM p WHERE kind <> 'regression' GROUP BY 1, 2").fetchall()
    assert len(right) == 5 and all(found[t, m, "accuracy"] == pytest.approx(a) for t, m, a in right)
    auc = """SELECT x.task, x.model, avg(CASE WHEN x.score > y.score THEN 1 WHEN x.score = y.score THEN 0.5 ELSE 0 END)
             FROM {t} x JOIN {t} y ON x.task = y.task AND x.model = y.model WHERE x.label = 1 AND y.label = 0 AND x.kind = 'binary' GROUP BY 1, 2"""
    for table, metric in (("p", "auc_roc"), ("v", "val_auc_roc")):
        areas = con.execute(auc.format(t=table)).fetchall()
        assert len(areas) == 3 and all(found[t, m, metric] == pytest.approx(a) for t, m, a in areas)
    errors = con.execute("""SELECT model, sqrt(avg((label - prediction) ** 2)), avg(abs(label - prediction)),
        1 - sum((label - prediction) ** 2) / (var_pop(label) * count(*)) FROM p WHERE task = 'spent' GROUP BY 1""").fetchall()
    assert len(errors) == 3
    for m, *values in errors:
        assert [found["spent", m, k] for k in ("rmse", "mae", "r2")] == pytest.approx(values)


def test_rows_without_a_valid_label_neither_train_nor_count(made):
    hidden = made.withColumn("kind", F.when(F.col("kind_valid"), F.col("kind")).otherwise(F.lit(7)))
    pred, _ = B.baseline_predictions(hidden, [TASKS[1]], SMALL)
    rows = pred.select("label", "prediction", "split").collect()
    valid = made.where("kind_valid AND split <> 'train'").count()
    assert len(rows) == 2 * valid and all(7.0 not in (r["label"], r["prediction"]) for r in rows)


def test_a_bound_on_training_rows_leaves_the_scored_ones(made, monkeypatch):
    seen = []
    monkeypatch.setattr(B, "side_by_side", lambda df, fits: seen.extend(fits) or [f() for f in fits])
    pred, _ = B.baseline_predictions(made, [TASKS[0]], SMALL, train_rows=60)
    assert pred.count() == 3 * made.where("split <> 'train'").count()
    used = seen[0].__defaults__[1].count()
    assert 30 <= used <= 90


def test_every_labelled_row_trains_however_many_there_are(made, monkeypatch):
    """of more than a million training rows a hash of the key took a million."""
    seen, sizes = [], B._sizes
    monkeypatch.setattr(B, "_sizes", lambda *a: {t: {s: r.asDict() | {"n": 10_000 * r["n"]} for s, r in x.items()} for t, x in sizes(*a).items()})
    monkeypatch.setattr(B, "side_by_side", lambda df, fits: seen.extend(fits) or [f() for f in fits])
    B.train_baselines(made, TASKS[:3], SMALL)
    valid = made.where("split = 'train' AND kind_valid").count()
    every = made.where("split = 'train'").count()
    assert sorted(f.__defaults__[1].count() for f in seen if len(f.__defaults__) == 2) == [valid] * 2 + [every] * 6


def test_logistic_regression_adds_up_in_one_stage(made, monkeypatch):
    """it runs a job per iteration, and more than four partitions cost each of them a second stage."""
    dealt = made.repartition(9)
    seen = []
    monkeypatch.setattr(B, "side_by_side", lambda df, fits: seen.extend(fits) or [f() for f in fits])
    B.baseline_predictions(dealt, [TASKS[0]], SMALL)
    linear, forest, boosted = (f.__defaults__[1] for f in seen)
    assert [x.rdd.getNumPartitions() for x in (linear, forest, boosted)] == [4, 9, 9]
    assert linear.count() == forest.count() == made.where("split = 'train'").count()
    many = B.training_rows(B.LogisticRegression(), dealt, 2_000_000)
    assert many.rdd.getNumPartitions() == 8


def test_forests_keep_the_node_of_each_row():
    """each level of a forest sent every row down every tree again, from its root."""
    forests = [made["random_forest"] for made in (B.classifiers(SMALL), B.regressors(SMALL, 100))]
    assert all(m.getCacheNodeIds() for m in forests)


def test_each_model_scores_in_a_run_of_its_own(made, monkeypatch):
    """one stage applied all models, and each of its tasks got a copy of every one of them."""
    dealt = made.repartition(9)
    seen, stored = [], B.stored
    monkeypatch.setattr(B, "stored", lambda df: seen.append(df) or stored(df))
    monkeypatch.setattr(B, "settled", lambda df: df)
    found = {(r["task"], r["model"], r["metric"]) for r in B.train_baselines(dealt, TASKS[:3], SMALL).collect()}
    assert len(found) == 3 * 7 + 2 * 3 + 3 * 4
    held, valid = (made.where(f"split <> 'train' AND {x}").count() for x in ("true", "kind_valid"))
    assert sorted(x.count() for x in seen) == [valid] * 2 + [held] * 6
    assert all(x.rdd.getNumPartitions() == 4 and len(x.select("task", "model").distinct().collect()) == 1 for x in seen)


def test_ridge_solves_the_normal_equations(made):
    pred, _ = B.baseline_predictions(made, [TASKS[2]], SMALL)
    mine = sorted((r["label"], r["prediction"]) for r in pred.where("model = 'ridge_regression' AND split = 'test'").collect())

    def side(split):
        rows = made.where(F.col("split") == split).select(vector_to_array("features").alias("x"), "spent").collect()
        return np.array([r["x"] for r in rows]), np.array([r["spent"] for r in rows])

    (x, y), (xt, yt) = side("train"), side("test")
    z = np.log1p(y)
    w = np.linalg.solve(x.T @ x + np.eye(2), x.T @ (z - z.mean()))
    expected = sorted(zip(yt, np.maximum(np.expm1(xt @ w + z.mean()), 0), strict=True))
    assert np.allclose(mine, expected, rtol=0.02)


def test_ablation_of_a_quantity_gives_what_each_group_lacks(made):
    rows = B.group_ablation(made.drop("split", "features"), "user_id", {"x": ["a"], "y": ["b"]}, "spent", "spent", kind="regression").collect()
    value = {(r["model"], r["metric"]): r["value"] for r in rows}
    assert {m for _, m in value} == {"rmse", "mae", "r2", "r2_diff"}
    for g in ("x", "y"):
        assert value[f"full_vs_{g}", "r2_diff"] == pytest.approx(value["full", "r2"] - value[g, "r2"])
    assert value["x", "r2"] > 0.3 > value["y", "r2"]


@pytest.mark.parametrize("kind, label, log", [("binary", "late", False), ("regression", "spent", True)])
def test_the_first_set_is_held_against_all_others(made, kind, label, log):
    data = made.drop("split", "features").withColumn("v", F.array("a", "b")).withColumn("noise", B.noise_like("v", "user_id"))
    assert data.where("size(noise) <> size(v) OR noise[0] = noise[1]").count() == 0
    rows = B.compare_feature_sets(data, "user_id", {"v": "v", "random": "noise"}, "v", label, "t", SMALL, kind=kind, log=log).collect()
    value = {(r["model"], r["metric"]): r["value"] for r in rows}
    lead = "auc_roc" if kind == "binary" else "r2"
    for other in ("random_linear", "random_forest_raw", "boosted_trees_raw"):
        assert value[f"v_linear_vs_{other}", f"{lead}_diff"] == pytest.approx(value["v_linear", lead] - value[other, lead])
    assert value["v_linear_vs_random_linear", f"{lead}_diff"] > 0.2


def test_every_feature_and_task_is_trained(spark, root, monkeypatch):
    seen = {}

    def keep(frame, names):
        seen.update(names=set(names), columns=set(frame.columns))
        return frame

    monkeypatch.setattr(C.B, "prepared", keep)
    monkeypatch.setattr(C.B, "train_baselines", lambda data, tasks, *more, **named: seen.update(tasks=tasks))
    C.baseline_models(spark, root)
    features, targets = set(C.features_of(spark, root).columns) - {"user_id"}, set(C.targets_of(spark, root).columns) - {"user_id"}
    assert seen["names"] == features - targets and targets <= seen["columns"] and seen["tasks"] == B.TASKS
    C.cutoff_models(spark, root)
    assert [t.valid for t in seen["tasks"]] == ["churn_valid", "category_valid", "clv_valid"]


def test_the_comparison_gets_the_whole_vector(spark, root, monkeypatch):
    seen = {}
    monkeypatch.setattr(C.B, "compare_feature_sets", lambda v, key, sets, raw, *more: seen.update(raw=v.select(raw, "embedding").collect()))
    C.feature_set_comparison(spark, root)
    assert seen["raw"] and all(len(r[0]) > 8 and r[0] == r[1] for r in seen["raw"])
