"""Model baselines with MLlib: scaling fitted on train, task loop, probes and ablations.

Everything returns long ``(task, model, metric, value)`` rows. Rows stay distributed; MLlib
exchanges gradients, histograms and tree splits.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from multiprocessing.pool import ThreadPool

from pyspark.ml import Estimator, Model, Pipeline
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.evaluation import MulticlassClassificationEvaluator, RegressionEvaluator
from pyspark.ml.feature import StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.util import inheritable_thread_target

from clientele.functions import rules as R
from clientele.functions.hashing import unit_hash
from clientele.operators import metrics as M
from clientele.operators.neighbours import fit, hashed_nearest
from clientele.operators.ordering import settled, stored
from clientele.operators.pairs import nearest
from clientele.operators.splits import stratified_folds, stratified_split


@dataclass(frozen=True)
class ModelSizes:
    """Size of the tree models; the defaults are those of the full comparison."""

    trees: int = 300
    depth: int = 12
    leaf_rows: int = 5
    rounds: int = 500
    boost_depth: int = 8
    step: float = 0.05
    max_iter: int = 1000


@dataclass(frozen=True)
class Task:
    """A target to predict; ``valid`` names a boolean column that says which rows count."""

    name: str
    target: str
    kind: str  # binary, multiclass or regression
    valid: str | None = None
    log: bool = False


TASKS = (
    Task("churn", "churn", "binary"),
    Task("upsell", "upsell", "binary"),
    Task("early_adopter", "early_adopter", "binary"),
    Task("satisfaction_risk", "satisfaction_risk", "binary"),
    Task("clv", "clv", "regression", log=True),
    Task("days_next_purchase", "days_next_purchase", "regression"),
)
MIN_TRAIN, MIN_TEST = 20, 5
AT_ONCE = 6
# so many partitions are summed up without a second stage; they hold this many rows each before there are more of them
FEW, PART_ROWS = 4, 250_000


def classifiers(sizes: ModelSizes, seed: int = 42, boosted: bool = True) -> dict:
    out = {
        "logistic_regression": LogisticRegression(maxIter=sizes.max_iter, regParam=0.0),
        "random_forest": RandomForestClassifier(numTrees=sizes.trees, maxDepth=sizes.depth, minInstancesPerNode=sizes.leaf_rows,
                                                cacheNodeIds=True, seed=seed),
    }
    if boosted:
        out["boosted_trees"] = GBTClassifier(maxIter=sizes.rounds, maxDepth=sizes.boost_depth, stepSize=sizes.step,
                                             subsamplingRate=0.8, seed=seed)
    return out


def ridge(n_train: int) -> LinearRegression:
    """Ridge with penalty 1 on the sum of squares, which is 1 / n on the mean that MLlib minimises."""
    return LinearRegression(regParam=1.0 / max(n_train, 1), elasticNetParam=0.0)


def regressors(sizes: ModelSizes, n_train: int, seed: int = 42) -> dict:
    return {
        "ridge_regression": ridge(n_train),
        "random_forest": RandomForestRegressor(numTrees=sizes.trees, maxDepth=sizes.depth, minInstancesPerNode=sizes.leaf_rows,
                                               cacheNodeIds=True, seed=seed),
        "boosted_trees": GBTRegressor(maxIter=sizes.rounds, maxDepth=sizes.boost_depth, stepSize=sizes.step,
                                      subsamplingRate=0.8, seed=seed),
    }


def model_frame(features: DataFrame, targets: DataFrame, splits: DataFrame, key: str = "user_id") -> tuple[DataFrame, list[str]]:
    """Features, targets and split of each user, and the names of the feature columns.

    Target columns that also exist as features are taken from the targets.
    """
    labels = [c for c in targets.columns if c != key]
    kept = features.select(*[c for c in features.columns if c not in labels])
    frame = kept.join(targets, key).join(splits, key)
    return frame, [c for c in kept.columns if c != key]


def encoded(train: DataFrame, columns: Sequence[str], numeric: Sequence[str]) -> Pipeline:
    """Text to codes (unseen values get a code of their own), numbers made finite, all scaled on train."""
    stages = [StringIndexer(inputCols=list(columns), outputCols=[f"__{c}" for c in columns], handleInvalid="keep",
                            stringOrderType="alphabetAsc")] if columns else []
    stages.append(VectorAssembler(inputCols=[*[f"__{c}" for c in columns], *numeric], outputCol="__raw"))
    stages.append(StandardScaler(inputCol="__raw", outputCol="features", withMean=True, withStd=True))
    return Pipeline(stages=stages).fit(train)


def prepared(frame: DataFrame, feature_columns: Sequence[str]) -> DataFrame:
    """The frame with a scaled ``features`` vector; scaling and codes come from the train split only."""
    text = R.string_columns(frame.select(*feature_columns))
    numeric = [c for c in feature_columns if c not in text]
    finite = frame.withColumns({c: R.sanitised(c) for c in numeric}).fillna("unknown", text)
    fitted = encoded(finite.where("split = 'train'"), text, numeric)
    return fitted.transform(finite).drop("__raw", *[f"__{c}" for c in text])


def _positive(c: str = "probability"):
    return F.element_at(vector_to_array(c), 2)


def _rows(df: DataFrame, task: str, model: str, metrics: Sequence[str], prefix: str = "") -> DataFrame:
    cells = [F.struct(F.lit(prefix + m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics]
    return df.select(F.inline(F.array(*cells))).select(F.lit(task).alias("task"), F.lit(model).alias("model"), "metric", "value")


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


BINARY_METRICS = ("auc_roc", "f1", "precision", "recall", "accuracy", "avg_precision")
REGRESSION_METRICS = ("rmse", "mae", "r2")


MULTICLASS_METRICS = ("accuracy", "f1_macro", "f1_weighted")


def side_by_side(df: DataFrame, fits: Sequence[Callable[[], Model]], at_once: int = AT_ONCE) -> list[Model]:
    """The models (or stored tables) that some functions return, several trained at a time.

    Trees are trained by many short Spark jobs, level by level; one model alone leaves most cores idle.
    """
    if not fits:
        return []
    with ThreadPool(min(at_once, len(fits))) as pool:
        return pool.map(lambda fit_one: fit_one(), [inheritable_thread_target(df.sparkSession)(f) for f in fits])


def _parts(n: int) -> int:
    return max(FEW, -(-n // PART_ROWS))


def training_rows(model: Estimator, train: DataFrame, n: int) -> DataFrame:
    """The rows as the model should read them: logistic regression runs one job per iteration, a thousand or more of them.

    Each job is short, so its stages count: with more than ``FEW`` partitions MLlib adds gradients up in a second one.
    """
    return train.coalesce(_parts(n)) if isinstance(model, LogisticRegression) else train


def _long(df: DataFrame, metrics: Sequence[str], prefix: str = "") -> DataFrame:
    cells = [F.struct(F.lit(prefix + m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics]
    return df.select("task", "model", F.inline(F.array(*cells)))


def _label(task: Task) -> Column:
    """The target as a number; null where the row does not count for the task."""
    target = F.col(task.target).cast("double")
    return F.when(F.col(task.valid), target) if task.valid else target


def _sizes(data: DataFrame, tasks: Sequence[Task]) -> dict:
    """Rows, smallest and largest label by task and split, from one pass."""
    if not tasks:
        return {}
    cells = [F.struct(F.count(_label(t)).alias("n"), F.min(_label(t)).alias("a"), F.max(_label(t)).alias("b")).alias(t.name) for t in tasks]
    found = data.groupBy("split").agg(*cells).collect()  # one row per split
    return {t.name: {r["split"]: r[t.name] for r in found if r[t.name]["n"]} for t in tasks}


def _unfit(task: Task, size: dict, test: str) -> str | None:
    if "train" not in size or test not in size or size["train"]["n"] < MIN_TRAIN or size[test]["n"] < MIN_TEST:
        return "too few rows"
    if task.kind != "regression" and size["train"]["a"] == size["train"]["b"]:
        return "one class"
    return None


def _estimators(task: Task, sizes: ModelSizes, n_train: int, seed: int) -> dict:
    if task.kind == "regression":
        return regressors(sizes, n_train, seed)
    return classifiers(sizes, seed, boosted=task.kind == "binary")


def _predicted(task: Task, name: str, fitted: Model, rows: DataFrame) -> DataFrame:
    out = fitted.transform(rows)
    guess = R.from_log_target("prediction") if task.log else F.col("prediction")
    score = _positive() if task.kind == "binary" else F.lit(None).cast("double")
    return out.select(F.lit(task.name).alias("task"), F.lit(name).alias("model"), F.lit(task.kind).alias("kind"), "split", "label",
                      guess.alias("prediction"), score.alias("score"))


def predictions_by_model(
    data: DataFrame, tasks: Sequence[Task] = TASKS, sizes: ModelSizes = ModelSizes(), seed: int = 42, test: str = "test",
    key: str = "user_id", train_rows: int | None = None,
) -> tuple[list[DataFrame], list[tuple]]:
    """``baseline_predictions`` with the rows of each model apart.

    Every task of a stage gets a copy of each model that the stage applies, so rows are scored in few partitions.
    """
    here = [t for t in tasks if t.target in data.columns]
    size = _sizes(data, here)
    skipped = [(t.name, "skipped", "no target", 0.0) for t in tasks if t not in here]
    parts, fits = [], []
    for task in here:
        why = _unfit(task, size[task.name], test)
        n = size[task.name]["train"]["n"] if "train" in size[task.name] else 0
        if why:
            skipped.append((task.name, "skipped", why, float(n)))
            continue
        rows = data.withColumn("label", _label(task)).where("label IS NOT NULL")
        train = rows.where("split = 'train'")
        if train_rows is not None and n > train_rows:
            train = train.where(unit_hash(seed + 1, key) < train_rows / n)
            n = train_rows
        if task.log:
            train = train.withColumn("label", R.to_log_target("label"))
        held = rows.where("split <> 'train'").coalesce(_parts(sum(r["n"] for s, r in size[task.name].items() if s != "train")))
        for name, model in _estimators(task, sizes, n, seed).items():
            parts.append((task, name, held))
            fits.append(lambda model=model, train=training_rows(model, train, n): model.fit(train))
    fitted = side_by_side(data, fits)
    return [_predicted(t, name, m, rows) for (t, name, rows), m in zip(parts, fitted, strict=True)], skipped


def baseline_predictions(
    data: DataFrame, tasks: Sequence[Task] = TASKS, sizes: ModelSizes = ModelSizes(), seed: int = 42, test: str = "test",
    key: str = "user_id", train_rows: int | None = None,
) -> tuple[DataFrame | None, list[tuple]]:
    """What every model of every task predicts for each row outside of ``train``, and the tasks that are not trained.

    Rows: task, model, kind, split, label, prediction, and the score of the positive class of binary
    tasks. Every labelled training row of a task trains and every row of the other splits is predicted. Only
    a caller that asks for it with ``train_rows`` trains on about that many, taken by a hash of the key.
    """
    parts, skipped = predictions_by_model(data, tasks, sizes, seed, test, key, train_rows)
    return (_union(parts) if parts else None), skipped


def _scored(parts: Sequence[DataFrame]) -> DataFrame:
    """The predictions of all models as one stored table; each model is applied by a run of its own."""
    spark = parts[0].sparkSession
    tables = side_by_side(parts[0], [lambda part=p: stored(part) for p in parts])
    return spark.read.schema(parts[0].schema).parquet(*[f for t in tables for f in t.inputFiles()])


def baseline_scores(pred: DataFrame, test: str = "test") -> DataFrame:
    """Metrics of stored predictions by task and model; ``val_`` ones from the split ``val``, if another is the test."""
    by = ("task", "model")
    held, val = pred.where(F.col("split") == test), pred.where("split = 'val'")
    kinds = {r["kind"] for r in pred.select("kind").distinct().collect()}  # at most three
    out = []
    if "binary" in kinds:
        out.append(_long(M.classification_metrics(held.where("kind = 'binary'"), keys=by), BINARY_METRICS))
        if test != "val":
            out.append(_long(M.auc_and_ap(val.where("kind = 'binary'"), keys=by), ["auc_roc"], "val_"))
    if "multiclass" in kinds:
        out.append(_long(M.multiclass_metrics(held.where("kind = 'multiclass'"), keys=by), MULTICLASS_METRICS))
    if "regression" in kinds:
        out.append(_long(M.regression_metrics(held.where("kind = 'regression'"), keys=by), REGRESSION_METRICS))
        if test != "val":
            out.append(_long(M.regression_metrics(val.where("kind = 'regression'"), keys=by), ["r2"], "val_"))
    return _union(out)


def train_baselines(
    data: DataFrame, tasks: Sequence[Task] = TASKS, sizes: ModelSizes = ModelSizes(), seed: int = 42, test: str = "test",
    key: str = "user_id", train_rows: int | None = None,
) -> DataFrame:
    """Every model on every task, scored on the split ``test``.

    A task without its target, without two classes or with too few rows is not trained: it gives one
    row with the model ``skipped``, the reason as metric and the number of training rows as value.
    """
    parts, skipped = predictions_by_model(settled(data), tasks, sizes, seed, test, key, train_rows)
    out = [baseline_scores(_scored(parts), test)] if parts else []
    if skipped or not out:
        out.append(data.sparkSession.createDataFrame(skipped, "task string, model string, metric string, value double"))
    return _union(out)


# ---------------------------------------------------------------- probes


def _scaled(df: DataFrame, vector: str) -> DataFrame:
    raw = df.withColumn("__raw", array_to_vector(F.transform(vector, lambda x: x.cast("double"))))
    fitted = StandardScaler(inputCol="__raw", outputCol="features", withMean=True).fit(raw.where("split = 'train'"))
    return fitted.transform(raw).drop("__raw")


def linear_probe(vectors: DataFrame, key: str, vector: str, label: str, task: str, seed: int = 42, max_iter: int = 100) -> DataFrame:
    """Logistic regression on scaled vectors: weighted scores, and AUC for two classes."""
    split = stratified_split(vectors, label, key, seed=seed).withColumn("label", F.col(label).cast("double"))
    data = settled(_scaled(split, vector))
    pred = LogisticRegression(maxIter=max_iter).fit(data.where("split = 'train'")).transform(data.where("split = 'test'"))
    pred = settled(pred.select("label", "prediction", vector_to_array("probability").alias("p")))
    multi = M.multiclass_metrics(pred)
    out = [_rows(multi, task, "linear_probe", ("accuracy", "precision_weighted", "recall_weighted", "f1_weighted"))]
    if vectors.select(label).distinct().limit(3).count() == 2:
        out.append(_rows(M.auc_and_ap(pred.withColumn("score", F.element_at("p", 2))), task, "linear_probe", ["auc_roc"]))
    return _union(out)


def _probe_votes(found: DataFrame, truth: DataFrame, ks: Sequence[int], task: str, name: str) -> DataFrame:
    out = []
    for k in ks:
        votes = found.where(F.col("place") <= k).groupBy("query", "carry").agg(F.count(F.lit(1)).alias("n"))
        # a tie goes to the smallest label
        winner = votes.groupBy("query").agg(F.min_by("carry", F.struct(-F.col("n"), F.col("carry"))).alias("prediction"))
        scores = M.multiclass_metrics(truth.join(winner, "query"))
        out.append(_rows(scores, task, f"{name}_k={k}", ("accuracy", "f1_weighted")))
    return _union(out)


def _probe_sides(vectors: DataFrame, key: str, vector: str, label: str, seed: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    split = stratified_split(vectors, label, key, seed=seed)
    data = settled(_scaled(split, vector).select(key, label, "split", vector_to_array("features").alias("v")))
    test = data.where("split = 'test'")
    return test, data.where("split = 'train'"), test.select(F.col(key).alias("query"), F.col(label).alias("label"))


def knn_probe(vectors: DataFrame, key: str, vector: str, label: str, task: str, ks: Sequence[int] = (1, 3, 5, 10), seed: int = 42) -> DataFrame:
    """Majority of the k nearest train rows, for several k from one neighbour search that compares all."""
    test, train, truth = _probe_sides(vectors, key, vector, label, seed)
    found = settled(nearest(test, train, key, "v", label, max(ks)))
    return _probe_votes(found, truth, ks, task, "knn")


def hashed_knn_probe(vectors: DataFrame, key: str, vector: str, label: str, task: str, ks: Sequence[int] = (1, 3, 5, 10),
                     seed: int = 42) -> DataFrame:
    """The same from hashed neighbours, for tables whose pairs are too many to compare."""
    test, train, truth = _probe_sides(vectors, key, vector, label, seed)
    index = fit(test, train, key, "v", max(ks), seed=seed)
    found = settled(hashed_nearest(test, train, key, "v", label, max(ks), index))
    return _probe_votes(found, truth, ks, task, "hashed_knn")


def regression_probe(vectors: DataFrame, key: str, vector: str, target: str, task: str, seed: int = 42) -> DataFrame:
    """Ridge regression on scaled vectors: errors and rank correlations of its predictions."""
    hashed = vectors.withColumn("split", F.when(unit_hash(seed, key) < 0.2, "test").otherwise("train"))
    data = settled(_scaled(hashed.withColumn("label", F.col(target).cast("double")), vector))
    train = data.where("split = 'train'")
    pred = ridge(train.count()).fit(train).transform(data.where("split = 'test'"))
    pred = settled(pred.select("label", "prediction"))
    ranks = M.spearman(pred, "label", "prediction").withColumn("kendall", M.kendall(pred, "label", "prediction").scalar())
    return _union([
        _rows(M.regression_metrics(pred), task, "linear_probe", REGRESSION_METRICS),
        _rows(ranks, task, "linear_probe", ("spearman", "kendall")),
    ])


def cross_validated(vectors: DataFrame, key: str, vector: str, label: str, task: str, kind: str = "classification",
                    folds: int = 5, seed: int = 42, max_iter: int = 100) -> DataFrame:
    """Mean and spread of accuracy (or R squared) over folds with equal class shares."""
    if kind == "classification":
        placed = stratified_folds(vectors, label, key, folds, seed)
        model, metric = LogisticRegression(maxIter=max_iter), MulticlassClassificationEvaluator(metricName="accuracy")
    else:
        placed = vectors.withColumn("fold", F.floor(unit_hash(seed, key) * folds).cast("int"))
        model, metric = ridge(placed.count() * (folds - 1) // folds), RegressionEvaluator(metricName="r2")
    data = settled(placed.select("fold", F.col(label).cast("double").alias("label"),
                                 array_to_vector(F.transform(vector, lambda x: x.cast("double"))).alias("features")))
    cv = CrossValidator(estimator=model, estimatorParamMaps=ParamGridBuilder().build(), evaluator=metric, numFolds=folds, foldCol="fold")
    fitted = cv.fit(data)
    name = "accuracy" if kind == "classification" else "r2"
    rows = [(task, "cross_validation", f"mean_{name}", float(fitted.avgMetrics[0])),
            (task, "cross_validation", f"std_{name}", float(fitted.stdMetrics[0]))]
    return vectors.sparkSession.createDataFrame(rows, "task string, model string, metric string, value double")


def _halves(data: DataFrame, key: str, label: str, kind: str, seed: int, log: bool = False) -> DataFrame:
    """A train and a test split with equal class shares, or by hash alone where the label is a quantity."""
    value = F.col(label).cast("double")
    if kind == "binary":
        return stratified_split(data, label, key, seed=seed).withColumn("label", value)
    split = F.when(unit_hash(seed, key) < 0.2, "test").otherwise("train")
    return data.where(value.isNotNull()).withColumn("split", split).withColumn("label", R.to_log_target(value) if log else value)


def _linear(kind: str, max_iter: int, n_train: int):
    return LogisticRegression(maxIter=max_iter) if kind == "binary" else ridge(n_train)


def _compared(kind: str, task: str, models: dict, metrics: Sequence[str], against: Sequence[tuple[str, str]]) -> DataFrame:
    """Scores of fitted models on the test rows, and by how much the first of two models is ahead of the second."""
    t = Task(task, "label", kind)
    pred = settled(_union([_predicted(t, name, m, rows.where("split = 'test'")) for name, (m, rows) in models.items()]))
    scores = M.classification_metrics if kind == "binary" else M.regression_metrics
    rows = settled(_long(scores(pred, keys=("task", "model")), metrics))
    lead = "auc_roc" if kind == "binary" else "r2"

    def value(model: str) -> Column:
        return rows.where((F.col("model") == model) & (F.col("metric") == lead)).agg(F.max("value")).scalar()

    gaps = [(a, b, value(a) - value(b)) for a, b in against]
    cells = [F.struct(F.lit(task).alias("task"), F.lit(f"{a}_vs_{b}").alias("model"), F.lit(f"{lead}_diff").alias("metric"), d.alias("value"))
             for a, b, d in gaps]
    return rows.unionByName(rows.sparkSession.range(1).select(F.inline(F.array(*cells)))) if cells else rows


def compare_feature_sets(
    data: DataFrame, key: str, sets: dict[str, str], raw: str, label: str, task: str, sizes: ModelSizes = ModelSizes(),
    seed: int = 42, kind: str = "binary", log: bool = False,
) -> DataFrame:
    """A linear model on each vector column and tree models on the raw one, on one shared split.

    Vectors of noise come in as one more set, as a floor every useful set must clear. The first set is
    then set against the tree models and the other sets: rows ``a_vs_b`` hold the difference of the area
    under the curve, or of R squared for a quantity (``kind="regression"``; with ``log`` on its logarithm).
    """
    split = settled(_halves(data, key, label, kind, seed, log))
    n = split.where("split = 'train'").count()
    held, fits = {}, []
    for name, column in sets.items():
        held[f"{name}_linear"] = settled(_scaled(split, column).select("split", "label", "features"))
        fits.append((f"{name}_linear", _linear(kind, sizes.max_iter, n)))
    trees = settled(split.select("split", "label", array_to_vector(F.transform(raw, lambda x: x.cast("double"))).alias("features")))
    for name, model in list((classifiers(sizes, seed) if kind == "binary" else regressors(sizes, n, seed)).items())[1:]:
        held[f"{name}_raw"] = trees
        fits.append((f"{name}_raw", model))
    fitted = side_by_side(split, [lambda name=name, m=m: m.fit(training_rows(m, held[name].where("split = 'train'"), n)) for name, m in fits])
    models = {name: (m, held[name]) for (name, _), m in zip(fits, fitted, strict=True)}
    first, *others = models
    metrics = BINARY_METRICS if kind == "binary" else REGRESSION_METRICS
    return _compared(kind, task, models, metrics, [(first, o) for o in others])


def noise_like(vector: str, key: str, seed: int = 42) -> Column:
    """A reproducible vector of noise per row, as wide as another one."""
    return F.transform(vector, lambda _, i: unit_hash(seed, F.col(key), i.cast("string")) - 0.5)


def group_ablation(
    data: DataFrame, key: str, groups: dict[str, Sequence[str]], label: str, task: str, seed: int = 42, max_iter: int = 1000,
    kind: str = "binary",
) -> DataFrame:
    """A linear model of all features and of each group alone, and what a group lacks compared with all.

    Binary labels: accuracy, F1 and area under the curve; quantities (``kind="regression"``): errors and R
    squared of ridge regression. Rows ``full_vs_<group>`` hold the difference of the area or of R squared.
    """
    everything = [c for g in groups.values() for c in g]
    columns = {"full": everything, **groups}
    vectors = {f"__v_{n}": F.array(*[R.sanitised(c) for c in cs]) for n, cs in columns.items()}
    split = settled(_halves(data.withColumns(vectors), key, label, kind, seed).select("split", "label", *vectors))
    n = split.where("split = 'train'").count()
    held = {name: settled(_scaled(split, f"__v_{name}").select("split", "label", "features")) for name in columns}
    model = _linear(kind, max_iter, n)
    fitted = side_by_side(split, [lambda rows=training_rows(model, rows.where("split = 'train'"), n): model.fit(rows) for rows in held.values()])
    models = {name: (m, held[name]) for name, m in zip(held, fitted, strict=True)}
    metrics = ("accuracy", "f1", "auc_roc") if kind == "binary" else ("rmse", "mae", "r2")
    return _compared(kind, task, models, metrics, [("full", g) for g in groups])
