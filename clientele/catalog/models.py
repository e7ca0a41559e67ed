"""Queries of embedding quality, of model baselines and of the streaming forms run on closed input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clientele.catalog import labels, query
from clientele.catalog.commerce import features_and_targets, features_of, targets_of  # noqa: F401  (tests compare with both)
from clientele.catalog.common import comparable, sql_round
from clientele.functions import rules as R
from clientele.operators import embeddings as E
from clientele.operators import leakfree as L
from clientele.operators import models as B
from clientele.operators import neighbours as N
from clientele.operators import splits as P
from clientele.operators.ordering import settled
from clientele.operators.pairs import nearest
from clientele.sources import star

# the full sizes but for the boosting rounds, of which the library's default is 500
SIZES = B.ModelSizes(rounds=100, boost_depth=6, step=0.1)
COMPARED = B.ModelSizes(trees=100, depth=10, leaf_rows=1, rounds=100, boost_depth=6, step=0.1)


def vectors(spark: SparkSession, root: str) -> DataFrame:
    return star.table(spark, root, "embeddings").withColumns(
        {"binary": (F.col("label") < 2).cast("int"), "target": (1 + F.col("vec_id") % 100).cast("double")}
    )


UNIT = """emb AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
nrm AS (SELECT vec_id, label, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS n FROM emb),
unit AS (SELECT vec_id, label, list_transform(v, lambda x: x / (n + 1e-10::DOUBLE)) AS u FROM nrm)"""


@query(
    "embedding_stats",
    f"""WITH {UNIT}, e AS (SELECT unnest(v) AS x FROM emb)
    SELECT {sql_round('avg(x)')} AS mean, {sql_round('stddev_pop(x)')} AS std, {sql_round('min(x)')} AS min, {sql_round('max(x)')} AS max,
      (SELECT {sql_round('avg(n)')} FROM nrm) AS norm_mean, (SELECT {sql_round('stddev_pop(n)')} FROM nrm) AS norm_std,
      CAST((SELECT max(len(v)) FROM emb) AS BIGINT) AS dimension, (SELECT count(*) FROM emb) AS num_samples FROM e""",
)
def embedding_stats(spark: SparkSession, root: str) -> DataFrame:
    return comparable(E.basic_stats(vectors(spark, root)))


@query("embedding_isotropy")
def embedding_isotropy(spark: SparkSession, root: str) -> DataFrame:
    return E.isotropy(vectors(spark, root))


@query("embedding_rank")
def embedding_rank(spark: SparkSession, root: str) -> DataFrame:
    return E.effective_rank(vectors(spark, root))


HASH = "CAST(('0x' || substr(md5('42|' || vec_id), 1, 8)) AS BIGINT)"


@query(
    "embedding_uniformity",
    f"""WITH {UNIT}, s AS (SELECT vec_id, u, floor({HASH} / 4294967296.0::DOUBLE * greatest(1, (SELECT count(*) FROM unit) // 5000)) AS cell FROM unit),
    p AS (SELECT CASE WHEN a.vec_id = b.vec_id THEN 0 ELSE greatest(list_sum(list_transform(list_zip(a.u, b.u), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), 0) END AS d FROM s a JOIN s b USING (cell))
    SELECT {sql_round('ln(avg(exp(-2 * d)))')} AS uniformity_loss, {sql_round('avg(sqrt(d))')} AS avg_pairwise_distance FROM p""",
)
def embedding_uniformity(spark: SparkSession, root: str) -> DataFrame:
    return comparable(E.uniformity(vectors(spark, root), "vec_id"))


@query(
    "embedding_alignment",
    f"""WITH {UNIT}, p AS (SELECT a.label AS la, b.label AS lb, sqrt(list_sum(list_transform(list_zip(a.u, b.u), lambda z: (z[1] - z[2]) * (z[1] - z[2])))) AS d
        FROM unit a JOIN unit b ON a.vec_id <> b.vec_id),
    c AS (SELECT la, avg(d) FILTER (WHERE la = lb) AS intra, avg(d) FILTER (WHERE la <> lb) AS inter FROM p GROUP BY 1)
    SELECT {sql_round('avg(intra)')} AS avg_intra_class_distance, {sql_round('avg(inter) FILTER (WHERE intra IS NOT NULL)')} AS avg_inter_class_distance,
      {sql_round('avg(inter) FILTER (WHERE intra IS NOT NULL) / (avg(intra) + 1e-10)')} AS separation_ratio FROM c""",
)
def embedding_alignment(spark: SparkSession, root: str) -> DataFrame:
    return comparable(E.alignment(vectors(spark, root), "vec_id", "label"))


@query(
    "cluster_scores",
    f"""WITH {UNIT}, x AS (SELECT vec_id, label, unnest(v) AS x, unnest(range(1, len(v) + 1)) AS j FROM emb),
    m AS (SELECT label, j, avg(x) AS m FROM x GROUP BY 1, 2), g AS (SELECT j, avg(x) AS g FROM x GROUP BY 1),
    d AS (SELECT vec_id, x.label, sum((x - m) * (x - m)) AS d2 FROM x JOIN m ON m.label = x.label AND m.j = x.j GROUP BY 1, 2),
    s AS (SELECT label, count(*) AS n, sum(d2) AS w, avg(sqrt(d2)) AS sc FROM d GROUP BY 1),
    b AS (SELECT label, sum((m - g) * (m - g)) AS b FROM m JOIN g USING (j) GROUP BY 1),
    dist AS (SELECT p.label AS a, q.label AS b, sqrt(sum((p.m - q.m) * (p.m - q.m))) AS d FROM m p JOIN m q ON p.j = q.j AND p.label <> q.label GROUP BY 1, 2),
    r AS (SELECT a, max((sa.sc + sb.sc) / d) AS r FROM dist JOIN s sa ON sa.label = a JOIN s sb ON sb.label = dist.b GROUP BY 1)
    SELECT count(*) AS k, {sql_round('sum(w)', 3)} AS inertia, {sql_round('sum(n * b) / (count(*) - 1) / (sum(w) / (sum(n) - count(*)))', 3)} AS calinski_harabasz,
      (SELECT {sql_round('avg(r)', 3)} FROM r) AS davies_bouldin FROM s JOIN b USING (label)""",
)
def cluster_scores(spark: SparkSession, root: str) -> DataFrame:
    """Cluster scores of the given labels, so that they compare; the sweep below clusters itself."""
    given = vectors(spark, root).select(F.col("label").alias("cluster"), F.col("embedding").cast("array<double>").alias("v"))
    return comparable(E.cluster_scores(given, "v"), 3)


@query(
    "label_silhouette",
    f"""WITH {UNIT}, x AS (SELECT vec_id, label, unnest(v) AS x, unnest(range(1, len(v) + 1)) AS j FROM emb),
    m AS (SELECT label, j, avg(x) AS m, count(*) AS n FROM x GROUP BY 1, 2),
    q AS (SELECT label, sum(x * x) / count(DISTINCT vec_id) AS q FROM x GROUP BY 1), own AS (SELECT vec_id, label, sum(x * x) AS s FROM x GROUP BY 1, 2),
    dot AS (SELECT vec_id, m.label AS other, any_value(n) AS n, sum(x * m) AS d FROM x JOIN m USING (j) GROUP BY 1, 2),
    away AS (SELECT vec_id, own.label, other, n, s + q - 2 * d AS a FROM dot JOIN own USING (vec_id) JOIN q ON q.label = other),
    io AS (SELECT vec_id, max(CASE WHEN label = other THEN n END) AS n, max(CASE WHEN label = other THEN a * n / greatest(n - 1, 1) END) AS i,
      min(CASE WHEN label <> other THEN a END) AS o FROM away GROUP BY 1)
    SELECT {sql_round('avg(CASE WHEN n > 1 THEN (o - i) / greatest(o, i) ELSE 0 END)')} AS silhouette FROM io""",
)
def label_silhouette(spark: SparkSession, root: str) -> DataFrame:
    """Silhouette of the given labels, from sums per label."""
    return comparable(E.silhouette(vectors(spark, root), "embedding", "label"))


@query("cluster_sweep")
def cluster_sweep(spark: SparkSession, root: str) -> DataFrame:
    return E.cluster_sweep(vectors(spark, root))


def model_data(spark: SparkSession, root: str) -> DataFrame:
    """Every feature column, scaled on the training split, with all targets."""
    _, _, feats, targets = features_and_targets(spark, root)
    frame, names = B.model_frame(feats, targets, P.hash_split(feats.select("user_id")))
    return B.prepared(settled(frame), names)


@query("baseline_models")
def baseline_models(spark: SparkSession, root: str) -> DataFrame:
    """Every model on all six tasks."""
    return B.train_baselines(model_data(spark, root), B.TASKS, SIZES)


@query("segment_models")
def segment_models(spark: SparkSession, root: str) -> DataFrame:
    """A task with several classes: the nation's last digit from the features."""
    digit = star.table(spark, root, "customer").select(
        F.col("c_custkey").cast("string").alias("user_id"), (F.col("c_nationkey") % 5).alias("segment_id")
    )
    data = model_data(spark, root).join(digit, "user_id")
    return B.train_baselines(data, [B.Task("segment", "segment_id", "multiclass")], SIZES)


CUTOFF_TASKS = (
    B.Task("churn", "churn", "binary", valid="churn_valid"),
    B.Task("category", "category", "multiclass", valid="category_valid"),
    B.Task("clv", "clv", "regression", valid="clv_valid", log=True),
)


@query("cutoff_models")
def cutoff_models(spark: SparkSession, root: str) -> DataFrame:
    """Churn, next category and value after the cutoff from what was known before it; only valid labels count."""
    t = labels.tables(spark, root)
    known, labelled = labels.features_of(t), labels.labels_of(t)
    split = P.hash_split(labelled.select(L.WHO), L.WHO, names=("train", "val"), ratios=(0.8, 0.2))
    frame, names = B.model_frame(known, labelled, split, L.WHO)
    return B.train_baselines(B.prepared(settled(frame), names), CUTOFF_TASKS, SIZES, test="val", key=L.WHO)


@query("linear_probe")
def linear_probe(spark: SparkSession, root: str) -> DataFrame:
    v = vectors(spark, root)
    return B.linear_probe(v, "vec_id", "embedding", "binary", "binary").unionByName(
        B.regression_probe(v, "vec_id", "embedding", "target", "target")
    )


@query("knn_probe")
def knn_probe(spark: SparkSession, root: str) -> DataFrame:
    return B.knn_probe(vectors(spark, root), "vec_id", "embedding", "label", "label")


@query("hashed_knn_probe")
def hashed_knn_probe(spark: SparkSession, root: str) -> DataFrame:
    return B.hashed_knn_probe(vectors(spark, root), "vec_id", "embedding", "label", "label")


NEAREST = 10


@query(
    "neighbour_recall",
    """WITH n AS (SELECT count(*) FILTER (vec_id % 100 = 0) AS q, count(*) FILTER (vec_id % 100 <> 0) AS b FROM embeddings)
    SELECT q AS queries, q * least(b, 10) AS neighbours, true AS reached FROM n""",
)
def neighbour_recall(spark: SparkSession, root: str) -> DataFrame:
    """Whether the hashed neighbours of the rows with an id divisible by 100, among all others, hold nine tenths of
    those that comparing all finds. The comparison is what makes this quadratic, so it has that stated query set."""
    rows = settled(vectors(spark, root).select("vec_id", F.col("embedding").cast("array<double>").alias("v"), "label"))
    asked, base = rows.where("vec_id % 100 = 0"), rows.where("vec_id % 100 <> 0")
    index = N.fit(asked, base, "vec_id", "v", NEAREST)
    found = N.hashed_nearest(asked, base, "vec_id", "v", "label", NEAREST, index)
    one = N.recall(found, nearest(asked, base, "vec_id", "v", "label", NEAREST))
    return one.select("queries", "neighbours", (F.col("recall") >= 0.9).alias("reached"))


@query("cross_validation")
def cross_validation(spark: SparkSession, root: str) -> DataFrame:
    return B.cross_validated(vectors(spark, root), "vec_id", "embedding", "binary", "binary")


@query("feature_set_comparison")
def feature_set_comparison(spark: SparkSession, root: str) -> DataFrame:
    v = vectors(spark, root).withColumns({"noise": B.noise_like("embedding", "vec_id"), "raw": F.col("embedding")})
    return B.compare_feature_sets(v, "vec_id", {"embedding": "embedding", "random": "noise"}, "raw", "binary", "binary", COMPARED)


# the numeric feature columns by what they tell of
GROUPS = {
    "money": ["monetary", "avg_order_value", "max_order_value", "min_order_value", "std_order_value", "avg_item_price",
              "total_freight", "avg_freight", "freight_ratio", "freight_pct"],
    "activity": ["tenure_days", "recency_days", "frequency", "total_items", "n_unique_products", "n_unique_sellers",
                 "n_unique_categories", "total_journey_events", "n_order_sessions"],
    "delivery": ["avg_delivery_days", "max_delivery_days", "n_late_deliveries", "avg_delivery_delta"],
    "reviews": ["avg_review_score", "min_review_score", "max_review_score", "n_reviews"],
    "payment": ["avg_installments", "max_installments", "n_payment_types", "uses_credit_card", "uses_boleto"],
}


@query("feature_group_ablation")
def feature_group_ablation(spark: SparkSession, root: str) -> DataFrame:
    _, _, feats, targets = features_and_targets(spark, root)
    data = feats.select("user_id", *[c for g in GROUPS.values() for c in g])
    data = data.join(targets.select("user_id", "early_adopter"), "user_id")
    return B.group_ablation(data, "user_id", GROUPS, "early_adopter", "early_adopter")


# features up to the cutoff: those above cover all orders and so hold the value that is asked for
GATED_GROUPS = {"money": ["monetary", "avg_order_value"], "activity": ["frequency", "n_items"], "time": ["recency_days", "tenure_days"]}


def later_value(spark: SparkSession, root: str) -> DataFrame:
    """Features up to the cutoff and the value after it, of customers whose value counts."""
    t = labels.tables(spark, root)
    later = labels.labels_of(t).where("clv_valid").select(L.WHO, "clv")
    return labels.features_of(t).join(later, L.WHO)


@query("value_set_comparison")
def value_set_comparison(spark: SparkSession, root: str) -> DataFrame:
    """Value after the cutoff, on its logarithm, from the vector with the customer's number, from noise and from features."""
    raw = F.array(*[R.sanitised(c) for g in GATED_GROUPS.values() for c in g])
    vector = star.table(spark, root, "embeddings").where("embedding IS NOT NULL").select(F.col("vec_id").cast("string").alias(L.WHO), "embedding")
    known = later_value(spark, root).withColumn("raw", raw).join(vector, L.WHO)
    known = known.withColumn("noise", B.noise_like("embedding", L.WHO))
    sets = {"embedding": "embedding", "random": "noise"}
    return B.compare_feature_sets(known, L.WHO, sets, "raw", "clv", "clv", COMPARED, kind="regression", log=True)


@query("value_group_ablation")
def value_group_ablation(spark: SparkSession, root: str) -> DataFrame:
    """What each group of features tells of a customer's value after the cutoff."""
    return B.group_ablation(later_value(spark, root), L.WHO, GATED_GROUPS, "clv", "clv", kind="regression")
