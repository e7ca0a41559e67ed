"""Exact model metrics from prediction tables, for any number of groups at once.

Scores are merged to distinct values first; ranks and running counts come from value ranges, so
neither a large group nor heavy ties meet in one task.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clientele.functions.hashing import PRIME, replicate_seeds
from clientele.operators.ordering import PIECE_ROWS, join_keys, running_totals
from clientele.operators.pairs import concordance


def _score_counts(pred: DataFrame, label: str, score: str, keys: Sequence[str]) -> DataFrame:
    return pred.groupBy(*keys, F.col(score).cast("double").alias("__s")).agg(
        F.count_if(F.col(label) == 1).cast("double").alias("__pos"),
        F.count_if(F.col(label) != 1).cast("double").alias("__neg"),
    )


def auc_and_ap(pred: DataFrame, label: str = "label", score: str = "score", keys: Sequence[str] = ()) -> DataFrame:
    """Area under the ROC curve with ties shared evenly (0.5 with one class) and average precision (0 without positives)."""
    keyed = pred if keys else pred.withColumn("__all", F.lit(1))
    by = list(keys) or ["__all"]
    counts = _score_counts(keyed, label, score, by)
    ranked = running_totals(counts, "__s", {"__pos": "p", "__neg": "n"}, by)
    wins = F.sum(F.col("__pos") * (F.col("n_before") + F.col("__neg") / 2))
    pos_at, neg_at = F.col("p_total") - F.col("p_before"), F.col("n_total") - F.col("n_before")
    precision = F.sum(F.col("__pos") * pos_at / (pos_at + neg_at))
    out = ranked.groupBy(*by).agg(
        wins.alias("__w"), precision.alias("__a"), F.sum("__pos").alias("__p"), F.sum("__neg").alias("__n")
    )
    pairs = F.col("__p") * F.col("__n")
    return out.select(
        *by,
        F.when(pairs > 0, F.col("__w") / pairs).otherwise(0.5).alias("auc_roc"),
        F.when(F.col("__p") > 0, F.col("__a") / F.col("__p")).otherwise(0.0).alias("avg_precision"),
    ).drop(*([] if keys else ["__all"]))


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def confusion(pred: DataFrame, label: str = "label", score: str = "score", keys: Sequence[str] = (), threshold: float = 0.5) -> DataFrame:
    hit, real = F.col(score) >= threshold, F.col(label) == 1
    return pred.groupBy(*keys).agg(
        F.count_if(hit & real).alias("tp"),
        F.count_if(hit & ~real).alias("fp"),
        F.count_if(~hit & real).alias("fn"),
        F.count_if(~hit & ~real).alias("tn"),
    )


def classification_metrics(
    pred: DataFrame, label: str = "label", score: str = "score", keys: Sequence[str] = (), threshold: float = 0.5
) -> DataFrame:
    """AUC, average precision, F1, precision, recall, accuracy and the confusion counts per group."""
    keyed = pred if keys else pred.withColumn("__all", F.lit(1))
    by = list(keys) or ["__all"]
    cm = confusion(keyed, label, score, by, threshold)
    curve = auc_and_ap(keyed, label, score, by)
    tp, fp, fn, tn = (F.col(c).cast("double") for c in ("tp", "fp", "fn", "tn"))
    out = join_keys(cm, curve, by).withColumns({
        "precision": _ratio(tp, tp + fp), "recall": _ratio(tp, tp + fn), "f1": _ratio(2 * tp, 2 * tp + fp + fn),
        "accuracy": _ratio(tp + tn, tp + fp + fn + tn),
    })
    return out if keys else out.drop("__all")


def regression_metrics(pred: DataFrame, label: str = "label", prediction: str = "prediction", keys: Sequence[str] = ()) -> DataFrame:
    """Root mean squared error, mean absolute error and R squared per group."""
    y, e = F.col(label).cast("double"), F.col(label).cast("double") - F.col(prediction)
    spread = F.var_pop(y) * F.count(y)
    wrong = F.sum(e * e)
    r2 = F.when(spread > 0, 1 - wrong / spread).when(wrong == 0, 1.0).otherwise(0.0)
    return pred.groupBy(*keys).agg(
        F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"), r2.alias("r2"), F.avg(y).alias("target_mean"),
        F.count(F.lit(1)).alias("n_valid"),
    )


def multiclass_metrics(pred: DataFrame, label: str = "label", prediction: str = "prediction", keys: Sequence[str] = ()) -> DataFrame:
    """Accuracy and macro and weighted precision, recall and F1. Each row is counted for its true and its predicted class."""
    keyed = pred if keys else pred.withColumn("__all", F.lit(1))
    by = list(keys) or ["__all"]
    truth, guess = F.col(label).cast("string"), F.col(prediction).cast("string")
    sides = keyed.select(*by, (truth == guess).alias("__hit"), F.explode(
        F.array(F.struct(truth.alias("c"), F.lit(1).alias("t")), F.struct(guess.alias("c"), F.lit(0).alias("t")))).alias("__s"))
    per_class = sides.groupBy(*by, F.col("__s.c").alias("c")).agg(
        F.sum("__s.t").alias("support"),
        F.sum(1 - F.col("__s.t")).alias("guessed"),
        F.count_if(F.col("__hit") & (F.col("__s.t") == 1)).alias("hits"),
    )
    precision, recall = _ratio(F.col("hits"), F.col("guessed")), _ratio(F.col("hits"), F.col("support"))
    f1 = _ratio(2 * F.col("hits"), F.col("guessed") + F.col("support"))
    n = F.sum("support")
    out = per_class.groupBy(*by).agg(
        (F.sum("hits") / n).alias("accuracy"),
        F.avg(f1).alias("f1_macro"),
        (F.sum(f1 * F.col("support")) / n).alias("f1_weighted"),
        (F.sum(precision * F.col("support")) / n).alias("precision_weighted"),
        (F.sum(recall * F.col("support")) / n).alias("recall_weighted"),
        n.alias("n_valid"),
    )
    return out if keys else out.drop("__all")


def ranking_metrics(ranked: DataFrame, query: str = "user_id", relevant: str = "relevant", rank: str = "rank", k: int = 10) -> DataFrame:
    """NDCG@k and hit rate@k, averaged over queries. ``ranked`` holds every relevant row and at least the first k rows."""
    gain = F.when((F.col(rank) <= k) & (F.col(relevant) == 1), 1 / F.log2(F.col(rank) + 1.0)).otherwise(0.0)
    per_query = ranked.groupBy(query).agg(
        F.sum(gain).alias("dcg"),
        F.sum((F.col(relevant) == 1).cast("int")).alias("n"),
        F.max(((F.col(rank) <= k) & (F.col(relevant) == 1)).cast("int")).alias("hit"),
    )
    ideal = F.aggregate(F.sequence(F.lit(1), F.greatest(F.least(F.col("n"), F.lit(k)), F.lit(1)).cast("int")), F.lit(0.0),
                        lambda acc, i: acc + 1 / F.log2(i + 1.0))
    ndcg = F.when(F.col("n") > 0, F.col("dcg") / ideal).otherwise(0.0)
    return per_query.agg(F.avg(ndcg).alias(f"ndcg_at_{k}"), F.avg("hit").alias(f"hit_rate_at_{k}"), F.count(F.lit(1)).alias("queries"))


# ---------------------------------------------------------------- comparisons


def compare(model: DataFrame, baselines: DataFrame) -> DataFrame:
    """Model against each baseline: both are ``(task[, model], metric, value)`` rows of the primary metric."""
    mine = model.select("task", "metric", F.col("value").alias("model_score"))
    diff = F.col("model_score") - F.col("baseline_score")
    relative = F.when(F.col("baseline_score") != 0, diff / F.abs(F.col("baseline_score")) * 100).otherwise(0.0)
    return baselines.withColumnRenamed("value", "baseline_score").join(mine, ["task", "metric"]).select(
        "task", "metric", F.col("model").alias("baseline"), "model_score", "baseline_score",
        F.round(diff, 4).alias("absolute_diff"), F.round(relative, 2).alias("relative_pct"), (diff > 0).alias("wins"),
    )


# Metrics where a smaller number is better.
LOWER_IS_BETTER = ("rmse", "mae")


def best_models(results: DataFrame) -> DataFrame:
    """Best model per task and metric, by the metric's direction; ties go to the first name."""
    signed = F.when(F.col("metric").isin(*LOWER_IS_BETTER), -F.col("value")).otherwise(F.col("value"))
    best = F.min_by(F.struct("model", "value"), F.struct((-signed).alias("s"), F.col("model")))
    return results.where(F.col("value").isNotNull()).groupBy("task", "metric").agg(best.alias("b")).select(
        "task", "metric", F.col("b.model").alias("model"), F.col("b.value").alias("value")
    )


def result_matrix(results: DataFrame, models: Sequence[str], proposed: str, fallback: dict[str, str] | None = None) -> DataFrame:
    """Task by model on the primary metric, with the best model and the lead over the best baseline."""
    wide = results.groupBy("task", "metric").pivot("model", list(models)).agg(F.first("value"))
    for column, other in (fallback or {}).items():
        wide = wide.withColumn(column, F.coalesce(column, other))
    cells = [F.coalesce(F.col(m), F.lit(0.0)) for m in models]
    # the first listed model wins a tie
    best = F.lit(models[0])
    top = cells[0]
    for m, v in list(zip(models, cells, strict=True))[1:]:
        best = F.when(v > top, F.lit(m)).otherwise(best)
        top = F.greatest(top, v)
    base = [c for m, c in zip(models, cells, strict=True) if m != proposed]
    best_base = F.greatest(*base) if len(base) > 1 else base[0]
    return wide.withColumns({"best": best, "delta": F.coalesce(F.col(proposed), F.lit(0.0)) - best_base})


def variant_rows(classified: DataFrame, regressed: DataFrame, variant: str = "variant") -> DataFrame:
    """``(variant, metric, value)`` rows named ``<task>_auc``, ``<task>_r2`` and ``<task>_rmse``."""
    auc = classified.select(variant, F.concat("task", F.lit("_auc")).alias("metric"), F.col("auc_roc").alias("value"))
    cells = [F.struct(F.concat("task", F.lit(f"_{m}")).alias("metric"), F.col(m).alias("value")) for m in ("r2", "rmse")]
    return auc.unionByName(regressed.select(variant, F.inline(F.array(*cells))))


# Grade thresholds; a grade needs every named metric.
GRADES = ("state_of_art", "excellent", "good", "acceptable", "poor")
THRESHOLDS = {
    "churn_prediction": {
        "state_of_art": {"auc_roc": 0.90, "f1": 0.80}, "excellent": {"auc_roc": 0.85, "f1": 0.70},
        "good": {"auc_roc": 0.80, "f1": 0.60}, "acceptable": {"auc_roc": 0.70, "f1": 0.50},
        "poor": {"auc_roc": 0.60, "f1": 0.40},
    },
    "clv_prediction": {
        "state_of_art": {"r2": 0.85, "spearman": 0.90}, "excellent": {"r2": 0.75, "spearman": 0.80},
        "good": {"r2": 0.60, "spearman": 0.70}, "acceptable": {"r2": 0.40, "spearman": 0.50},
        "poor": {"r2": 0.20, "spearman": 0.30},
    },
    "embedding_quality": {
        "excellent": {"isotropy": 0.85, "effective_rank_ratio": 0.75},
        "good": {"isotropy": 0.70, "effective_rank_ratio": 0.60},
        "acceptable": {"isotropy": 0.50, "effective_rank_ratio": 0.40},
        "poor": {"isotropy": 0.30, "effective_rank_ratio": 0.20},
    },
    # one number for all metrics: how far a probe's AUC lies above that of trees on raw features
    "linear_probe_vs_xgboost": {"excellent": 0.05, "good": 0.0, "acceptable": -0.05, "poor": -0.15},
}


def grade(values: dict[str, Column], area: str) -> Column:
    """Best grade whose thresholds are all met. Below all: POOR.

    A named metric that is not given counts as 0. In an area with one number per grade every given
    metric must reach it, and a NULL reaches none.
    """
    out = F.lit("POOR")
    for name in reversed(GRADES):
        limits = THRESHOLDS[area].get(name)
        if limits is None:
            continue
        met = F.lit(True)
        if isinstance(limits, float):
            for value in values.values():
                met = met & F.coalesce(value >= limits, F.lit(False))
        else:
            for metric, limit in limits.items():
                met = met & (F.coalesce(values.get(metric, F.lit(0.0)), F.lit(0.0)) >= limit)
        out = F.when(met, name.upper()).otherwise(out)
    return out


def evaluation_summary(metrics: DataFrame) -> DataFrame:
    """Verdict against the tree model and the sanity margin over random features.

    ``metrics`` has ``embedding_auc``, ``tree_auc`` and ``random_auc``.
    """
    lead = F.col("embedding_auc") - F.col("tree_auc")
    return metrics.withColumns({
        "difference": lead,
        "verdict": F.when(lead > 0, "BETTER").when(lead < 0, "WORSE").otherwise("EQUAL"),
        "improvement_over_random": F.col("embedding_auc") - F.col("random_auc"),
        "sanity_passed": F.col("embedding_auc") > F.col("random_auc") + 0.05,
    })


# ---------------------------------------------------------------- bootstrap

Metric = Callable[[str, str, str], Column]


def weighted_accuracy(label: str, score: str, weight: str) -> Column:
    right = ((F.col(score) >= 0.5).cast("int") == F.col(label)).cast("double")
    return F.sum(right * F.col(weight)) / F.sum(weight)


def weighted_mae_skill(label: str, score: str, weight: str) -> Column:
    """Negative mean absolute error, so that larger is better."""
    return -F.sum(F.abs(F.col(score) - F.col(label)) * F.col(weight)) / F.sum(weight)


def accuracy_state(score: Column) -> Column:
    """What accuracy reads of a score."""
    return (score >= 0.5).cast("double")


def _cell_draws(cells: DataFrame, replicates: int) -> DataFrame:
    """``(cells' columns, __r, __w)``: per cell and replicate one Poisson draw with the cell's count as its mean.

    The draw inverts the distribution, whose table reaches 12 standard deviations to either side: its size
    goes with the root of the count. Uniform numbers follow from the cell's seeds and the replicate.
    """
    kept = [f for f in cells.schema.fields if f.name not in ("__n", "__h1", "__h2")]
    schema = T.StructType([*kept, T.StructField("__r", T.LongType()), T.StructField("__w", T.DoubleType())])
    names = [f.name for f in kept]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        r = np.arange(1, replicates + 1)
        for part in parts:
            for row in part.itertuples(index=False):
                n, h1, h2 = (int(x) for x in row[-3:])
                low, high = poisson_range(n)
                k = np.arange(low, high + 1)
                logs = k * math.log(n) - n - np.array([math.lgamma(x + 1) for x in k])
                u = ((h1 % PRIME + r * (h2 % PRIME) + r * r * ((h1 + h2) % 65_521)) % PRIME) / PRIME
                w = np.searchsorted(np.cumsum(np.exp(logs)), u, side="right") + low
                out = pd.DataFrame({"__r": r, "__w": w.astype(float)})
                for name, value in zip(names, row, strict=False):
                    out[name] = value
                yield out[[*names, "__r", "__w"]]

    return cells.select(*names, "__n", "__h1", "__h2").mapInPandas(run, schema)


def poisson_range(n: int) -> tuple[int, int]:
    """The values that a Poisson draw of mean ``n`` takes but for less than one part in 10^30."""
    wide = 12 * math.isqrt(n) + 30
    return max(0, n - wide), n + wide


def paired_bootstrap(
    pred: DataFrame, label: str, score_a: str, score_b: str, metric: Metric = weighted_accuracy,
    state: Callable[[Column], Column] | None = accuracy_state, replicates: int = 10_000, seed: int = 42,
) -> DataFrame:
    """One-sided p-value, difference and 95 % interval of model A over model B.

    A replicate weighs every row by a Poisson(1) draw, which is resampling with replacement for large
    tables. Rows that the metric cannot tell apart form a cell, and the sum of their draws is one
    Poisson draw with their count as its mean; so the cost is cells x replicates whatever the number of
    rows. ``state`` maps a score to what the metric reads of it (for accuracy, at most eight cells);
    None keeps the scores themselves, with a cell per distinct label and pair of scores.
    """
    of = state or (lambda c: c.cast("double"))
    cells = pred.groupBy(F.col(label).alias(label), of(F.col(score_a)).alias("__a"), of(F.col(score_b)).alias("__b")).agg(F.count(F.lit(1)).alias("__n"))
    h1, h2 = replicate_seeds(seed, *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (label, "__a", "__b")])
    drawn = _cell_draws(cells.withColumns({"__h1": h1, "__h2": h2}).select(label, "__a", "__b", "__n", "__h1", "__h2"), replicates)
    per = drawn.groupBy("__r").agg((metric(label, "__a", "__w") - metric(label, "__b", "__w")).alias("diff"))
    observed = pred.withColumn("__w", F.lit(1.0)).agg(
        metric(label, score_a, "__w").alias("score_a"), metric(label, score_b, "__w").alias("score_b")
    )
    # one difference per replicate: bounded by the number of replicates
    spread = per.agg(
        (F.count_if(F.round("diff", 12) <= 0) / F.count(F.lit(1))).alias("p_value"),
        F.percentile("diff", 0.025).alias("ci_95_lower"),
        F.percentile("diff", 0.975).alias("ci_95_upper"),
    )
    both = spread.withColumn("__o", observed.select(F.struct("score_a", "score_b")).scalar())
    return both.select(
        F.col("__o.score_a").alias("score_a"),
        F.col("__o.score_b").alias("score_b"),
        (F.col("__o.score_a") - F.col("__o.score_b")).alias("observed_diff"),
        "p_value", "ci_95_lower", "ci_95_upper", (F.col("p_value") < 0.05).alias("significant"),
    )


# ---------------------------------------------------------------- correlation


def average_ranks(df: DataFrame, value: str, out: str) -> DataFrame:
    """Rank of each distinct value, ties sharing their mean rank."""
    counts = df.groupBy(F.col(value).alias("__v")).agg(F.count(F.lit(1)).alias("__n"))
    placed = running_totals(counts, "__v", {"__n": "c"})
    ranks = placed.select(F.col("__v").alias(value), (F.col("c_before") + (F.col("__n") + 1) / 2).alias(out))
    return df.join(ranks, value)


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    """Rank correlation with exact average ranks."""
    ranked = average_ranks(average_ranks(df.select(x, y), x, "__rx"), y, "__ry")
    return ranked.agg(F.corr("__rx", "__ry").alias("spearman"))


def kendall(df: DataFrame, x: str, y: str, piece_rows: int = PIECE_ROWS) -> DataFrame:
    """Exact tau-b. Pairs are counted by cells of a grid over both value ranges.

    Pairs in different columns and rows of the grid follow from its cell counts alone; the other
    pairs share a column or a row and are counted there, piece by piece.
    """
    points = df.groupBy(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).agg(F.count(F.lit(1)).alias("w"))
    net = concordance(points, piece_rows)
    tie_x = df.groupBy(x).agg(F.count(F.lit(1)).alias("n")).agg(F.sum(F.col("n") * (F.col("n") - 1) / 2)).scalar()
    tie_y = df.groupBy(y).agg(F.count(F.lit(1)).alias("n")).agg(F.sum(F.col("n") * (F.col("n") - 1) / 2)).scalar()
    n = df.agg(F.count(F.lit(1))).scalar()
    full = net.withColumns({"__tx": tie_x, "__ty": tie_y, "__n": n})
    pairs = F.col("__n") * (F.col("__n") - 1) / 2
    return full.select(
        F.try_divide(F.col("net"), F.sqrt((pairs - F.col("__tx")) * (pairs - F.col("__ty")))).alias("kendall")
    )


def rank_of(scores: DataFrame, query: str, order: Sequence[Column], k: int) -> DataFrame:
    """First k candidates per query with their rank."""
    placed = scores.withColumn("rank", F.row_number().over(W.partitionBy(query).orderBy(*order)))
    return placed.where(F.col("rank") <= k)
