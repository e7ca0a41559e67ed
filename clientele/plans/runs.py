"""The three runs: commerce tables to model inputs, events to checked signals, cutoff labels to a model frame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clientele.operators import adapter as A
from clientele.operators import features as X
from clientele.operators import leakfree as L
from clientele.operators import quality as Q
from clientele.operators import sessions as N
from clientele.operators import signals as S
from clientele.operators import splits as P
from clientele.operators import targets as G
from clientele.operators.models import model_frame
from clientele.operators.ordering import settled
from clientele.sources import sinks


def commerce_run(tables: dict[str, DataFrame], dense_ids: bool = True, exact_sizes: bool = True) -> dict[str, DataFrame]:
    """Canonical tables, targets, features, sequences, splits and metadata.

    Clean orders, items, transactions and events feed several outputs each; they are settled once
    in the shared checkpoint folder instead of being derived again for every output.
    """
    data = A.clean(tables)
    data = data.replaced({name: settled(data[name]) for name in ("owned_orders", "order_items")})
    data = data.replaced({"owned_items": data["order_items"]})
    canonical = A.canonical_tables(data, dense_ids)
    canonical |= {name: settled(canonical[name]) for name in ("demographics", "transactions", "web_behavior")}
    people, txn, web = canonical["demographics"], canonical["transactions"], canonical["web_behavior"]
    targets = settled(G.all_targets(people, txn))
    features = settled(X.customer_features(people, txn, web, data, end=txn.agg(F.max("timestamp")).scalar()))
    split = P.exact_split if exact_sizes else P.hash_split
    return {
        **canonical,
        "targets": targets,
        "customer_features": features,
        "product_features": X.product_features(data, txn),
        "sequences": X.interaction_sequences(web),
        "splits": split(targets.select("user_id")),
        "metadata": Q.metadata(people, txn, web, features, targets),
    }


def write_commerce_run(out: dict[str, DataFrame], root: str, fmt: str = "parquet") -> None:
    """One action per table. The stored targets and features are what later steps read back."""
    for name in ("demographics", "transactions", "web_behavior", "campaigns"):
        sinks.write_table(out[name], f"{root}/tables/{name}", fmt)
    sinks.write_table(out["targets"], f"{root}/targets", fmt)
    sinks.write_table(out["customer_features"], f"{root}/features/customers", fmt)
    sinks.write_table(out["product_features"], f"{root}/features/products", fmt)
    sinks.write_sequences(out["sequences"], f"{root}/features/sequences")
    sinks.write_splits(out["splits"], f"{root}/splits")
    sinks.write_metadata(out["metadata"], f"{root}/metadata")


def read_model_frame(spark, root: str, key: str = "user_id") -> tuple[DataFrame, list[str]]:
    """Stored features, targets and splits, joined, with label columns kept out of the features."""
    features = spark.read.parquet(f"{root}/features/customers")
    targets = spark.read.parquet(f"{root}/targets")
    return model_frame(features, targets, spark.read.parquet(f"{root}/splits"), key)


def commerce_checks(out: dict[str, DataFrame]) -> DataFrame:
    """Every check over a finished run as one report."""
    return Q.quality_report({
        "targets": Q.check_targets(out["targets"]),
        "features": Q.check_features(out["customer_features"]),
        "splits": Q.check_splits(out["splits"], out["targets"]),
        "sequences": Q.check_sequences(out["sequences"]),
        "alignment": Q.alignment(out["customer_features"], out["targets"], out["splits"]),
        "metadata": Q.check_metadata(out["metadata"], out["customer_features"], out["targets"]),
    })


def signal_run(events: DataFrame, profiles: DataFrame, asof: Column | str, spec: S.SignalSpec) -> dict[str, DataFrame]:
    """Sessions, weekly signals, gate and its report, selected rows, benchmark and extracted trends."""
    logged = events if "session_id" in events.columns else N.sessionise(S.in_window(events, asof))
    # six results read the signals
    signals = settled(S.micro_signals(logged, profiles, asof))
    cleaned = S.clean_signals(signals)
    return {
        "signals": signals,
        "cleaned": cleaned,
        "report": S.clean_report(signals),
        "selected": S.weighted_trim(cleaned, spec.min_cohort, spec.top_per_group, spec.max_rows),
        "benchmark": S.category_benchmark(cleaned, spec.min_cohort),
        "trends": S.extract_trends(cleaned, spec),
    }


def label_run(tables: dict[str, DataFrame], cutoff: Column | str | None = None) -> dict[str, DataFrame]:
    """Cutoff-gated labels, features, sequences and their aligned frame with a split."""
    orders, items = tables["orders"], tables["order_items"]
    at = L.suggest_cutoff(A.not_excluded(orders)) if cutoff is None else cutoff
    labels = L.labels(orders, items, tables["products"], tables["customers"], at)
    features = L.features(orders, items, tables["customers"], at)
    sequences = L.sequences(orders, items, tables["customers"], at)
    frame = L.aligned(labels, features, sequences)
    return {
        "labels": labels,
        "features": features,
        "sequences": sequences,
        "frame": P.hash_split(frame, L.WHO, names=("train", "val"), ratios=(0.8, 0.2)),
        "violations": L.leak_violations(labels, features),
    }
