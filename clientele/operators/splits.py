"""Train, validation and test splits, and folds. Membership follows from a seed and the id alone."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clientele.functions.hashing import unit_hash
from clientele.operators.ordering import global_row_number, quantiles, row_number_in_pieces

# Split names and shares.
NAMES = ("train", "val", "test")
RATIOS = (0.70, 0.15, 0.15)


def _by_position(position: Column, n: Column, names: Sequence[str], ratios: Sequence[float]) -> Column:
    """Sizes are truncated; the rest goes to the last split."""
    out, bound, limits = F.lit(names[-1]), F.lit(0), []
    for name, share in zip(names[:-1], ratios[:-1], strict=True):
        bound = bound + F.floor(n * F.lit(share))
        limits.append((name, bound))
    for name, limit in reversed(limits):
        out = F.when(position <= limit, name).otherwise(out)
    return out


def exact_split(
    users: DataFrame, key: str = "user_id", seed: int = 42,
    names: Sequence[str] = NAMES, ratios: Sequence[float] = RATIOS,
) -> DataFrame:
    """Shuffled split with exact sizes: ids in hash order, cut at the truncated shares."""
    hashed = users.select(key).withColumn("__u", unit_hash(seed, key))
    placed = global_row_number(hashed, ["__u", key], "__pos")
    n = users.agg(F.count(F.lit(1)).alias("n")).scalar()
    return placed.select(key, _by_position(F.col("__pos"), n, names, ratios).alias("split"))


def hash_split(
    users: DataFrame, key: str = "user_id", seed: int = 42,
    names: Sequence[str] = NAMES, ratios: Sequence[float] = RATIOS,
) -> DataFrame:
    """Split by hash range: no shuffle, sizes right on average."""
    u, out, bound, limits = unit_hash(seed, key), F.lit(names[-1]), 0.0, []
    for name, share in zip(names[:-1], ratios[:-1], strict=True):
        bound += share
        limits.append((name, bound))
    for name, limit in reversed(limits):
        out = F.when(u < limit, name).otherwise(out)
    return users.withColumn("split", out)


def temporal_split(df: DataFrame, time: str, names: Sequence[str] = NAMES, ratios: Sequence[float] = RATIOS) -> DataFrame:
    """Oldest rows train, newest test; cut at exact quantiles of the time."""
    micros = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col(time))
    cuts = quantiles(df.select(micros.alias("t")), "t", {"a": ratios[0], "b": ratios[0] + ratios[1]})
    cut = cuts.select(F.struct("a", "b")).scalar()
    staged = df.withColumn("__cut", cut)
    split = F.when(micros <= F.col("__cut.a"), names[0]).when(micros <= F.col("__cut.b"), names[1]).otherwise(names[2])
    return staged.withColumn("split", split).drop("__cut")


def _within_class(df: DataFrame, label: str, key: str, seed: int) -> DataFrame:
    """Position of each row in its class by hash. A class is cut into hash ranges, so its size does not matter."""
    hashed = df.withColumn("__u", unit_hash(seed, key))
    return row_number_in_pieces(hashed, [label], ["__u", key], F.floor(F.col("__u") * 256), "__pos", "__n").drop("__u")


def stratified_split(df: DataFrame, label: str, key: str, test_share: float = 0.2, seed: int = 42) -> DataFrame:
    """Train and test with equal class shares."""
    placed = _within_class(df, label, key, seed)
    is_test = F.col("__pos") <= F.round(F.col("__n") * test_share)
    return placed.withColumn("split", F.when(is_test, "test").otherwise("train")).drop("__pos", "__n")


def stratified_folds(df: DataFrame, label: str, key: str, k: int = 5, seed: int = 42) -> DataFrame:
    """Fold number 0..k-1 with equal class shares."""
    placed = _within_class(df, label, key, seed)
    return placed.withColumn("fold", ((F.col("__pos") - 1) % k).cast("int")).drop("__pos", "__n")
