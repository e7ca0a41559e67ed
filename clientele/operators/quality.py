"""Data-quality, split and consistency checks as long rows, each table read once."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clientele.functions import rules as R
from clientele.operators.targets import BINARY_TARGETS, CONTINUOUS_TARGETS

CHECK = ("check", "column", "value", "status")


def _long(df: DataFrame, cells: dict[tuple[str, str], tuple[Column, Callable[[Column], Column]]]) -> DataFrame:
    """One aggregate for all (check, column) cells, then one row per cell with its status."""
    wide = df.agg(*[value.cast("double").alias(f"c{i}") for i, (value, _) in enumerate(cells.values())])
    rows = []
    for i, ((check, column), (_, status)) in enumerate(cells.items()):
        v = F.col(f"c{i}")
        rows.append(F.struct(F.lit(check).alias("check"), F.lit(column).alias("column"), v.alias("value"),
                             status(v).alias("status")))
    return wide.select(F.inline(F.array(*rows)))


def _zero_is_ok(v: Column) -> Column:
    return F.when(F.coalesce(v, F.lit(0.0)) == 0, "ok").otherwise("error")


def _imbalance(v: Column) -> Column:
    return F.when((v < 0.05) | (v > 0.95), "warning").otherwise("ok")


def _info(v: Column) -> Column:
    return F.lit("ok")


def check_targets(targets: DataFrame) -> DataFrame:
    """Binary values, NULLs, negatives, repeated users and class balance of a target table."""
    cells: dict = {}
    for c in [c for c in BINARY_TARGETS if c in targets.columns]:
        v = F.col(c)
        cells["non_binary", c] = (F.count_if(v.isNull() | ~v.isin(0, 1)), _zero_is_ok)
        cells["positive_rate", c] = (F.avg(v), _imbalance)
    for c in [c for c in CONTINUOUS_TARGETS if c in targets.columns]:
        v = F.col(c).cast("double")
        cells["nulls", c] = (F.count_if(v.isNull() | F.isnan(v)), _zero_is_ok)
        cells["negatives", c] = (F.count_if(v < 0), _zero_is_ok)
        cells["infinite", c] = (F.count_if(R.is_infinite(v)), _zero_is_ok)
        cells["mean", c] = (F.avg(v), _info)
    cells["rows", "user_id"] = (F.count(F.lit(1)), _info)
    cells["duplicates", "user_id"] = (F.count("user_id") - F.countDistinct("user_id"), _zero_is_ok)
    return _long(targets, cells)


def check_features(features: DataFrame, key: str = "user_id", null_limit: float = 0.10, huge: float = 1e10) -> DataFrame:
    """Constant, all-NULL, infinite, sparse or huge numeric features; text columns are named."""
    cells: dict = {}
    for c in R.numeric_columns(features, (key,)):
        v = F.col(c).cast("double")
        bad = v.isNull() | F.isnan(v)
        cells["zero_variance", c] = (F.coalesce(F.min(v) == F.max(v), F.lit(False)).cast("int"),
                                     lambda x: F.when(x == 0, "ok").otherwise("warning"))
        cells["all_null", c] = (F.coalesce(F.every(bad), F.lit(False)).cast("int"), _zero_is_ok)
        cells["infinite", c] = (F.count_if(R.is_infinite(v)), _zero_is_ok)
        cells["null_rate", c] = (F.avg(bad.cast("int")), lambda x: F.when(x > null_limit, "warning").otherwise("ok"))
        cells["huge", c] = (F.count_if((F.abs(v) > huge) & ~R.is_infinite(v)), _zero_is_ok)
    for c in R.string_columns(features, (key,)):
        cells["text_column", c] = (F.lit(1) * F.max(F.lit(1)), lambda x: F.lit("warning"))
    return _long(features, cells)


def check_splits(splits: DataFrame, users: DataFrame, names: Sequence[str] = ("train", "val", "test")) -> DataFrame:
    """Pairwise overlap, users in no split, and sizes: two grouped aggregates and one anti join."""
    member = splits.groupBy("user_id").agg(*[F.max((F.col("split") == n).cast("int")).alias(n) for n in names])
    cells: dict = {}
    for i, a in enumerate(names):
        for b in names[i + 1 :]:
            cells["overlap", f"{a}-{b}"] = (F.count_if((F.col(a) == 1) & (F.col(b) == 1)), _zero_is_ok)
    for n in names:
        cells["size", n] = (F.sum(n), _info)
        cells["share", n] = (F.sum(n) / F.greatest(sum_of(names), F.lit(1)), _info)
    out = _long(member, cells)
    missing = users.select("user_id").distinct().join(splits.select("user_id"), "user_id", "left_anti")
    lost = missing.agg(F.count(F.lit(1)).cast("double").alias("value"))
    status = F.when(F.col("value") == 0, "ok").otherwise("warning")
    return out.unionByName(lost.select(F.lit("uncovered").alias("check"), F.lit("user_id").alias("column"), "value", status.alias("status")))


def sum_of(names: Sequence[str]) -> Column:
    total = F.sum(names[0])
    for n in names[1:]:
        total = total + F.sum(n)
    return total


def alignment(features: DataFrame, targets: DataFrame, splits: DataFrame) -> DataFrame:
    """Users in both tables or only one, and split members that lack either."""
    marks = (
        features.select("user_id", F.lit(1).alias("f"), F.lit(0).alias("t"), F.lit(None).cast("string").alias("split"))
        .unionByName(targets.select("user_id", F.lit(0).alias("f"), F.lit(1).alias("t"), F.lit(None).cast("string").alias("split")))
        .unionByName(splits.select("user_id", F.lit(0).alias("f"), F.lit(0).alias("t"), "split"))
        .groupBy("user_id")
        .agg(F.max("f").alias("f"), F.max("t").alias("t"), F.max("split").alias("split"))
    )
    both = (F.col("f") == 1) & (F.col("t") == 1)
    return _long(marks, {
        ("aligned", "both"): (F.count_if(both), _info),
        ("aligned", "features_only"): (F.count_if((F.col("f") == 1) & (F.col("t") == 0)), _zero_is_ok),
        ("aligned", "targets_only"): (F.count_if((F.col("f") == 0) & (F.col("t") == 1)), _zero_is_ok),
        ("orphans", "split"): (F.count_if(F.col("split").isNotNull() & ~both), _zero_is_ok),
    })


def check_sequences(sequences: DataFrame, max_length: int = 128, max_event_id: int = 10, max_product: int = 100_000) -> DataFrame:
    """Length, id bounds, negative ids and missing times over every event of every user."""
    e = F.col("events")

    def some(test) -> Column:
        return F.size(F.filter(e, test))

    def top(name: str) -> Column:
        return F.max(F.array_max(F.transform(e, lambda x: x[name])))

    return _long(sequences, {
        ("sequences", "events"): (F.count(F.lit(1)), _info),
        ("max_length", "events"): (F.max(F.size(e)), lambda v: F.when(v > max_length, "error").otherwise("ok")),
        ("mean_length", "events"): (F.avg(F.size(e)), _info),
        ("max_id", "event_type_id"): (top("event_type_id"), lambda v: F.when(v > max_event_id, "error").otherwise("ok")),
        ("max_id", "product_idx"): (top("product_idx"), lambda v: F.when(v > max_product, "warning").otherwise("ok")),
        ("negative", "ids"): (F.sum(some(lambda x: (x["event_type_id"] < 0) | (x["product_idx"] < 0))), _zero_is_ok),
        ("null", "time_delta"): (F.sum(some(lambda x: x["time_delta"].isNull())), _zero_is_ok),
        ("arity", "events"): (F.sum(some(lambda x: x["event_type_id"].isNull() | x["product_idx"].isNull())), _zero_is_ok),
    })


def metadata(demographics: DataFrame, txn: DataFrame, web: DataFrame, features: DataFrame, targets: DataFrame,
             categorical: Sequence[str] = ("city", "state", "user_segment", "top_category")) -> DataFrame:
    """Counts, cardinalities and target rates of a run as one nested row."""
    cats = [c for c in categorical if c in features.columns]
    rates = {c: F.avg(c) for c in BINARY_TARGETS} | {c: F.avg(c) for c in CONTINUOUS_TARGETS}
    one = F.lit(1)
    stats = F.struct(
        demographics.agg(F.count(one)).scalar().alias("n_users"),
        txn.agg(F.count(one)).scalar().alias("n_transactions"),
        web.agg(F.count(one)).scalar().alias("n_web_events"),
        txn.agg(F.countDistinct("product_id")).scalar().alias("n_products"),
    )
    cards = features.agg(F.struct(*[F.countDistinct(c).alias(c) for c in cats])).scalar()
    means = targets.agg(F.struct(*[v.alias(c) for c, v in rates.items()],
                                 F.count_if(F.col("next_item_id") != "NONE").alias("next_item_valid"))).scalar()
    numeric = R.numeric_columns(features, ("user_id",))
    spark = demographics.sparkSession
    return spark.range(1).select(
        stats.alias("stats"), cards.alias("categorical_cardinalities"), means.alias("targets"),
        F.array(*[F.lit(c) for c in numeric]).alias("numerical_features"),
        F.array(*[F.lit(c) for c in cats]).alias("categorical_features"),
    )


def check_metadata(meta: DataFrame, features: DataFrame, targets: DataFrame) -> DataFrame:
    """Stored counts and cardinalities against the tables."""
    cards = meta.schema["categorical_cardinalities"].dataType
    names = cards.names if isinstance(cards, T.StructType) else []
    actual = features.agg(F.count(F.lit(1)).alias("rows"), *[F.countDistinct(c).alias(c) for c in names])
    n_targets = targets.agg(F.count(F.lit(1))).scalar()
    facts = actual.select(F.struct("*")).scalar()
    joined = meta.withColumn("__a", facts).withColumn("__t", n_targets)
    rows = [
        ("rows", "targets", F.col("stats.n_users"), F.col("__t")),
        ("rows", "features", F.col("__t"), F.col("__a.rows")),
        *[("cardinality", c, F.col(f"categorical_cardinalities.{c}"), F.col(f"__a.{c}")) for c in names],
    ]
    cells = [
        F.struct(F.lit(k).alias("check"), F.lit(c).alias("column"), (a - b).cast("double").alias("value"),
                 F.when(a == b, "ok").otherwise("error" if k == "rows" else "warning").alias("status"))
        for k, c, a, b in rows
    ]
    return joined.select(F.inline(F.array(*cells)))


def quality_report(parts: dict[str, DataFrame]) -> DataFrame:
    """All check rows of a run under one schema, with the area they come from."""
    out = None
    for area, rows in parts.items():
        named = rows.select(F.lit(area).alias("area"), *CHECK)
        out = named if out is None else out.unionByName(named)
    return out


def report_summary(report: DataFrame) -> DataFrame:
    return report.groupBy("area").agg(
        F.count(F.lit(1)).alias("checks"),
        F.count_if(F.col("status") == "error").alias("errors"),
        F.count_if(F.col("status") == "warning").alias("warnings"),
    )


def missing_fields(records: DataFrame, fields: str, required: Sequence[str]) -> DataFrame:
    """Fields a record lacks and fields it has in excess, from a map column."""
    keys = F.map_keys(fields)
    needed = F.array(*[F.lit(r) for r in required])
    return records.withColumns({
        "missing": F.array_sort(F.array_except(needed, keys)), "extra": F.array_sort(F.array_except(keys, needed)),
    })


def leak_alarm(metrics: DataFrame, auc: str = "auc_roc") -> DataFrame:
    """``leak`` above 0.95, ``chance`` below 0.55, else ``healthy``."""
    level = F.when(F.col(auc) > 0.95, "leak").when(F.col(auc) < 0.55, "chance").otherwise("healthy")
    return metrics.withColumn("alarm", level)


# ---------------------------------------------------------------- scorecard


def dependency_violations(df: DataFrame, rules: dict[tuple[str, ...], Sequence[str]]) -> DataFrame:
    """``(rule, checked, violations)`` of functional dependencies, determinant columns -> dependent columns.

    A row violates ``a -> b`` if its b differs from the value that most rows with its a have; of equally
    frequent values one counts as the majority. Rows without a value of the determinant or the dependent
    are not checked. One pass per determinant: rows become counts per value before they are shuffled, so
    a determinant value that a third of all rows share arrives as one row per task and value.
    """
    out = None
    for by, dependents in rules.items():
        known = df.where(F.concat(*[F.col(c).cast("string") for c in by]).isNotNull())
        cells = F.array(*[F.struct(F.lit(f"{', '.join(by)} -> {d}").alias("rule"), F.col(d).cast("string").alias("value")) for d in dependents])
        cells = known.select(*[F.col(c).alias(f"__{i}") for i, c in enumerate(by)], F.inline(cells)).where(F.col("value").isNotNull())
        keys = [f"__{i}" for i in range(len(by))]
        counts = cells.groupBy(*keys, "rule", "value").agg(F.count(F.lit(1)).alias("n"))
        odd = counts.groupBy(*keys, "rule").agg(F.sum("n").alias("n"), (F.sum("n") - F.max("n")).alias("odd"))
        rows = odd.groupBy("rule").agg(F.sum("n").alias("checked"), F.sum("odd").alias("violations"))
        # a dependency without a row to check is still reported
        named = df.sparkSession.createDataFrame([(f"{', '.join(by)} -> {d}",) for d in dependents], "rule string")
        rows = named.join(F.broadcast(rows), "rule", "left").select("rule", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("checked", "violations")])
        out = rows if out is None else out.unionByName(rows)
    return out


@dataclass(frozen=True)
class CrossRule:
    """A condition on rows of a table and aggregates of another table's rows with the same key."""

    name: str
    other: DataFrame
    keys: tuple[tuple[str, str], ...]  # (column of the table, column of the other)
    aggregates: dict[str, Column]
    holds: Column  # over the table's columns and the aggregates


def cross_violations(df: DataFrame, rules: Sequence[CrossRule]) -> DataFrame:
    """``(rule, checked, violations)``: rows with a partner in the other table, and those for which the rule fails.

    The other table is aggregated by its key first, so rows are never multiplied; rows without a partner
    are left to referential integrity. A condition that is NULL fails.
    """
    out = None
    for r in rules:
        mine = [f"__{i}" for i in range(len(r.keys))]
        known = r.other.groupBy(*[F.col(b).alias(m) for m, (_, b) in zip(mine, r.keys, strict=True)]).agg(
            *[a.alias(n) for n, a in r.aggregates.items()])
        on = F.lit(True)
        for m, (a, _) in zip(mine, r.keys, strict=True):
            on = on & (F.col(a) == F.col(m))
        fails = F.coalesce(~r.holds, F.lit(True)).cast("long")
        rows = df.join(known, on).agg(F.count(F.lit(1)).alias("checked"), F.coalesce(F.sum(fails), F.lit(0)).alias("violations"))
        rows = rows.select(F.lit(r.name).alias("rule"), "checked", "violations")
        out = rows if out is None else out.unionByName(rows)
    return out


def consistency(df: DataFrame, dependencies: dict[tuple[str, ...], Sequence[str]] | None = None, rules: Sequence[CrossRule] = ()) -> DataFrame:
    """``(rule, checked, violations, share)`` of all dependencies and cross-table rules; ``share`` of checked rows that hold."""
    parts = [dependency_violations(df, dependencies)] if dependencies else []
    parts += [cross_violations(df, rules)] if rules else []
    if not parts:
        raise ValueError("consistency needs a dependency or a rule")
    both = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return both.withColumn("share", F.coalesce(1.0 - F.try_divide("violations", "checked"), F.lit(1.0)))


def scorecard(
    df: DataFrame, name: str, key: str, required: Sequence[str], valid: dict[str, Column],
    time: str | None = None, asof: Column | None = None, parent: tuple[DataFrame, str, str] | None = None,
    dependencies: dict[tuple[str, ...], Sequence[str]] | None = None, rules: Sequence[CrossRule] = (),
) -> DataFrame:
    """Completeness, uniqueness, validity, freshness in days, referential integrity and consistency of a table.

    Consistency is the mean share over dependencies and cross-table rules.
    """
    n = F.count(F.lit(1))
    cells = {"completeness": F.avg(sum_columns([F.col(c).isNotNull().cast("double") for c in required]) / len(required)),
             "uniqueness": F.countDistinct(key) / F.greatest(n, F.lit(1))}
    if valid:
        cells["validity"] = F.avg(sum_columns([F.coalesce(v, F.lit(False)).cast("double") for v in valid.values()]) / len(valid))
    if time is not None and asof is not None:
        cells["freshness_days"] = F.timestamp_diff("SECOND", F.max(time), asof) / 86_400.0
    wide = df.agg(*[v.cast("double").alias(k) for k, v in cells.items()])
    out = wide.unpivot([], list(cells), "dimension", "value")
    if parent is not None:
        table, child_key, parent_key = parent
        keys = table.select(F.col(parent_key).alias("__k")).distinct().withColumn("__hit", F.lit(1.0))
        linked = df.select(F.col(child_key).alias("__k")).join(keys, "__k", "left")
        out = out.unionByName(linked.agg(F.avg(F.coalesce("__hit", F.lit(0.0))).alias("value")).select(
            F.lit("referential_integrity").alias("dimension"), "value"))
    if dependencies or rules:
        held = consistency(df, dependencies, rules).agg(F.avg("share").alias("value"))
        out = out.unionByName(held.select(F.lit("consistency").alias("dimension"), "value"))
    return out.select(F.lit(name).alias("table"), "dimension", "value")


def sum_columns(cols: Sequence[Column]) -> Column:
    total = cols[0]
    for c in cols[1:]:
        total = total + c
    return total


def dataset_statistics(tables: dict[str, DataFrame]) -> DataFrame:
    """Sizes, distinct users, means and value counts of the canonical tables, as ``(area, item, value)``."""
    out = None

    def add(area: str, df: DataFrame) -> None:
        nonlocal out
        rows = df.select(F.lit(area).alias("area"), F.col("item").cast("string").alias("item"), F.col("value").cast("double").alias("value"))
        out = rows if out is None else out.unionByName(rows)

    one = F.lit(1)
    shapes = {
        "demographics": ({"rows": F.count(one)}, ["city", "gender", "user_segment"]),
        "products": ({"rows": F.count(one), "avg_price": F.avg("price")}, ["category"]),
        "transactions": ({"rows": F.count(one), "unique_users": F.countDistinct("user_id"),
                          "unique_products": F.countDistinct("product_id"), "avg_amount": F.avg("amount"),
                          "total_revenue": F.sum("amount")}, []),
        "web_behavior": ({"rows": F.count(one), "unique_users": F.countDistinct("user_id")}, ["event_type"]),
        "campaigns": ({"rows": F.count(one), "unique_users": F.countDistinct("user_id"), "ctr": F.avg("clicked")}, ["campaign_id"]),
    }
    for area, (aggs, histograms) in shapes.items():
        if area not in tables:
            continue
        df = tables[area]
        usable = {k: v for k, v in aggs.items() if k != "avg_price" or "price" in df.columns}
        wide = df.agg(*[v.cast("double").alias(k) for k, v in usable.items()])
        add(area, wide.unpivot([], list(usable), "item", "value"))
        for h in [h for h in histograms if h in df.columns]:
            add(area, df.groupBy(F.concat(F.lit(f"{h}:"), F.col(h)).alias("item")).agg(F.count(one).alias("value")))
    return out


def campaign_summary(campaigns: DataFrame, users: DataFrame) -> DataFrame:
    """Click-through rate and the share of users reached."""
    n = users.agg(F.countDistinct("user_id")).scalar()
    return campaigns.agg(
        F.count(F.lit(1)).alias("records"),
        F.avg("clicked").alias("ctr"),
        F.countDistinct("user_id").alias("reached"),
    ).withColumn("coverage", F.col("reached") / n)
