"""Governed metrics, rules and access, unified customer records, and service roll-ups."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from clientele.operators.ordering import join_keys, quantiles, settled

ROW_LIMIT = 5000
# Governed thresholds.
PREMIUM_CLV = 1000.0
UPGRADE_PROPENSITY = 0.75
CONTACT_DAYS = 30


@dataclass(frozen=True)
class Entity:
    """A table users may ask for, with the fields, terms and metrics they may name."""

    table: DataFrame
    key: str
    fields: dict[str, str]
    metrics: dict[str, str]
    terms: dict[tuple[str, str], Column] = field(default_factory=dict)


_OPS = {
    "=": lambda c, v: c == v,
    "!=": lambda c, v: c != v,
    ">": lambda c, v: c > v,
    ">=": lambda c, v: c >= v,
    "<": lambda c, v: c < v,
    "<=": lambda c, v: c <= v,
    "in": lambda c, v: c.isin(*v),
}


def governed_request(catalog: dict[str, Entity], request: dict, row_limit: int = ROW_LIMIT) -> DataFrame:
    """``{entity, filters, metric, sort, limit}`` as a DataFrame. Unknown names are refused.

    So is a limit above ``row_limit``, and a request without a limit that has more rows: an answer is
    never cut without a word. A filter on a term, such as ``segment = premium``, becomes the governed rule behind it.
    """
    entity = catalog.get(request["entity"])
    if entity is None:
        raise PermissionError(f"unknown entity {request['entity']!r}")
    metric = entity.metrics.get(request["metric"])
    if metric is None:
        raise PermissionError(f"unknown metric {request['metric']!r}")
    df = entity.table
    for f in request.get("filters", []):
        rule = entity.terms.get((f["field"], str(f["value"]))) if f.get("op", "=") == "=" else None
        if rule is not None:
            df = df.where(rule)
        elif f["field"] in entity.fields and f.get("op", "=") in _OPS:
            df = df.where(_OPS[f.get("op", "=")](F.col(entity.fields[f["field"]]), f["value"]))
        else:
            raise PermissionError(f"unknown filter {f!r}")
    by = F.col(metric)
    order = by.desc_nulls_last() if request.get("sort", "desc") == "desc" else by.asc_nulls_last()
    shown = list(dict.fromkeys([entity.key, *entity.fields.values(), metric]))
    if "limit" in request:
        if int(request["limit"]) > row_limit:
            raise PermissionError(f"a request may ask for {row_limit} rows at most")
        return df.select(*shown).orderBy(order, entity.key).limit(int(request["limit"]))
    if df.limit(row_limit + 1).count() > row_limit:
        raise PermissionError(f"more than {row_limit} rows: narrow the filters or state a limit")
    return df.select(*shown).orderBy(order, entity.key)


def governed_rules(customers: DataFrame, contacts: DataFrame, asof: Column, key: str = "customer_id",
                   clv: str = "clv", propensity: str = "propensity", contact_time: str = "contacted_at") -> DataFrame:
    """Premium, upgrade candidate and campaign eligible, as flags."""
    recent = contacts.where((F.col(contact_time) > asof - F.make_dt_interval(F.lit(CONTACT_DAYS))) & (F.col(contact_time) <= asof))
    touched = recent.select(key).distinct().withColumn("__touched", F.lit(True))
    return customers.join(touched, key, "left").select(
        *customers.columns,
        F.coalesce(F.col(clv) > PREMIUM_CLV, F.lit(False)).alias("premium"),
        F.coalesce(F.col(propensity) > UPGRADE_PROPENSITY, F.lit(False)).alias("upgrade_candidate"),
        F.col("__touched").isNull().alias("campaign_eligible"),
    )


def campaign_eligible(customers: DataFrame, contacts: DataFrame, asof: Column, key: str = "customer_id",
                      contact_time: str = "contacted_at") -> DataFrame:
    """Customers without a contact in the last days."""
    recent = contacts.where((F.col(contact_time) > asof - F.make_dt_interval(F.lit(CONTACT_DAYS))) & (F.col(contact_time) <= asof))
    return customers.join(recent.select(key), key, "left_anti")


def secured(df: DataFrame, role: str, row_rules: dict[str, Column], masked: Sequence[str], privileged: Sequence[str],
            secret: str) -> DataFrame:
    """Rows a role may see, with personal columns hashed for the others. A role without a rule sees nothing.

    The hash is keyed with ``secret``, so a list of likely names does not reveal who is behind it.
    """
    key = F.lit(f"{secret}:")
    rule = row_rules.get(role)
    visible = df.where(rule if rule is not None else F.lit(False))
    if role in privileged:
        return visible

    def hidden(c: str) -> Column:
        return F.sha2(F.concat(key, F.sha2(F.concat(key, F.col(c).cast("string")), 256)), 256)

    return visible.withColumns({c: hidden(c) for c in masked if c in df.columns})


# ---------------------------------------------------------------- unified records


def normal_key(c: Column | str) -> Column:
    """Lower case without spaces and punctuation; empty becomes NULL."""
    c = F.col(c) if isinstance(c, str) else c
    bare = F.regexp_replace(F.lower(c), r"[^a-z0-9@.]", "")
    return F.when(bare != "", bare)


def linked_records(records: DataFrame, record: str, keys: Sequence[str], max_rounds: int = 30) -> DataFrame:
    """``(record, customer)``: records that share a key, directly or through others, get the smallest record id.

    Records and keys form a two-sided graph; each round passes the smallest label over keys, with
    partial minima before every shuffle, so a key shared by very many records stays cheap. The
    labels of each round are settled. It stops when nothing changes.
    """
    cells = [F.struct(F.lit(k).alias("kind"), normal_key(k).alias("value")) for k in keys]
    edges = settled(records.select(F.col(record).alias("record"), F.inline(F.array(*cells))).where(F.col("value").isNotNull()).distinct())
    labels = settled(records.select(F.col(record).alias("record"), F.col(record).alias("label")).distinct())
    for _ in range(max_rounds):
        by_key = edges.join(labels, "record").groupBy("kind", "value").agg(F.min("label").alias("low"))
        offered = edges.join(by_key, ["kind", "value"]).groupBy("record").agg(F.min("low").alias("low"))
        stepped = labels.join(offered, "record", "left").select(
            "record", F.col("label").alias("old"), F.least("label", F.coalesce("low", "label")).alias("label")
        )
        # follow the label's own label as well: chains shorten by half each round
        hops = stepped.select(F.col("record").alias("label"), F.col("label").alias("next"))
        jumped = settled(stepped.join(hops, "label", "left").select(
            "record", "old", F.least("label", F.coalesce("next", "label")).alias("label")))
        labels = jumped.select("record", "label")
        if jumped.where(F.col("label") != F.col("old")).isEmpty():
            return labels.select("record", F.col("label").alias("customer"))
    raise RuntimeError(f"records were not linked within {max_rounds} rounds")


def unified_customers(records: DataFrame, record: str, keys: Sequence[str], attributes: Sequence[str],
                      updated: str, consent: str = "consent") -> DataFrame:
    """One row per linked customer: newest known value of each attribute, and whether it may be used.

    A customer may be targeted only if the newest stated consent is true.
    """
    groups = linked_records(records, record, keys).withColumnRenamed("record", "__record")
    joined = records.join(groups, F.col(record) == F.col("__record"))

    def newest(c: str) -> Column:
        return F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.struct(F.col(updated), F.col(record))))

    return joined.groupBy("customer").agg(
        F.count(F.lit(1)).alias("records"),
        *[newest(c).alias(c) for c in attributes],
        F.coalesce(newest(consent), F.lit(False)).alias("may_contact"),
    )


# ---------------------------------------------------------------- alarms and roll-ups


def score_swings(scores: DataFrame, entity: str, time: str, score: str, limit: float = 0.5) -> DataFrame:
    """Day-to-day changes of a score above the limit. The last score of each day counts, so a
    busy entity has at most one row per day when the days are compared."""
    daily = scores.groupBy(entity, F.to_date(time).alias("day")).agg(F.max_by(score, F.struct(time, score)).alias(score))
    previous = F.lag(score).over(W.partitionBy(entity).orderBy("day"))
    changed = daily.withColumn("previous", previous).withColumn("swing", F.abs(F.col(score) - F.col("previous")))
    return changed.where(F.round("swing", 9) > limit)


def request_roll_up(log: DataFrame, keys: Sequence[str], latency: str = "latency_ms", status: str = "status") -> DataFrame:
    """Requests, failures, success rate and latency percentiles (exact) per key.

    A group of requests without a key, or without any latency, is a row too.
    """
    counts = log.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("requests"),
        F.count_if(F.col(status) != "success").alias("failures"),
        F.avg((F.col(status) == "success").cast("double")).alias("success_rate"),
    )
    return join_keys(counts, quantiles(log, latency, {"p50": 0.50, "p95": 0.95, "p99": 0.99}, keys), keys, "left")
