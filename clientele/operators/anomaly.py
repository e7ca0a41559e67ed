"""Deviations in values, distributions and prediction shares, and how they relate."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clientele.functions.hashing import poisson_one, replicate_seeds
from clientele.functions.timeutil import seconds_between
from clientele.operators.ordering import join_keys, quantiles, settled

# Detection thresholds and the weights of the four pair scores.
Z_LIMIT = 4.0
PSI_LIMIT = 0.20
SHARE_LIMIT = 0.15
PAIR_LIMIT = 0.70
PAIR_WEIGHTS = {"entity": 0.38, "time": 0.28, "dimension": 0.14, "semantic": 0.20}
MIN_REDUCTION = 0.30


# ---------------------------------------------------------------- field roles


def field_roles(df: DataFrame, small: int = 30, spread: float = 0.8) -> DataFrame:
    """Entity, timestamp, dimension or metric, from type, number of values and evenness of their use.

    Times are timestamps and fractions metrics. Of the others, a column with few values is a
    dimension, an evenly used one an entity, and the rest dimensions (text) or metrics (integers).
    """
    timed, real, coded = [], [], []
    for f in df.schema:
        if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType, T.DateType)):
            timed.append(f.name)
        elif isinstance(f.dataType, T.FractionalType):
            real.append(f.name)
        elif isinstance(f.dataType, (T.StringType, T.IntegralType, T.BooleanType)):
            coded.append((f.name, isinstance(f.dataType, T.IntegralType)))
    cells = [F.struct(F.lit(c).alias("column"), F.lit(i).alias("whole"), F.col(c).cast("string").alias("v")) for c, i in coded]
    counts = df.select(F.inline(F.array(*cells))).where(F.col("v").isNotNull()).groupBy("column", "whole", "v").agg(
        F.count(F.lit(1)).cast("double").alias("n")
    )
    total = F.sum("n")
    entropy = F.log(total) - F.sum(F.col("n") * F.log("n")) / total
    stats = counts.groupBy("column", "whole").agg(F.count(F.lit(1)).alias("n_values"), entropy.alias("entropy"))
    even = F.when(F.col("n_values") > 1, F.col("entropy") / F.log("n_values")).otherwise(0.0)
    role = (
        F.when(F.col("n_values") <= small, "DIMENSION")
        .when(even > spread, "ENTITY")
        .when(F.col("whole"), "METRIC")
        .otherwise("DIMENSION")
    )
    out = stats.select("column", "n_values", even.alias("evenness"), role.alias("role"))
    fixed = [(c, "TIMESTAMP") for c in timed] + [(c, "METRIC") for c in real]
    if fixed:
        named = df.sparkSession.createDataFrame(fixed, "column string, role string")
        out = out.unionByName(named.select("column", F.lit(None).cast("bigint").alias("n_values"),
                                           F.lit(None).cast("double").alias("evenness"), "role"))
    return out


# ---------------------------------------------------------------- detectors


def robust_scores(baseline: DataFrame, current: DataFrame, value: str, keys: Sequence[str] = (), limit: float = Z_LIMIT) -> DataFrame:
    """``|x - median| / MAD`` of current rows against the baseline of their key. Medians are exact.

    Any difference from a constant baseline deviates (``z`` is NULL there). Rows whose key has no
    baseline stay, with ``no_baseline`` set; a NULL key is a key.
    """
    keyed = baseline if keys else baseline.withColumn("__all", F.lit(1))
    now = current if keys else current.withColumn("__all", F.lit(1))
    by = list(keys) or ["__all"]
    middle = settled(quantiles(keyed, value, {"median": 0.5}, by))
    apart = join_keys(keyed, middle, by).select(*by, F.abs(F.col(value) - F.col("median")).alias("__d"))
    mad = quantiles(apart, "__d", {"mad": 0.5}, by)
    away = F.abs(F.col(value) - F.col("median"))
    scored = join_keys(join_keys(now, middle, by, "left"), mad, by, "left").withColumn("z", F.try_divide(away, F.col("mad")))
    beyond = F.when(F.col("mad") == 0, away > 0).otherwise(F.round("z", 9) > limit)
    return (
        scored.withColumn("deviates", F.coalesce(beyond, F.lit(False)))
        .withColumn("no_baseline", F.col("median").isNull())
        .drop(*([] if keys else ["__all"]))
    )


def stability_index(
    baseline: DataFrame, current: DataFrame, value: str, keys: Sequence[str] = (), bins: int = 10,
    limit: float = PSI_LIMIT, floor: float = 1e-4,
) -> DataFrame:
    """Population stability index against baseline quantile bins, per key; empty bins count as ``floor``.

    A key that only one side has is compared with ``floor`` on the other; a new key has one bin.
    """
    keyed = baseline if keys else baseline.withColumn("__all", F.lit(1))
    now = current if keys else current.withColumn("__all", F.lit(1))
    by = list(keys) or ["__all"]
    probs = {f"q{i}": i / bins for i in range(1, bins)}
    cuts = settled(quantiles(keyed, value, probs, by).select(*by, F.array_distinct(F.array(*probs)).alias("cuts")))
    rows = keyed.select(*by, value, F.lit(1.0).alias("p"), F.lit(0.0).alias("q")).unionByName(
        now.select(*by, value, F.lit(0.0).alias("p"), F.lit(1.0).alias("q"))
    )
    known = join_keys(rows.where(F.col(value).isNotNull()), cuts, by, "left")
    known = known.withColumn("cuts", F.coalesce("cuts", F.array().cast("array<double>")))
    binned = known.withColumn("bin", F.size(F.filter("cuts", lambda c: c < F.col(value))))
    counts = binned.groupBy(*by, "bin").agg(F.sum("p").alias("p"), F.sum("q").alias("q"), F.first(F.size("cuts") + 1).alias("n_bins"))
    totals = counts.groupBy(*by).agg(F.sum("p").alias("tp"), F.sum("q").alias("tq"))
    shares = join_keys(counts, totals, by)
    p, q = F.greatest(F.try_divide("p", "tp"), F.lit(floor)), F.greatest(F.try_divide("q", "tq"), F.lit(floor))
    out = shares.groupBy(*by).agg(F.sum((q - p) * F.log(q / p)).alias("psi"))
    return out.withColumn("shifted", F.col("psi") > limit).drop(*([] if keys else ["__all"]))


def share_drift(baseline: DataFrame, current: DataFrame, label: str, limit: float = SHARE_LIMIT) -> DataFrame:
    """Share of each class before and now, and whether it moved by more than the limit."""
    counts = baseline.select(label, F.lit(1).alias("b"), F.lit(0).alias("c")).unionByName(
        current.select(label, F.lit(0).alias("b"), F.lit(1).alias("c"))
    ).groupBy(label).agg(F.sum("b").alias("b"), F.sum("c").alias("c"))
    totals = counts.agg(F.struct(F.sum("b").alias("b"), F.sum("c").alias("c"))).scalar()
    shares = counts.withColumn("__t", totals)
    before, now = F.try_divide("b", "__t.b"), F.try_divide("c", "__t.c")
    return shares.select(label, before.alias("baseline_share"), now.alias("current_share")).withColumn(
        "drifted", F.abs(F.col("current_share") - F.col("baseline_share")) > limit
    )


def deviation_record(df: DataFrame, stratum: str, metric: str, entities: Column, start: Column, end: Column,
                     locus: Column, magnitude: Column, low: Column, high: Column) -> DataFrame:
    """Deviations of any detector in one shape, with a hash over their content."""
    body = df.select(
        F.lit(stratum).alias("stratum"), F.lit(metric).alias("metric"), F.array_sort(entities).alias("entities"),
        start.alias("start_ts"), end.alias("end_ts"), locus.alias("locus"), magnitude.cast("double").alias("magnitude"),
        F.struct(low.cast("double").alias("low"), high.cast("double").alias("high")).alias("interval"),
    )
    return body.withColumn("provenance", F.sha2(F.to_json(F.struct(*body.columns)), 256))


# ---------------------------------------------------------------- drill-down


def drill_down(df: DataFrame, flag: str, dimensions: Sequence[str], depth: int = 3, beam: int = 5, min_rows: int = 5) -> DataFrame:
    """Slices where flagged rows concentrate, by beam search.

    The score of a slice is ``flagged * log2(rate / base rate)`` bits of surprise minus
    ``log2(number of dimensions) * depth`` bits to name it. Each level is one pass with one
    grouped count; only the best slices (as many as the beam) come to the driver.
    """
    spark = df.sparkSession
    marked = df.withColumn("__f", F.coalesce(F.col(flag).cast("int"), F.lit(0)))
    base = marked.agg(F.avg("__f").alias("r")).first()["r"] or 0.0
    found, parents, sep = [], [{}], "\x1f"
    for level in range(1, depth + 1):
        cells = []
        for parent in parents:
            inside = F.lit(True)
            for d, v in parent.items():
                inside = inside & (F.col(d).cast("string") == F.lit(v))
            for d in [d for d in dimensions if d not in parent]:
                fixed = F.array(*[F.lit(f"{k}={v}") for k, v in parent.items()]).cast("array<string>")
                name = F.array_sort(F.concat(fixed, F.array(F.concat(F.lit(f"{d}="), F.col(d).cast("string")))))
                cells.append(F.when(inside, F.array_join(name, sep)))
        if not cells:
            break
        names = F.array_distinct(F.filter(F.array(*cells), lambda x: x.isNotNull()))
        counts = marked.select("__f", F.explode(names).alias("slice")).groupBy("slice").agg(
            F.count(F.lit(1)).alias("n"), F.sum("__f").alias("flagged")
        )
        rate = F.col("flagged") / F.col("n")
        lift = rate / F.lit(base if base > 0 else 1.0)
        score = F.when(F.col("flagged") > 0, F.col("flagged") * F.log2(lift)).otherwise(0.0) - F.log2(F.lit(float(len(dimensions)))) * level
        best = (
            counts.where(F.col("n") >= min_rows)
            .select("slice", "n", "flagged", lift.alias("concentration"), score.alias("score"))
            .orderBy(F.round("score", 6).desc(), "slice")
            .limit(beam)
            .collect()
        )
        if not best:
            break
        found += [(level, r["slice"].replace(sep, " & "), r["n"], r["flagged"], float(r["concentration"]), float(r["score"])) for r in best]
        parents = [dict(p.split("=", 1) for p in r["slice"].split(sep)) for r in best]
    return spark.createDataFrame(found, "depth int, slice string, n bigint, flagged bigint, concentration double, score double")


# ---------------------------------------------------------------- relations of deviations


def jaccard(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))), F.lit(0.0))


MEETING_ROWS = 4096  # deviations of one entity and time bucket that meet in one task


def _after_prefix(size: Column, share: float) -> Column:
    """How many entities of a deviation lie behind its prefix."""
    return F.ceil(size * F.lit(share - 1e-9)) - 1


def _meeting(keyed: DataFrame, share: float) -> DataFrame:
    """Pairs ``(cause, effect, met)`` of different strata that can share ``share`` of their entities.

    Two sets whose intersection is at least that share of their union have an entity in common among the
    rarest ``size - ceil(share x size) + 1`` of either. Entities are therefore ranked by the number of
    deviations that hold them, and only these prefixes meet: an entity that all deviations hold comes
    last. A list of many deviations is cut, and its parts meet apart. ``met`` counts what both prefixes share;
    as all are ranked alike, the pair shares at most that and what follows the longer prefix (``_after_prefix``).
    """
    held = keyed.groupBy("entity").agg(F.count(F.lit(1)).alias("__held"))
    rare = keyed.join(held, "entity")
    rare = rare.withColumn("__rank", F.row_number().over(W.partitionBy("dev_id", "stratum", "bucket").orderBy("__held", "entity")))
    first = settled(rare.where(F.col("__rank") <= F.col("size") - _after_prefix(F.col("size"), share)).drop("__held", "__rank"))
    at = ["entity", "bucket"]
    right = first.select("entity", F.explode(F.array(F.col("bucket"), F.col("bucket") - 1)).alias("bucket"),
                         F.col("dev_id").alias("effect"), F.col("stratum").alias("__t"), F.col("size").alias("__b"))
    cuts = first.groupBy(*at).agg(F.ceil(F.count(F.lit(1)) / MEETING_ROWS).cast("int").alias("__cuts"))
    left = first.join(cuts, at).select(*at, F.col("dev_id").alias("cause"), F.col("stratum").alias("__s"), F.col("size").alias("__a"),
                                       F.pmod(F.xxhash64("dev_id"), F.col("__cuts")).cast("int").alias("__part"))
    spread = right.join(cuts, at).withColumn("__part", F.explode(F.sequence(F.lit(0), F.col("__cuts") - 1))).drop("__cuts")
    met = left.join(spread, [*at, "__part"]).where("cause <> effect AND __s <> __t")
    near = F.least("__a", "__b") >= F.greatest("__a", "__b") * F.lit(share - 1e-9)  # sets of such unlike sizes cannot share enough
    return settled(met.where(near).groupBy("cause", "effect").agg(F.count(F.lit(1)).alias("met")))


def _common_entities(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """``(cause, effect, common)``: how many entities each pair shares.

    ``pairs`` holds the sizes of both; the entities of the smaller one are looked up among those of the other.
    """
    first = F.col("a_size") <= F.col("b_size")
    named = pairs.select("cause", "effect", F.when(first, F.col("cause")).otherwise(F.col("effect")).alias("__few"),
                         F.when(first, F.col("effect")).otherwise(F.col("cause")).alias("__many")).distinct()
    few = members.select(F.col("dev_id").alias("__few"), "entity")
    many = members.select(F.col("dev_id").alias("__many"), "entity")
    both = named.join(few, "__few").join(many, ["__many", "entity"], "left_semi")
    return both.groupBy("cause", "effect").agg(F.count(F.lit(1)).alias("common"))


def pair_scores(
    deviations: DataFrame, delay_seconds: float = 0.0, spread_seconds: float = 3600.0, max_lag_seconds: int = 86_400,
    affinity: DataFrame | None = None, limit: float = PAIR_LIMIT, weights: dict[str, float] | None = None,
    members: DataFrame | None = None,
) -> DataFrame:
    """Scores of deviation pairs of different strata, earlier one first, that reach the limit.

    Without a shared entity a pair cannot reach the limit, so pairs are found by joining on
    entity and time bucket; nothing is paired that cannot count. ``members``, distinct rows of
    ``(dev_id, entity)``, stand in for the column ``entities``; no deviation then holds all its entities
    in one row, and an entity of very many deviations pairs none of them by itself (``_meeting``).
    """
    w = weights or PAIR_WEIGHTS
    if sum(v for k, v in w.items() if k != "entity") >= limit:
        raise ValueError("the limit must be out of reach for pairs without a shared entity")
    origin = F.lit("1970-01-01").cast("timestamp_ntz")
    bucket = F.floor(seconds_between(origin, F.col("start_ts")) / max_lag_seconds)
    if members is None:
        base = deviations.select("dev_id", "stratum", "metric", "locus", "start_ts", "entities")
        keyed = base.select("dev_id", "stratum", F.explode("entities").alias("entity"), bucket.alias("bucket"))
        entity = jaccard(F.col("a_entities"), F.col("b_entities"))
    else:
        counts = members.groupBy("dev_id").agg(F.count(F.lit(1)).alias("size"))
        base = deviations.select("dev_id", "stratum", "metric", "locus", "start_ts").join(counts, "dev_id")
        keyed = members.join(base.select("dev_id", "stratum", "size", bucket.alias("bucket")).distinct(), "dev_id")
        entity = F.col("common") / (F.col("a_size") + F.col("b_size") - F.col("common"))
    if members is None:
        left = keyed.select("entity", "bucket", F.col("dev_id").alias("cause"), F.col("stratum").alias("__s"))
        right = keyed.select("entity", F.explode(F.array(F.col("bucket"), F.col("bucket") - 1)).alias("bucket"),
                             F.col("dev_id").alias("effect"), F.col("stratum").alias("__t"))
        met = left.join(right, ["entity", "bucket"]).where("cause <> effect AND __s <> __t")
        candidates = met.groupBy("cause", "effect").agg(F.count(F.lit(1)).alias("common"))
    else:
        share = (limit - sum(v for k, v in w.items() if k != "entity")) / w["entity"]
        candidates = _meeting(keyed, share)

    a = base.select(F.col("dev_id").alias("cause"), *[F.col(c).alias(f"a_{c}") for c in base.columns[1:]])
    b = base.select(F.col("dev_id").alias("effect"), *[F.col(c).alias(f"b_{c}") for c in base.columns[1:]])
    both = candidates.join(a, "cause").join(b, "effect")
    lag = seconds_between(F.col("a_start_ts"), F.col("b_start_ts"))
    both = both.where((F.col("a_stratum") != F.col("b_stratum")) & (lag >= 0) & (lag <= max_lag_seconds))
    if affinity is not None:
        both = both.join(affinity.select(F.col("metric_a").alias("a_metric"), F.col("metric_b").alias("b_metric"), "similarity"),
                         ["a_metric", "b_metric"], "left")
        semantic = F.coalesce("similarity", F.lit(0.0))
    else:
        semantic = (F.col("a_metric") == F.col("b_metric")).cast("double")
    keys = F.array_union(F.map_keys("a_locus"), F.map_keys("b_locus"))
    same = F.filter(keys, lambda k: F.try_element_at(F.col("a_locus"), k) == F.try_element_at(F.col("b_locus"), k))
    parts = {
        "time": F.exp(-(lag - delay_seconds) * (lag - delay_seconds) / (2.0 * spread_seconds * spread_seconds)),
        "dimension": F.coalesce(F.try_divide(F.size(same), F.size(keys)), F.lit(0.0)),
        "semantic": semantic,
    }
    total = F.col("entity") * w["entity"] + F.col("time") * w["time"] + F.col("dimension") * w["dimension"] + F.col("semantic") * w["semantic"]
    reaches = F.round(total, 9) >= limit
    if members is None:
        scored = both.select("cause", "effect", entity.alias("entity"), *[c.alias(k) for k, c in parts.items()])
    else:
        # pairs that miss the limit even with the most entities they can share are not counted
        longest = F.greatest(_after_prefix(F.col("a_size"), share), _after_prefix(F.col("b_size"), share), F.lit(0))
        most = F.least("a_size", "b_size", F.col("met") + longest)
        known = both.select("cause", "effect", "a_size", "b_size", most.alias("common"), *[c.alias(k) for k, c in parts.items()])
        able = settled(known.withColumn("entity", entity).where(reaches).drop("common", "entity"))
        counted = able.join(_common_entities(able, members), ["cause", "effect"])
        scored = counted.select("cause", "effect", entity.alias("entity"), *parts)
    return scored.withColumn("score", total).where(reaches)


def ablation(
    rows: DataFrame, causes: DataFrame, key: str, entity: str, value: str, current: str,
    replicates: int = 200, seed: int = 42, limit: float = MIN_REDUCTION,
) -> DataFrame:
    """How much of a shift in the mean goes away without the suspected entities, with a bootstrap interval.

    The effect is ``mean(current) - mean(baseline)``; it is computed with and without the entities
    in every replicate, and the cause passes if the reduction and its lower bound exceed the limit.
    """
    marked = rows.join(causes.select(entity).distinct().withColumn("__cause", F.lit(1)), entity, "left")
    h1, h2 = replicate_seeds(seed, key)
    base = marked.select(F.col(value).cast("double").alias("v"), F.col(current).cast("int").alias("cur"),
                         F.coalesce("__cause", F.lit(0)).alias("c"), h1.alias("h1"), h2.alias("h2"))
    drawn = base.withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(replicates))))
    # replicate 0 is the data itself
    weight = F.when(F.col("r") == 0, 1.0).otherwise(poisson_one(F.col("h1"), F.col("h2"), F.col("r").cast("bigint")).cast("double"))
    drawn = drawn.withColumn("w", weight)

    def mean(cond: Column) -> Column:
        return F.try_divide(F.sum(F.when(cond, F.col("w") * F.col("v"))), F.sum(F.when(cond, F.col("w"))))

    now, rest = F.col("cur") == 1, F.col("c") == 0
    per = drawn.groupBy("r").agg(
        (mean(now) - mean(~now)).alias("full"), (mean(now & rest) - mean(~now & rest)).alias("without")
    ).withColumn("reduction", 1 - F.try_divide(F.abs("without"), F.abs("full")))
    observed, draw = F.col("r") == 0, F.when(F.col("r") > 0, F.col("reduction"))
    out = per.agg(
        F.max(F.when(observed, F.col("full"))).alias("effect"),
        F.max(F.when(observed, F.col("without"))).alias("effect_without"),
        F.max(F.when(observed, F.col("reduction"))).alias("reduction"),
        F.percentile(draw, 0.025).alias("ci_95_lower"),
        F.percentile(draw, 0.975).alias("ci_95_upper"),
    )
    return out.withColumn("passed", (F.col("reduction") > limit) & (F.col("ci_95_lower") > limit))


def root_causes(edges: DataFrame, entities: DataFrame) -> DataFrame:
    """Roots (no incoming edge), and for every node they reach the entities common to a whole chain.

    ``edges`` is ``(cause, effect)``, ``entities`` ``(node, entities)``. One join per step, until no
    step finds a new (root, node, entities); a cycle leads back to known ones, so it ends as well.
    ``depth`` is the length of the shortest such chain.
    """
    edges = settled(edges.select("cause", "effect").distinct())
    nodes = settled(entities.select("node", F.array_sort("entities").alias("entities")))
    roots = edges.select(F.col("cause").alias("node")).distinct().join(
        edges.select(F.col("effect").alias("node")), "node", "left_anti"
    )
    front = settled(roots.join(nodes, "node").select(F.col("node").alias("root"), "node", "entities", F.lit(0).alias("depth")))
    out, step = front, 0
    while not front.isEmpty():
        step += 1
        reached = (
            front.join(edges, front["node"] == edges["cause"])
            .select("root", F.col("effect").alias("node"), F.col("entities").alias("__seen"))
            .join(nodes, "node")
            .select("root", "node", F.array_sort(F.array_intersect("__seen", "entities")).alias("entities"))
            .where(F.size("entities") > 0)
            .distinct()
        )
        front = settled(reached.join(out, ["root", "node", "entities"], "left_anti").withColumn("depth", F.lit(step)))
        out = out.unionByName(front)
    return out


def chain_entities(edges: DataFrame, members: DataFrame) -> DataFrame:
    """``(root, node, entity, depth)``: the entities that every node of some chain from a root to the node holds.

    ``edges`` is ``(cause, effect)``, ``members`` ``(node, entity)``; roots have no incoming edge. Each
    step carries only what the last one found over the edges both of whose ends hold the entity, so rows
    are joined by node and entity, and no node's entities are ever gathered. ``depth`` is the length of the
    shortest such chain. A cycle leads back to known rows, so it ends as well.
    """
    edges = settled(edges.select("cause", "effect").distinct())
    members = members.select("node", "entity").distinct()
    carried = edges.join(members.withColumnRenamed("node", "cause"), "cause").join(
        members.withColumnRenamed("node", "effect"), ["effect", "entity"], "left_semi")
    carried = settled(carried.select(F.col("cause").alias("node"), "entity", "effect"))
    roots = edges.select(F.col("cause").alias("node")).distinct().join(edges.select(F.col("effect").alias("node")), "node", "left_anti")
    front = settled(roots.join(members, "node").select(F.col("node").alias("root"), "node", "entity", F.lit(0).alias("depth")))
    out, step = front, 0
    while not front.isEmpty():
        step += 1
        reached = front.join(carried, ["node", "entity"]).select("root", F.col("effect").alias("node"), "entity").distinct()
        front = settled(reached.join(out, ["root", "node", "entity"], "left_anti").withColumn("depth", F.lit(step)))
        out = out.unionByName(front)
    return out


def record_digests(cells: DataFrame, members: DataFrame) -> DataFrame:
    """``cells`` plus ``n_entities`` and ``provenance``, a SHA-256 over the record that any engine can repeat.

    ``cells`` is ``(dev_id, stratum, metric, start_ts, end_ts, magnitude)``; the entities, distinct rows of
    ``(dev_id, entity)``, enter by their number and the sum of their hashes, so no list is gathered.
    Times enter in microseconds, the magnitude in units of 10^-6.
    """
    part = F.conv(F.substring(F.md5("entity"), 1, 15), 16, 10).cast("decimal(20,0)")
    known = members.groupBy("dev_id").agg(F.count(F.lit(1)).alias("n_entities"), F.sum(part).alias("__users"))
    out = cells.join(known, "dev_id", "left").withColumn("n_entities", F.coalesce("n_entities", F.lit(0)))
    micros = lambda c: F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col(c))
    fields = ["dev_id", "stratum", "metric", "n_entities", F.coalesce("__users", F.lit(0)), micros("start_ts"), micros("end_ts"),
              F.round(F.col("magnitude") * 1_000_000).cast("long")]
    body = F.concat_ws("|", *[(F.col(f) if isinstance(f, str) else f).cast("string") for f in fields])
    return out.withColumn("provenance", F.sha2(body, 256)).drop("__users")


def missing_responses(causes: DataFrame, effects: DataFrame, entity: str, time: str, window_seconds: int) -> DataFrame:
    """Causes with no effect on the same entity within the window after them.

    Both sides meet in buckets of the window's width, so a busy entity is spread over its buckets.
    """
    origin = F.lit("1970-01-01").cast("timestamp_ntz")

    def bucket(c: str) -> Column:
        return F.floor(seconds_between(origin, F.col(c)) / window_seconds)

    b = F.col("__b")
    asked = causes.withColumn("__b", bucket(time)).withColumn("__slot", F.explode(F.array(b, b + 1)))
    seen = effects.select(F.col(entity).alias("__e"), F.col(time).alias("__at"), bucket(time).alias("__slot2"))
    lag = seconds_between(F.col(time), F.col("__at"))
    on = (F.col(entity) == F.col("__e")) & (F.col("__slot") == F.col("__slot2")) & (lag > 0) & (lag <= window_seconds)
    answered = asked.join(seen, on, "left_semi").select(entity, time).distinct()
    # whether an answer came depends on entity and time alone, so equal causes stay or go together
    return join_keys(causes, answered, [entity, time], "left_anti")
