"""Queries of deviations, their relations, governed access, unified records and roll-ups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clientele.catalog import query
from clientele.catalog.common import comparable, sql_poisson, sql_round, sql_seeds
from clientele.functions.timeutil import week_start
from clientele.operators import anomaly as D
from clientele.operators import governed as V
from clientele.operators import sliding as L
from clientele.operators.ordering import settled
from clientele.sources import star

SPLIT_AT = "2024-01-25"


def _events(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    e = star.table(spark, root, "events")
    at = F.lit(SPLIT_AT).cast("timestamp_ntz")
    return e.where(F.col("ts") < at), e.where(F.col("ts") >= at)


EV = f"""base AS (SELECT * FROM events WHERE ts < TIMESTAMP '{SPLIT_AT}'), cur AS (SELECT * FROM events WHERE ts >= TIMESTAMP '{SPLIT_AT}')"""


@query(
    "field_roles",
    f"""WITH v AS (SELECT 'event_id' AS c, TRUE AS w, CAST(event_id AS VARCHAR) AS v FROM events UNION ALL SELECT 'user_id', TRUE, CAST(user_id AS VARCHAR) FROM events
      UNION ALL SELECT 'event_type', FALSE, event_type FROM events UNION ALL SELECT 'props', FALSE, props FROM events),
    n AS (SELECT c, w, v, count(*)::DOUBLE AS n FROM v WHERE v IS NOT NULL GROUP BY ALL),
    s AS (SELECT c, w, count(*) AS k, (ln(sum(n)) - sum(n * ln(n)) / sum(n)) / ln(count(*)) AS e FROM n GROUP BY ALL)
    SELECT c AS "column", k AS n_values, {sql_round('e', 3)} AS evenness,
      CASE WHEN k <= 30 THEN 'DIMENSION' WHEN e > 0.8 THEN 'ENTITY' WHEN w THEN 'METRIC' ELSE 'DIMENSION' END AS role FROM s
    UNION ALL SELECT 'ts', NULL, NULL, 'TIMESTAMP' UNION ALL SELECT 'value', NULL, NULL, 'METRIC'""",
)
def field_roles(spark: SparkSession, root: str) -> DataFrame:
    return comparable(D.field_roles(star.table(spark, root, "events")), 3)


@query(
    "robust_deviations",
    f"""WITH {EV}, m AS (SELECT event_type, quantile_cont("value", 0.5) AS med FROM base GROUP BY 1),
    d AS (SELECT event_type, quantile_cont(abs("value" - med), 0.5) AS mad FROM base JOIN m USING (event_type) GROUP BY 1)
    SELECT event_id, {sql_round('abs("value" - med) / mad')} AS z, round(abs("value" - med) / mad, 9) > 4.0 AS deviates
    FROM cur JOIN m USING (event_type) JOIN d USING (event_type)""",
)
def robust_deviations(spark: SparkSession, root: str) -> DataFrame:
    base, cur = _events(spark, root)
    return comparable(D.robust_scores(base, cur, "value", ["event_type"]).select("event_id", "z", "deviates"))


def _sliding_sql(days: int) -> str:
    frame = f"(PARTITION BY event_type ORDER BY CAST(ts AS DATE) RANGE BETWEEN INTERVAL {days} DAY PRECEDING AND INTERVAL 1 DAY PRECEDING)"
    away = 'abs("value" - med)'
    return f"""WITH w AS (SELECT *, quantile_cont("value", 0.5) OVER f AS med, mad("value") OVER f AS mad, count("value") OVER f AS n FROM events WINDOW f AS {frame})
    SELECT event_id, n AS baseline_rows, {sql_round('med')} AS median, {sql_round('mad')} AS mad, {sql_round(f'{away} / nullif(mad, 0)')} AS z,
      coalesce(CASE WHEN mad = 0 THEN {away} > 0 ELSE round({away} / mad, 9) > 4.0 END, false) AS deviates, med IS NULL AS no_baseline FROM w"""


SLIDING_SQL = _sliding_sql(L.DAYS)


def _sliding(spark: SparkSession, root: str, days: int) -> DataFrame:
    scored = L.sliding_scores(star.table(spark, root, "events"), "value", "ts", ["event_type"], days)
    return comparable(scored.select("event_id", "baseline_rows", "median", "mad", "z", "deviates", "no_baseline"))


@query("sliding_deviations", SLIDING_SQL)
def sliding_deviations(spark: SparkSession, root: str) -> DataFrame:
    """Every event against the 30 days of its kind before its own day."""
    return _sliding(spark, root, L.DAYS)


@query("sliding_deviations_7d", _sliding_sql(7))
def sliding_deviations_7d(spark: SparkSession, root: str) -> DataFrame:
    """The same over 7 days, so that days leave the range within a month of events."""
    return _sliding(spark, root, 7)


def _cut_sql(i: int) -> str:
    return f'quantile_cont("value", {i / 10}) AS q{i}'


PSI_SQL = f"""{EV}, cuts AS (SELECT event_type, {', '.join(_cut_sql(i) for i in range(1, 10))} FROM base GROUP BY 1),
binned AS (SELECT event_type, p, q, {' + '.join(f'("value" > q{i})::INT' for i in range(1, 10))} AS bin FROM
  (SELECT event_type, "value", 1.0::DOUBLE AS p, 0.0::DOUBLE AS q FROM base UNION ALL
   SELECT event_type, CASE WHEN event_type = 'view' THEN "value" * 2 ELSE "value" END, 0.0, 1.0 FROM cur) JOIN cuts USING (event_type)),
c AS (SELECT event_type, bin, sum(p) AS p, sum(q) AS q FROM binned GROUP BY 1, 2),
s AS (SELECT event_type, greatest(p / sum(p) OVER w, 1e-4::DOUBLE) AS p, greatest(q / sum(q) OVER w, 1e-4::DOUBLE) AS q FROM c WINDOW w AS (PARTITION BY event_type))"""


@query(
    "stability_index",
    f"""WITH {PSI_SQL} SELECT event_type, {sql_round('sum((q - p) * ln(q / p))')} AS psi, sum((q - p) * ln(q / p)) > 0.2 AS shifted FROM s GROUP BY 1""",
)
def stability_index(spark: SparkSession, root: str) -> DataFrame:
    base, cur = _events(spark, root)
    moved = cur.withColumn("value", F.when(F.col("event_type") == "view", F.col("value") * 2).otherwise(F.col("value")))
    return comparable(D.stability_index(base, moved, "value", ["event_type"]))


@query(
    "share_drift",
    f"""WITH {EV}, c2 AS (SELECT CASE WHEN event_type = 'view' AND event_id % 2 = 0 THEN 'click' ELSE event_type END AS event_type FROM cur),
    k AS (SELECT event_type, count(*) FILTER (WHERE b = 1) AS b, count(*) FILTER (WHERE b = 0) AS c FROM
      (SELECT event_type, 1 AS b FROM base UNION ALL SELECT event_type, 0 FROM c2) GROUP BY 1)
    SELECT event_type, {sql_round('b / sum(b) OVER ()')} AS baseline_share, {sql_round('c / sum(c) OVER ()')} AS current_share,
      abs(c / sum(c) OVER () - b / sum(b) OVER ()) > 0.15 AS drifted FROM k""",
)
def share_drift(spark: SparkSession, root: str) -> DataFrame:
    base, cur = _events(spark, root)
    swap = (F.col("event_type") == "view") & (F.col("event_id") % 2 == 0)
    moved = cur.withColumn("event_type", F.when(swap, "click").otherwise(F.col("event_type")))
    return comparable(D.share_drift(base, moved, "event_type"))


def _unusual(spark: SparkSession, root: str) -> DataFrame:
    e = star.table(spark, root, "events")
    kind, k = F.col("event_type"), F.get_json_object("props", "$.k").cast("int")
    stratum = F.when(kind == "error", "S0").when(kind == "view", "S1").when(kind == "purchase", "S2")
    return e.where(kind.isin("error", "view", "purchase")).select(
        stratum.alias("stratum"), kind.alias("metric"), (k % 5).cast("string").alias("zone"), "user_id", "ts", "value",
        F.to_date("ts").alias("day"),
    )


def weekly_deviations(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """One deviation per kind, week and group of users, of all its events, and ``(dev_id, entity)`` for each of its users."""
    kind = F.col("event_type")
    stratum = F.when(kind == "error", "S0").when(kind == "view", "S1").when(kind == "purchase", "S2")
    rows = star.table(spark, root, "events").where(kind.isin("error", "view", "purchase")).select(
        stratum.alias("stratum"), kind.alias("metric"), (F.col("user_id") % 5).cast("string").alias("zone"), "user_id", "ts", "value",
        week_start("ts").cast("string").alias("week"),
    )
    rows = rows.withColumn("dev_id", F.concat_ws("/", "stratum", "week", "zone"))
    cells = rows.groupBy("dev_id", "stratum", "metric", "zone").agg(
        F.min("ts").alias("start_ts"), F.max("ts").alias("end_ts"), F.max("value").alias("magnitude"))
    users = rows.where(F.col("user_id").isNotNull()).select("dev_id", F.col("user_id").cast("string").alias("entity")).distinct()
    return settled(cells.withColumn("locus", F.create_map(F.lit("zone"), F.col("zone")))), settled(users)


WEEK_SQL = """r AS (SELECT CASE event_type WHEN 'error' THEN 'S0' WHEN 'view' THEN 'S1' ELSE 'S2' END AS stratum, event_type AS metric,
    CAST(user_id % 5 AS VARCHAR) AS zone, user_id, ts, "value" AS v, strftime(date_trunc('week', ts), '%Y-%m-%d') AS week
  FROM events WHERE event_type IN ('error', 'view', 'purchase')),
dev AS (SELECT concat_ws('/', stratum, week, zone) AS dev_id, stratum, metric, zone, min(ts) AS s, max(ts) AS e, max(v) AS magnitude,
               list(DISTINCT CAST(user_id AS VARCHAR)) FILTER (user_id IS NOT NULL) AS ents FROM r GROUP BY stratum, metric, week, zone)"""


@query(
    "deviation_records",
    f"""WITH {WEEK_SQL}, u AS (SELECT dev_id, sum(CAST('0x' || substr(md5(x), 1, 15) AS HUGEINT)) AS h FROM (SELECT dev_id, unnest(ents) AS x FROM dev) GROUP BY 1)
    SELECT dev_id, stratum, metric, {sql_round('magnitude')} AS magnitude, CAST(coalesce(len(ents), 0) AS BIGINT) AS n_entities,
      sha256(concat_ws('|', dev_id, stratum, metric, coalesce(len(ents), 0), coalesce(h, 0), epoch_us(s), epoch_us(e), CAST(round(magnitude * 1000000) AS BIGINT))) AS provenance
    FROM dev LEFT JOIN u USING (dev_id)""",
)
def deviation_records(spark: SparkSession, root: str) -> DataFrame:
    records = D.record_digests(*weekly_deviations(spark, root))
    return comparable(records.select("dev_id", "stratum", "metric", "magnitude", "n_entities", "provenance"))


PAIR_SQL = f"""WITH {WEEK_SQL}, p AS (SELECT a.dev_id AS cause, b.dev_id AS effect,
  len(list_intersect(a.ents, b.ents)) / len(list_distinct(list_concat(a.ents, b.ents)))::DOUBLE AS entity,
  exp(-power((epoch_us(b.s - a.s) / 1000000.0::DOUBLE), 2) / (2.0::DOUBLE * 21600 * 21600)) AS "time",
  CASE WHEN a.zone = b.zone THEN 1.0::DOUBLE ELSE 0 END AS dimension, 0.9::DOUBLE AS semantic
  FROM dev a JOIN dev b ON a.stratum <> b.stratum AND b.s >= a.s AND b.s <= a.s + INTERVAL 1 DAY
  WHERE len(list_intersect(a.ents, b.ents)) > 0),
sc AS (SELECT *, entity * 0.38::DOUBLE + "time" * 0.28::DOUBLE + dimension * 0.14::DOUBLE + semantic * 0.2::DOUBLE AS score FROM p),
ed AS (SELECT DISTINCT cause, effect FROM sc WHERE round(score, 9) >= {D.PAIR_LIMIT})"""


def _scored(spark: SparkSession, cells: DataFrame, users: DataFrame) -> DataFrame:
    names = ["error", "view", "purchase"]
    pairs = [(a, b, 0.9) for a in names for b in names if a != b]
    affinity = spark.createDataFrame(pairs, "metric_a string, metric_b string, similarity double")
    return D.pair_scores(cells, spread_seconds=21_600.0, affinity=affinity, members=users)


@query(
    "deviation_pairs",
    PAIR_SQL + f""" SELECT cause, effect, {sql_round('entity')} AS entity, {sql_round('"time"')} AS "time", {sql_round('dimension')} AS dimension,
      {sql_round('semantic')} AS semantic, {sql_round('score')} AS score FROM sc WHERE round(score, 9) >= {D.PAIR_LIMIT}""",
)
def deviation_pairs(spark: SparkSession, root: str) -> DataFrame:
    """Pairs that reach the stated limit, over all users of each week and group."""
    return comparable(_scored(spark, *weekly_deviations(spark, root)))


@query(
    "root_causes",
    PAIR_SQL.replace("WITH ", "WITH RECURSIVE ", 1) + """, mem AS (SELECT dev_id, unnest(ents) AS x FROM dev),
    walk AS (SELECT DISTINCT cause AS root, cause AS node, x, 0 AS depth FROM ed JOIN mem ON dev_id = cause WHERE cause NOT IN (SELECT effect FROM ed)
      UNION SELECT root, effect, w.x, depth + 1 FROM walk w JOIN ed ON ed.cause = w.node JOIN mem m ON m.dev_id = effect AND m.x = w.x)
    SELECT root, node, x AS entity, CAST(min(depth) AS BIGINT) AS depth FROM walk GROUP BY root, node, x""",
)
def root_causes(spark: SparkSession, root: str) -> DataFrame:
    """What each root's chains have in common, one row per entity."""
    cells, users = weekly_deviations(spark, root)
    scored = settled(_scored(spark, cells, users))
    out = D.chain_entities(scored, users.withColumnRenamed("dev_id", "node"))
    return out.select("root", "node", "entity", F.col("depth").cast("bigint").alias("depth"))


# ---------------------------------------------------------------- the same over all users of a day and zone


WHOLE_SQL = """r AS (SELECT CASE event_type WHEN 'error' THEN 'S0' WHEN 'view' THEN 'S1' ELSE 'S2' END AS stratum, event_type AS metric,
    CAST(CAST(json_extract_string(props, '$.k') AS INTEGER) % 5 AS VARCHAR) AS zone, user_id, ts, "value" AS v, CAST(ts AS DATE) AS day
  FROM events WHERE event_type IN ('error', 'view', 'purchase')),
dev AS (SELECT stratum || '/' || day || '/' || zone AS dev_id, stratum, metric, zone, min(ts) AS s, max(ts) AS e, max(v) AS magnitude,
               list(DISTINCT CAST(user_id AS VARCHAR)) AS ents FROM r GROUP BY stratum, metric, day, zone)"""
WHOLE_PAIR_SQL = PAIR_SQL.replace(WEEK_SQL, WHOLE_SQL)


def whole_deviations(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """One deviation per (kind, day, zone) of all its events, and ``(dev_id, entity)`` for each of its users."""
    name = F.concat_ws("/", "stratum", F.col("day").cast("string"), "zone")
    rows = _unusual(spark, root).withColumn("dev_id", name)
    cells = rows.groupBy("dev_id", "stratum", "metric", "day", "zone").agg(
        F.min("ts").alias("start_ts"), F.max("ts").alias("end_ts"), F.max("value").alias("magnitude"))
    users = rows.where(F.col("user_id").isNotNull()).select("dev_id", F.col("user_id").cast("string").alias("entity")).distinct()
    return settled(cells.withColumn("locus", F.create_map(F.lit("zone"), F.col("zone")))), settled(users)


@query(
    "deviation_records_whole",
    f"""WITH {WHOLE_SQL} SELECT dev_id, stratum, metric, {sql_round('magnitude')} AS magnitude, CAST(len(ents) AS BIGINT) AS n_entities, CAST(64 AS BIGINT) AS hash_length FROM dev""",
)
def deviation_records_whole(spark: SparkSession, root: str) -> DataFrame:
    """The record's hash covers its users by their number and the sum of their hashes, not by one list."""
    cells, users = whole_deviations(spark, root)
    part = F.conv(F.substring(F.md5("entity"), 1, 15), 16, 10).cast("decimal(20,0)")
    known = users.groupBy("dev_id").agg(F.count(F.lit(1)).alias("n_entities"), F.sum(part).alias("users"))
    out = cells.join(known, "dev_id", "left").withColumn("n_entities", F.coalesce("n_entities", F.lit(0)))
    body = F.struct("stratum", "metric", "n_entities", "users", "start_ts", "end_ts", "locus", "magnitude")
    return comparable(out.select("dev_id", "stratum", "metric", "magnitude", "n_entities", F.length(F.sha2(F.to_json(body), 256)).alias("hash_length")))


def _scored_whole(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    cells, users = whole_deviations(spark, root)
    return _scored(spark, cells, users), users


@query(
    "deviation_pairs_whole",
    WHOLE_PAIR_SQL + f""" SELECT cause, effect, {sql_round('entity')} AS entity, {sql_round('"time"')} AS "time", {sql_round('dimension')} AS dimension,
      {sql_round('semantic')} AS semantic, {sql_round('score')} AS score FROM sc WHERE round(score, 9) >= {D.PAIR_LIMIT}""",
)
def deviation_pairs_whole(spark: SparkSession, root: str) -> DataFrame:
    """Pairs that reach the stated limit."""
    return comparable(_scored_whole(spark, root)[0])


@query(
    "root_causes_whole",
    WHOLE_PAIR_SQL.replace("WITH ", "WITH RECURSIVE ", 1) + """,
    walk AS (SELECT DISTINCT cause AS root, cause AS node, list_sort(ents) AS ents, 0 AS depth FROM ed JOIN dev ON dev_id = cause WHERE cause NOT IN (SELECT effect FROM ed)
      UNION SELECT root, effect, list_sort(list_intersect(w.ents, d.ents)), depth + 1 FROM walk w JOIN ed ON ed.cause = w.node JOIN dev d ON d.dev_id = effect
      WHERE len(list_intersect(w.ents, d.ents)) > 0)
    SELECT root, node, CAST(min(depth) AS BIGINT) AS depth, array_to_string(ents, ',') AS entities FROM walk GROUP BY root, node, ents""",
)
def root_causes_whole(spark: SparkSession, root: str) -> DataFrame:
    """Only deviations of a pair carry their users along the chains."""
    scored, users = _scored_whole(spark, root)
    scored = settled(scored)
    linked = scored.select(F.col("cause").alias("dev_id")).union(scored.select("effect")).distinct()
    nodes = users.join(linked, "dev_id", "left_semi").groupBy(F.col("dev_id").alias("node")).agg(F.collect_list("entity").alias("entities"))
    out = D.root_causes(scored, nodes)
    return out.select("root", "node", F.col("depth").cast("bigint").alias("depth"), F.array_join(F.array_sort("entities"), ",").alias("entities"))


@query(
    "missing_responses",
    """WITH c AS (SELECT * FROM events WHERE event_type = 'error'), f AS (SELECT * FROM events WHERE event_type = 'click')
    SELECT event_id, user_id FROM c WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.user_id = c.user_id AND f.ts > c.ts AND f.ts <= c.ts + INTERVAL 6 HOUR)""",
)
def missing_responses(spark: SparkSession, root: str) -> DataFrame:
    e = star.table(spark, root, "events")
    causes = e.where("event_type = 'error'").select("event_id", "user_id", "ts")
    effects = e.where("event_type = 'click'").select("user_id", "ts")
    return D.missing_responses(causes, effects, "user_id", "ts", 6 * 3600).select("event_id", "user_id")


def flagged_lines(spark: SparkSession, root: str) -> DataFrame:
    li = star.table(spark, root, "lineitem")
    planted = (F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "F") & (F.col("l_linenumber") == 3)
    noise = (F.col("l_orderkey") * 31 + F.col("l_partkey") * 17) % 50 == 0
    return li.select("l_returnflag", "l_linestatus", "l_linenumber", F.floor(F.col("l_quantity") / 10).alias("size"), (planted | noise).alias("bad"))


LEVEL1 = " UNION ALL ".join(f"SELECT '{d}=' || {d} AS slice, bad FROM f" for d in ("l_returnflag", "l_linestatus", "l_linenumber", "size"))


@query(
    "drill_down_first_level",
    f"""WITH f AS (SELECT l_returnflag, l_linestatus, l_linenumber, CAST(floor(l_quantity / 10) AS BIGINT) AS size,
      CASE WHEN (l_returnflag = 'R' AND l_linestatus = 'F' AND l_linenumber = 3) OR (l_orderkey * 31 + l_partkey * 17) % 50 = 0 THEN 1 ELSE 0 END AS bad FROM lineitem),
    b AS (SELECT avg(bad) AS r FROM f), s AS (SELECT slice, count(*) AS n, CAST(sum(bad) AS BIGINT) AS flagged FROM ({LEVEL1}) GROUP BY 1 HAVING count(*) >= 5),
    g AS (SELECT slice, n, flagged, flagged / n::DOUBLE / r AS concentration,
      CASE WHEN flagged > 0 THEN flagged * log2(flagged / n::DOUBLE / r) ELSE 0 END - log2(4.0::DOUBLE) AS score FROM s, b)
    SELECT CAST(1 AS BIGINT) AS depth, slice, n, flagged, {sql_round('concentration')} AS concentration, {sql_round('score')} AS score FROM g ORDER BY round(score, 6) DESC, slice LIMIT 5""",
)
def drill_down_first_level(spark: SparkSession, root: str) -> DataFrame:
    dims = ["l_returnflag", "l_linestatus", "l_linenumber", "size"]
    return comparable(D.drill_down(flagged_lines(spark, root), "bad", dims, depth=1))


@query("drill_down")
def drill_down(spark: SparkSession, root: str) -> DataFrame:
    dims = ["l_returnflag", "l_linestatus", "l_linenumber", "size"]
    return comparable(D.drill_down(flagged_lines(spark, root), "bad", dims, depth=3))


@query(
    "cause_ablation",
    f"""WITH r AS (SELECT event_id, user_id, CASE WHEN ts >= TIMESTAMP '{SPLIT_AT}' THEN 1 ELSE 0 END AS cur,
        CASE WHEN ts >= TIMESTAMP '{SPLIT_AT}' AND user_id % 10 = 0 THEN "value" * 6 ELSE "value" END AS v FROM events),
    z AS (SELECT cur, v, user_id % 10 = 0 AS c, {sql_seeds('event_id')} FROM r),
    d AS (SELECT rep, cur, v, c, CASE WHEN rep = 0 THEN 1 ELSE {sql_poisson('rep')} END AS w FROM z, (SELECT unnest(range(0, 201)) AS rep)),
    e AS (SELECT rep, sum(w * v) FILTER (WHERE cur = 1) / sum(w) FILTER (WHERE cur = 1) - sum(w * v) FILTER (WHERE cur = 0) / sum(w) FILTER (WHERE cur = 0) AS f,
        sum(w * v) FILTER (WHERE cur = 1 AND NOT c) / sum(w) FILTER (WHERE cur = 1 AND NOT c)
          - sum(w * v) FILTER (WHERE cur = 0 AND NOT c) / sum(w) FILTER (WHERE cur = 0 AND NOT c) AS x FROM d GROUP BY 1),
    g AS (SELECT rep, f, x, 1 - abs(x) / abs(f) AS red FROM e),
    o AS (SELECT max(f) FILTER (WHERE rep = 0) AS f, max(x) FILTER (WHERE rep = 0) AS x, max(red) FILTER (WHERE rep = 0) AS red,
        quantile_cont(red, 0.025) FILTER (WHERE rep > 0) AS lo, quantile_cont(red, 0.975) FILTER (WHERE rep > 0) AS hi FROM g)
    SELECT {sql_round('f', 3)} AS effect, {sql_round('x', 3)} AS effect_without, {sql_round('red', 3)} AS reduction, {sql_round('lo', 3)} AS ci_95_lower,
      {sql_round('hi', 3)} AS ci_95_upper, red > 0.3 AND lo > 0.3 AS passed FROM o""",
)
def cause_ablation(spark: SparkSession, root: str) -> DataFrame:
    cur = F.col("ts") >= F.lit(SPLIT_AT).cast("timestamp_ntz")
    rows = star.table(spark, root, "events").select(
        "event_id", "user_id", cur.alias("cur"),
        F.when(cur & (F.col("user_id") % 10 == 0), F.col("value") * 6).otherwise(F.col("value")).alias("v"),
    )
    causes = star.table(spark, root, "customer").where("c_custkey % 10 = 0").select(F.col("c_custkey").alias("user_id"))
    out = D.ablation(rows, causes, "event_id", "user_id", "v", "cur")
    return comparable(out, 3)


# ---------------------------------------------------------------- governed access


def _people(spark: SparkSession, root: str) -> DataFrame:
    return star.table(spark, root, "customer").select(
        F.col("c_custkey").alias("customer_id"), "c_name", "c_mktsegment", "c_nationkey", F.col("c_acctbal").alias("clv"),
        (F.col("c_custkey") * 37 % 101 / 100.0).alias("propensity"),
    )


@query(
    "governed_request",
    f"""SELECT c_custkey AS customer_id, c_mktsegment, CAST(c_nationkey AS BIGINT) AS c_nationkey, {sql_round('c_custkey * 37 % 101 / 100.0::DOUBLE')} AS propensity
    FROM customer WHERE c_acctbal > 1000 AND c_nationkey < 10 ORDER BY c_custkey * 37 % 101 DESC, c_custkey LIMIT 100""",
)
def governed_request(spark: SparkSession, root: str) -> DataFrame:
    catalog = {"customer": V.Entity(
        _people(spark, root), "customer_id", {"market": "c_mktsegment", "nation": "c_nationkey"},
        {"upgrade_propensity": "propensity"}, {("segment", "premium"): F.col("clv") > V.PREMIUM_CLV},
    )}
    request = {
        "entity": "customer", "metric": "upgrade_propensity", "sort": "desc", "limit": 100,
        "filters": [{"field": "segment", "op": "=", "value": "premium"}, {"field": "nation", "op": "<", "value": 10}],
    }
    return comparable(V.governed_request(catalog, request))


@query(
    "governed_rules",
    """WITH t AS (SELECT DISTINCT o_custkey FROM orders WHERE o_orderdate > TIMESTAMP '2001-07-01' - INTERVAL 30 DAY AND o_orderdate <= TIMESTAMP '2001-07-01')
    SELECT c_custkey AS customer_id, c_acctbal > 1000 AS premium, c_custkey * 37 % 101 / 100.0::DOUBLE > 0.75::DOUBLE AS upgrade_candidate,
      c_custkey NOT IN (SELECT o_custkey FROM t) AS campaign_eligible FROM customer""",
)
def governed_rules(spark: SparkSession, root: str) -> DataFrame:
    contacts = star.table(spark, root, "orders").select(F.col("o_custkey").alias("customer_id"), F.col("o_orderdate").alias("contacted_at"))
    out = V.governed_rules(_people(spark, root), contacts, F.lit("2001-07-01").cast("timestamp_ntz"))
    return out.select("customer_id", "premium", "upgrade_candidate", "campaign_eligible")


@query(
    "secured_customers",
    """SELECT c_custkey AS customer_id, sha256('check:' || sha256('check:' || c_name)) AS c_name, c_mktsegment FROM customer WHERE c_nationkey < 5""",
)
def secured_customers(spark: SparkSession, root: str) -> DataFrame:
    rules = {"analyst": F.col("c_nationkey") < 5, "admin": F.lit(True)}
    out = V.secured(_people(spark, root), "analyst", rules, ["c_name"], ["admin"], "check")
    return out.select("customer_id", "c_name", "c_mktsegment")


def crm_records(spark: SparkSession, root: str) -> DataFrame:
    """Customer records of two systems: chains of shared phone and mail keys of up to four records."""
    k = F.col("c_custkey")
    return star.table(spark, root, "customer").select(
        k.alias("record"), (F.floor(k / 2) * 7).cast("string").alias("phone"),
        F.when(k % 4 == 0, F.lit(None)).otherwise(F.concat(F.lit(" User"), F.floor((k + 1) / 2).cast("string"), F.lit("@X.com"))).alias("mail"),
        "c_mktsegment", F.when(k % 3 > 0, F.col("c_acctbal")).alias("clv"), (k * 13 % 97).alias("updated"),
        F.when(k % 5 > 0, k % 2 == 0).alias("consent"),
    )


@query(
    "unified_customers",
    f"""WITH r AS (SELECT c_custkey AS record, (c_custkey // 4) * 4 AS customer, c_mktsegment, CASE WHEN c_custkey % 3 > 0 THEN c_acctbal END AS clv,
        c_custkey * 13 % 97 AS updated, CASE WHEN c_custkey % 5 > 0 THEN c_custkey % 2 = 0 END AS consent FROM customer)
    SELECT customer, count(*) AS records, arg_max(c_mktsegment, updated * 1000000000 + record) AS c_mktsegment,
      {sql_round('arg_max(clv, updated * 1000000000 + record) FILTER (WHERE clv IS NOT NULL)')} AS clv,
      coalesce(arg_max(consent, updated * 1000000000 + record) FILTER (WHERE consent IS NOT NULL), FALSE) AS may_contact FROM r GROUP BY 1""",
)
def unified_customers(spark: SparkSession, root: str) -> DataFrame:
    return comparable(V.unified_customers(crm_records(spark, root), "record", ["phone", "mail"], ["c_mktsegment", "clv"], "updated"))


@query(
    "score_swings",
    f"""WITH d AS (SELECT user_id, CAST(ts AS DATE) AS day, arg_max("value" / 100, epoch_us(ts)) AS score FROM events GROUP BY 1, 2),
    l AS (SELECT *, lag(score) OVER (PARTITION BY user_id ORDER BY day) AS previous FROM d)
    SELECT user_id, strftime(day, '%Y-%m-%d') AS day, {sql_round('score')} AS score, {sql_round('previous')} AS previous, {sql_round('abs(score - previous)')} AS swing
    FROM l WHERE round(abs(score - previous), 9) > 0.5""",
)
def score_swings(spark: SparkSession, root: str) -> DataFrame:
    scores = star.table(spark, root, "events").select("user_id", "ts", (F.col("value") / 100).alias("score"))
    return comparable(V.score_swings(scores, "user_id", "ts", "score"))


@query(
    "request_roll_up",
    f"""SELECT json_extract_string(props, '$.k') AS service, count(*) AS requests, count(*) FILTER (WHERE event_type = 'error') AS failures,
      {sql_round("avg(CASE WHEN event_type <> 'error' THEN 1.0 ELSE 0.0 END)")} AS success_rate, {sql_round('quantile_cont("value", 0.5)')} AS p50,
      {sql_round('quantile_cont("value", 0.95)')} AS p95, {sql_round('quantile_cont("value", 0.99)')} AS p99 FROM events GROUP BY 1""",
)
def request_roll_up(spark: SparkSession, root: str) -> DataFrame:
    log = star.table(spark, root, "events").select(
        F.get_json_object("props", "$.k").alias("service"), F.col("value").alias("latency_ms"),
        F.when(F.col("event_type") == "error", "error").otherwise("success").alias("status"),
    )
    return comparable(V.request_roll_up(log, ["service"]))
