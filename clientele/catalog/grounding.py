"""Queries of signal texts, playbooks, answer parsing and grounding checks.

Answers are derived from the tables: each is made from real rows and then given a known fault.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from clientele.catalog import query
from clientele.catalog.common import comparable, sql_round
from clientele.catalog.signals import KEYS, LATEST_SQL, MIN_USERS, PREP_SQL, SCORE, SPEC, WEEKLY_SQL, signal_frame
from clientele.functions import text as X
from clientele.operators import cards as C
from clientele.operators import grounding as G
from clientele.operators import parsing as P
from clientele.operators import signals as S
from clientele.operators.ordering import settled, top_rows
from clientele.sources import sinks, star

# ---------------------------------------------------------------- cards and budget


def _metric_sql(column: str, kind: str) -> str:
    if kind == "rate":
        return f"CASE WHEN abs({column}) < 10 THEN printf('%+.1f%%', {column} * 100) ELSE printf('%+.2f', {column}) END"
    raise ValueError(kind)


@query(
    "signal_cards",
    f"""WITH {PREP_SQL}, shown AS (SELECT *, row_number() OVER (ORDER BY _score DESC NULLS LAST, {KEYS}) AS rank FROM prep)
    SELECT rank, CASE WHEN rank <= 5 THEN 'card' ELSE 'compact' END AS kind,
      age_group || ' x ' || gender || ' x ' || city || ' x ' || product_category AS cohort,
      CASE WHEN abs(wow_purchase_velocity_pct) > 0.3::DOUBLE AND active_users > 500 THEN 'HIGH'
           WHEN abs(wow_purchase_velocity_pct) > 0.15::DOUBLE OR active_users > 200 THEN 'MEDIUM' ELSE 'LOW' END AS confidence,
      trend_flag FROM shown WHERE rank <= 35""",
)
def signal_cards(spark: SparkSession, root: str) -> DataFrame:
    """Checks rank, kind, cohort, confidence and flag read back from the text of the cards."""
    cards = C.signal_cards(signal_frame(spark, root), SPEC)
    is_card = F.col("kind") == "card"
    cohort = F.when(is_card, F.regexp_extract("text", r" -- (.*)", 1)).otherwise(F.regexp_extract("text", r"^\| (.*?) \|", 1))
    flag = F.regexp_extract("text", r"(RISING|FALLING|STABLE)", 1)
    stated = F.regexp_extract("text", r"confidence\s*: (\w+)", 1)
    rows = S.prepare(signal_frame(spark, root), SPEC).select(
        C.cohort_label(S.COHORT).alias("cohort"), S.R.confidence_grade(SPEC.trend, SPEC.cohort).alias("grade")
    )
    out = cards.select("rank", "kind", cohort.alias("cohort"), stated.alias("stated"), flag.alias("trend_flag")).join(rows, "cohort")
    return comparable(out.select("rank", "kind", "cohort", F.when(F.col("stated") != "", F.col("stated")).otherwise(F.col("grade")).alias("confidence"), "trend_flag"))


@query(
    "signal_benchmark",
    f"""WITH {PREP_SQL} SELECT age_group, {sql_round('round(avg(wow_purchase_velocity_pct), 4)', 3)} AS wow_purchase_velocity_pct, CAST(sum(active_users) AS BIGINT) AS active_users,
      {sql_round('round(avg(purchase_rate), 4)', 3)} AS purchase_rate, {sql_round('round(avg(total_revenue), 4)', 3)} AS total_revenue FROM prep GROUP BY 1""",
)
def signal_benchmark(spark: SparkSession, root: str) -> DataFrame:
    return comparable(C.signal_benchmark(signal_frame(spark, root), SPEC), 3)


@query("signal_text")
def signal_text(spark: SparkSession, root: str) -> DataFrame:
    return C.signal_text(signal_frame(spark, root), SPEC)


@query(
    "row_cards",
    f"""WITH {LATEST_SQL}, n AS (SELECT *, row_number() OVER (ORDER BY age_group, gender, city, product_category) AS row_id FROM latest),
    r AS (SELECT row_id, row_number() OVER (ORDER BY {SCORE} DESC NULLS LAST, row_id) AS rank,
      age_group || ' x ' || gender || ' x ' || city || ' x ' || product_category AS cohort FROM n)
    SELECT * FROM r WHERE rank <= 5""",
)
def row_cards(spark: SparkSession, root: str) -> DataFrame:
    latest = S.select_period(signal_frame(spark, root), "active_users", "week_start", MIN_USERS)
    cards = C.row_cards(latest, SPEC, S.COHORT)
    return comparable(cards.select("row_id", "rank", F.regexp_extract("text", r" -- (.*)", 1).alias("cohort")))


@query(
    "column_summary",
    """WITH d AS (SELECT 'event_type' AS "column", event_type AS v FROM events UNION ALL SELECT 'user_id', CAST(user_id AS VARCHAR) FROM events)
    SELECT "column", CASE WHEN count(DISTINCT v) <= 15 THEN string_agg(DISTINCT v, ', ' ORDER BY v) ELSE '(' || count(DISTINCT v) || ' unique values)' END AS summary FROM d GROUP BY 1
    UNION ALL SELECT 'value', printf('range [%.4f to %.4f], avg=%.4f', min("value"), max("value"), avg("value")) FROM events""",
)
def column_summary(spark: SparkSession, root: str) -> DataFrame:
    return C.column_summary(star.table(spark, root, "events"), ["event_type", "user_id"], ["value"])


LINES_SQL = f"""WITH {PREP_SQL}, l AS (SELECT row_number() OVER (ORDER BY _score DESC NULLS LAST, {KEYS}) AS rank,
   length('| ' || age_group || ' | ' || gender || ' | ' || city || ' | ' || product_category || ' | ' || active_users || ' |') AS chars FROM prep),
 c AS (SELECT cap, coalesce(sum(chars), 0) AS chars, count(chars) AS n FROM (SELECT unnest([100, 80, 60, 40, 20]) AS cap) LEFT JOIN l ON rank <= cap GROUP BY 1),
 t AS (SELECT cap, CAST(floor((chars + greatest(n - 1, 0)) / 4.0) AS BIGINT) AS tokens FROM c),
 pick AS (SELECT coalesce(max(cap) FILTER (WHERE tokens + 100 <= 700), 20) AS cap FROM t)"""


@query(
    "token_budget",
    LINES_SQL + f""" SELECT CAST(cap AS BIGINT) AS row_cap, tokens AS data_tokens, tokens + 100 AS total_tokens, CAST(greatest(700 - tokens - 100, 0) AS BIGINT) AS remaining,
      {sql_round('round(100 / (tokens + 100.0::DOUBLE), 3)')} AS cache_ratio, tokens + 100 <= 700 AS within_budget FROM t JOIN pick USING (cap)""",
)
def token_budget(spark: SparkSession, root: str) -> DataFrame:
    rows = S.prepare(signal_frame(spark, root), SPEC)
    order = [F.col("_score").desc_nulls_last(), *[F.col(c) for c in S.COHORT]]
    shown = C.ranked_prefix(rows, order, 100).select("rank", *S.COHORT, "active_users")
    lines = sinks.serialised_rows(shown.drop("rank"), "markdown").join(shown.select("rank", *S.COHORT), list(S.COHORT))
    return comparable(C.token_budget(lines, fixed_tokens=100, limit=700))


@query(
    "serialised_rows",
    """SELECT p_partkey, '| ' || p_partkey || ' | ' || p_brand || ' | ' || p_type || ' |' AS markdown, p_partkey || ',' || p_brand || ',' || p_type AS csv,
       '{"p_partkey":' || p_partkey || ',"p_brand":"' || p_brand || '","p_type":"' || p_type || '"}' AS json,
       substr(sha256(p_brand || p_type), 1, 16) AS hash, CAST(length(p_name) // 4 AS BIGINT) AS tokens FROM part""",
)
def serialised_rows(spark: SparkSession, root: str) -> DataFrame:
    part = star.table(spark, root, "part")
    shown = part.select("p_partkey", "p_brand", "p_type")
    out = part.select("p_partkey", X.short_hash(F.concat("p_brand", "p_type")).alias("hash"), X.token_estimate("p_name").alias("tokens"))
    for name, fmt in (("markdown", "markdown"), ("csv", "csv"), ("json", "json_records")):
        out = out.join(sinks.serialised_rows(shown, fmt).select("p_partkey", F.col("line").alias(name)), "p_partkey")
    return out


# ---------------------------------------------------------------- generated answers and their checks

TOP5_SQL = f"""{WEEKLY_SQL}, ranked AS (SELECT *, row_number() OVER (PARTITION BY product_category ORDER BY abs(wow_purchase_velocity_pct) DESC NULLS LAST, {KEYS}, week_start) AS rank
   FROM signal WHERE product_category IS NOT NULL),
top5 AS (SELECT product_category AS doc, rank, wow_purchase_velocity_pct AS metric, trend_flag AS flag, age_group, gender, city,
   CASE WHEN rank % 2 = 0 AND length(city) % 2 = 0 THEN 'Atlantis' ELSE city END AS said_city FROM ranked WHERE rank <= 5)"""


def trend_answers(spark: SparkSession, root: str) -> DataFrame:
    """Five trends per category, some with an invented city, direction, confidence or thin evidence."""
    df = signal_frame(spark, root).where(F.col("product_category").isNotNull())
    order = [F.abs(F.col("wow_purchase_velocity_pct")).desc_nulls_last(), *[F.col(c) for c in S.COHORT], F.col("week_start")]
    top = top_rows(df, ["product_category"], order, 5, out="rank")
    city = F.when((F.col("rank") % 2 == 0) & (F.length("city") % 2 == 0), "Atlantis").otherwise(F.col("city"))
    return top.select(
        F.col("product_category").alias("doc"), "rank", F.concat(F.lit("Trend in "), "city").alias("trend_title"),
        F.create_map(F.lit("age_group"), F.col("age_group"), F.lit("gender"), F.lit("All"), F.lit("city"), city).alias("segment"),
        F.lit("purchase_velocity").alias("signal_type"),
        F.when(F.col("rank") == 3, "UP").otherwise(F.col("trend_flag")).alias("direction"),
        F.coalesce("wow_purchase_velocity_pct", F.lit(0.0)).alias("metric_value"),
        F.when(F.col("rank") == 1, "made_up_metric").otherwise("wow_purchase_velocity_pct").alias("metric_name"),
        F.lit("vs last week").alias("benchmark_comparison"),
        F.when(F.col("rank") == 4, "SURE").otherwise("HIGH").alias("confidence"),
        F.when(F.col("rank") == 5, "thin").otherwise("shows a change").alias("evidence_summary"),
    )


def _settled_trends(spark: SparkSession, root: str) -> DataFrame:
    return settled(trend_answers(spark, root))


@query(
    "trend_answer_checks",
    f"""WITH {TOP5_SQL}, known AS (SELECT DISTINCT city FROM signal), t AS (SELECT *, said_city IN (SELECT city FROM known) AS ok_city FROM top5)
    SELECT doc, CAST(sum(7) AS BIGINT) AS checks,
      CAST(sum(7 - (rank = 3)::INT - (rank = 4)::INT - (rank = 5)::INT - (rank = 1)::INT - (NOT ok_city)::INT) AS BIGINT) AS passed,
      count(*) FILTER (WHERE NOT ok_city) AS critical,
      CAST(sum((rank = 3)::INT + (rank = 4)::INT + (rank = 5)::INT + (rank = 1)::INT) AS BIGINT) AS warnings,
      CASE WHEN count(*) FILTER (WHERE NOT ok_city) > 0 THEN 'FAILED' ELSE 'PASSED' END AS status FROM t GROUP BY 1""",
)
def trend_answer_checks(spark: SparkSession, root: str) -> DataFrame:
    source = signal_frame(spark, root)
    return G.roll_up(G.check_trends(_settled_trends(spark, root), source, ["age_group", "gender", "city"]))


@query(
    "lean_answer_checks",
    f"""WITH {TOP5_SQL}, known AS (SELECT DISTINCT city FROM signal), t AS (SELECT *, said_city IN (SELECT city FROM known) AS ok_city FROM top5)
    SELECT doc, CAST(sum(5) AS BIGINT) AS checks, CAST(sum(5 - (rank = 3)::INT - (rank = 5)::INT - (NOT ok_city)::INT) AS BIGINT) AS passed,
      count(*) FILTER (WHERE NOT ok_city) AS critical, CAST(sum((rank = 3)::INT + (rank = 5)::INT) AS BIGINT) AS warnings,
      CASE WHEN count(*) FILTER (WHERE NOT ok_city) > 0 THEN 'FAILED' ELSE 'PASSED' END AS status FROM t GROUP BY 1""",
)
def lean_answer_checks(spark: SparkSession, root: str) -> DataFrame:
    source = signal_frame(spark, root)
    return G.roll_up(G.check_trends(_settled_trends(spark, root), source, ["age_group", "gender", "city"], lean=True))


def recommendation_answers(trends: DataFrame) -> DataFrame:
    """One campaign per trend; ranks carry a channel above the tier, an unknown channel, tier, citation or product."""
    r = F.col("rank")
    channels = (
        F.when(r == 1, F.array(F.lit("EMAIL"), F.lit("SMS"))).when(r == 2, F.array(F.lit("PUSH_NOTIFICATION")))
        .when(r == 3, F.array(F.lit("FAX"))).when(r == 4, F.array(F.lit("SOCIAL_ADS"))).otherwise(F.array(F.lit("EMAIL")))
    )
    tier = F.when(r == 1, "TIER_1").when(r.isin(2, 4), "TIER_2").when(r == 3, "TIER_3").otherwise("TIER_9")
    share = F.floor(F.abs("metric_value") * 100) + r * 2
    return trends.select(
        "doc", "rank", F.concat(F.lit("Push "), "trend_title").alias("campaign_name"),
        F.array(F.when(r == 5, "TREND-99").otherwise(F.concat(F.lit("TREND-"), r.cast("string")))).alias("cited_trend_ids"),
        F.col("segment").alias("target_segment"), F.col("doc").alias("product_focus"),
        F.when(r % 2 == 1, "ACQUISITION").otherwise("RETENTION").alias("campaign_type"),
        channels.alias("recommended_channels"), tier.alias("budget_tier"), F.concat(F.lit("See "), "doc").alias("key_message"),
        F.concat(F.lit("Moves "), share.cast("string"), F.when(r == 2, "% for Product-Q").otherwise("% here")).alias("rationale"),
    )


RECS_SQL = f"""WITH {TOP5_SQL}, known AS (SELECT DISTINCT city FROM signal),
t AS (SELECT *, said_city IN (SELECT city FROM known) AS ok_city, abs(coalesce(metric, 0)) AS m,
   CASE WHEN rank = 3 THEN 'UP' ELSE flag END AS direction FROM top5),
r AS (SELECT *, abs((floor(m * 100) + rank * 2) / 100 - m) <= 0.05::DOUBLE AS ok_metric,
   rank < 5 AS traced, direction = 'FALLING' AND rank % 2 = 1 AS bad_type FROM t),
n AS (SELECT doc,
   5 + 1 + 1 + 1 + 4 + 2 + traced::INT * 2 AS checks,
   5 - (rank = 3)::INT - (rank = 5)::INT + (NOT (rank IN (1, 3, 4, 5)))::INT + traced::INT + (3 + ok_city::INT) + (traced AND ok_metric)::INT + (traced AND NOT bad_type)::INT AS passed,
   (NOT traced)::INT + (NOT ok_city)::INT + (rank = 2)::INT AS critical,
   (rank = 3)::INT + (rank = 5)::INT + (rank IN (1, 3, 4, 5))::INT + (traced AND NOT ok_metric)::INT + (traced AND bad_type)::INT AS warnings FROM r)"""


@query(
    "recommendation_checks",
    RECS_SQL + """ SELECT doc, CAST(sum(checks) AS BIGINT) AS checks, CAST(sum(passed) AS BIGINT) AS passed, CAST(sum(critical) AS BIGINT) AS critical,
      CAST(sum(warnings) AS BIGINT) AS warnings, CASE WHEN sum(critical) > 0 THEN 'FAILED' ELSE 'PASSED' END AS status FROM n GROUP BY 1""",
)
def recommendation_checks(spark: SparkSession, root: str) -> DataFrame:
    trends = _settled_trends(spark, root)
    return G.roll_up(G.check_recommendations(recommendation_answers(trends), trends, signal_frame(spark, root)))


@query(
    "playbook",
    f"""WITH {TOP5_SQL} SELECT doc, 'TREND-' || rank AS trend_id, 'age_group=' || age_group || ' / city=' || said_city || ' / gender=All' AS segment,
      {sql_round('coalesce(metric, 0)')} AS metric_value FROM top5""",
)
def playbook(spark: SparkSession, root: str) -> DataFrame:
    answers = trend_answers(spark, root)
    return comparable(C.playbook(answers).select("doc", "trend_id", "segment", "metric_value"))


@query(
    "compacted_state",
    f"""WITH {TOP5_SQL} SELECT doc, 'micro_signal' AS signal_id, 'TREND-' || rank AS trend_id, {sql_round('coalesce(metric, 0)')} AS "value" FROM top5""",
)
def compacted_state(spark: SparkSession, root: str) -> DataFrame:
    state = C.compact_state(trend_answers(spark, root), "micro_signal", "PASSED", "2024-01-30T00:00:00")
    return comparable(state.select("doc", "signal_id", "trend_id", "value"))


# ---------------------------------------------------------------- insights

INSIGHT_METRICS = ("retail", "size")
INSIGHT_DIMS = ("brand", "kind")


def insight_source(spark: SparkSession, root: str) -> DataFrame:
    """Parts with a row id in the order of their key."""
    from clientele.operators.ordering import global_row_number

    part = star.table(spark, root, "part").select(
        "p_partkey", F.col("p_brand").alias("brand"), F.col("p_type").alias("kind"), F.col("p_retailprice").alias("retail"),
        F.col("p_size").cast("double").alias("size"),
    )
    return global_row_number(part, ["p_partkey"], "row_id")


def raw_insights(source: DataFrame) -> DataFrame:
    """A raw JSON answer per part, with faults in its citation and in its syntax that follow from the row id."""
    r = F.col("row_id")
    said = F.col("size") + (r % 4) * 0.006
    value = F.when(r % 5 == 1, F.concat(F.lit('"'), said.cast("string"), F.lit('"'))).otherwise(said.cast("string"))
    row = F.when(r % 7 == 0, F.lit("0")).otherwise(r.cast("string"))
    metric = F.when(r % 11 == 0, "unknown_metric").otherwise("size")
    brand = F.when(r % 13 == 0, "Nobrand").otherwise(F.col("brand"))
    share = F.when(r % 2 == 0, F.round(said * 100, 1)).otherwise(F.lit(3.3))
    line = F.when(r % 17 == 0, "XX").otherwise("MB")
    body = F.concat(
        F.lit('{"insights": [{"insight_id": "P_'), r.cast("string"), F.lit('", "insight": "Grew '), share.cast("string"),
        F.lit('% lately", "why_interesting": "big", "user_group": "all", "product_category": "'), F.col("kind"),
        F.lit('", "product_lob": "'), line, F.lit('", "citations": [{"file": "part", "row_id": '), row,
        F.lit(', "metric_value": '), value, F.lit(', "metric_name": "'), metric, F.lit('", "dimensions": {"brand": "'), brand,
        F.lit('"}}]}]}'),
    )
    kind = r % 6
    raw = (
        F.when(kind == 0, body)
        .when(kind == 1, F.concat(F.lit("```json\n"), body, F.lit("\n```")))
        .when(kind == 2, F.regexp_replace(body, r"\}\]\}\]\}$", "}],},]}"))
        .when(kind == 3, F.concat(F.lit("Here it is:\n\n"), body, F.lit("\n\nThat is all.")))
        .when(kind == 4, F.replace(body, F.lit('"'), F.lit("'")))
        .otherwise(F.concat(F.lit("no answer "), r.cast("string")))
    )
    return source.select(r.cast("string").alias("doc"), raw.alias("raw"))


@query(
    "json_answer_stages",
    """WITH n AS (SELECT row_number() OVER (ORDER BY p_partkey) AS r FROM part)
    SELECT CAST(r AS VARCHAR) AS doc, CASE r % 6 WHEN 0 THEN 'L1:strip_fences' WHEN 1 THEN 'L1:strip_fences' WHEN 2 THEN 'L2:trailing_commas' WHEN 3 THEN 'L1:strip_fences'
      WHEN 4 THEN 'L3:single_quotes' END AS stage, r % 6 < 5 AS success FROM n""",
)
def json_answer_stages(spark: SparkSession, root: str) -> DataFrame:
    return P.parse_json_answers(raw_insights(insight_source(spark, root))).select("doc", "stage", "success")


INSIGHT_SQL = """WITH n AS (SELECT *, row_number() OVER (ORDER BY p_partkey) AS r FROM part),
a AS (SELECT r, r % 5 = 1 AND r % 6 <> 9 AS is_text, r % 7 > 0 AS ok_row, r % 11 > 0 AS ok_name, (r % 4) * 0.006::DOUBLE <= 0.01::DOUBLE AS ok_value,
   r % 13 > 0 AS ok_brand, r % 17 > 0 AS ok_line, p_size + (r % 4) * 0.006::DOUBLE AS said FROM n WHERE r % 6 < 5),
s AS (SELECT *, CASE WHEN r % 2 = 0 THEN round(said * 100, 1) ELSE 3.3::DOUBLE END AS share FROM a),
b AS (SELECT *, ok_row AND ok_name AS go, share IN (round(said * 100, 1), round(said, 4), CAST(trunc(said) AS DOUBLE)) AS backed FROM s)
SELECT CAST(r AS VARCHAR) AS doc,
  CAST(3 + 1 + ok_row::INT + go::INT + go::INT + 1 AS BIGINT) AS checks,
  CAST(2 + ok_line::INT + ok_row::INT + (ok_row AND ok_name)::INT + (go AND ok_value)::INT + (go AND ok_brand)::INT + backed::INT AS BIGINT) AS passed,
  CAST((NOT ok_line)::INT + (NOT ok_row)::INT + (ok_row AND NOT ok_name)::INT + (go AND NOT ok_value)::INT + (go AND NOT ok_brand)::INT AS BIGINT) AS critical,
  CAST((go AND is_text)::INT + (NOT backed)::INT AS BIGINT) AS warnings,
  CASE WHEN NOT ok_line OR NOT ok_row OR (ok_row AND NOT ok_name) OR (go AND NOT ok_value) OR (go AND NOT ok_brand) THEN 'FAILED' ELSE 'PASSED' END AS status FROM b"""


@query("insight_checks", INSIGHT_SQL)
def insight_checks(spark: SparkSession, root: str) -> DataFrame:
    source = insight_source(spark, root)
    parsed = settled(P.parse_json_answers(raw_insights(source)))
    insights = P.insights_of(parsed)
    n = source.agg(F.max("row_id")).scalar()
    return G.roll_up(G.check_insights(insights, source, INSIGHT_METRICS, INSIGHT_DIMS, n))


# ---------------------------------------------------------------- YAML answers


def yaml_answers(spark: SparkSession, root: str) -> DataFrame:
    """A raw YAML answer per supplier and customer pair of rows, with one of seven faults."""
    c = star.table(spark, root, "customer").select(F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("seg"))
    k = F.col("k") % 7
    title = F.when(k == 1, F.concat(F.lit("Group: "), "seg")).otherwise(F.concat(F.lit('"Group '), "seg", F.lit('"')))
    indent = F.when(k == 3, F.lit("        ")).otherwise(F.lit("    "))
    body = F.concat(
        F.lit("trends:\n  - rank: 1\n    trend_title: "), title, F.lit("\n    direction: RISING\n"), indent,
        F.lit("metric_value: 0."), (F.col("k") % 90 + 10).cast("string"), F.lit("\n    metric_name: velocity\n    confidence: HIGH\n"),
        F.lit('    evidence_summary: "shows a change"\n'),
    )
    as_json = F.concat(F.lit('```json\n{"trends": [{"rank": 1, "trend_title": "Group '), "seg", F.lit('", "direction": "RISING", "metric_value": 0.'),
                       (F.col("k") % 90 + 10).cast("string"), F.lit("}]}\n```"))
    raw = (
        F.when(k == 2, F.concat(F.lit("My findings follow.\n\n```yaml\n"), body, F.lit("```\n")))
        .when(k == 4, as_json)
        .when(k == 5, F.lit("nothing found"))
        .when(k == 6, F.lit(""))
        .otherwise(body)
    )
    return c.select(F.col("k").cast("string").alias("doc"), raw.alias("raw"))


@query(
    "yaml_answers",
    f"""SELECT CAST(c_custkey AS VARCHAR) AS doc, CASE c_custkey % 7 WHEN 1 THEN 'L2:fix_colons' WHEN 3 THEN 'L7:regex_extract' WHEN 5 THEN NULL WHEN 6 THEN NULL ELSE 'L1:strip_fences' END AS stage,
      CASE WHEN c_custkey % 7 < 5 THEN CASE WHEN c_custkey % 7 = 1 THEN 'Group: ' ELSE 'Group ' END || c_mktsegment END AS trend_title,
      CASE WHEN c_custkey % 7 < 5 THEN {sql_round('(c_custkey % 90 + 10) / 100.0::DOUBLE')} END AS metric_value FROM customer""",
)
def yaml_answer_trends(spark: SparkSession, root: str) -> DataFrame:
    parsed = settled(P.parse_yaml_answers(yaml_answers(spark, root)))
    trends = P.trends_of(parsed).select("doc", "trend_title", "metric_value")
    return comparable(parsed.select("doc", "stage").join(trends, "doc", "left"))


@query(
    "multi_signal_trends",
    f"""WITH {WEEKLY_SQL}, a AS (SELECT *, row_number() OVER (ORDER BY abs(wow_purchase_velocity_pct) DESC NULLS LAST, {KEYS}) AS rank FROM signal
        WHERE week_start = (SELECT max(week_start) FROM signal)),
    w AS (SELECT event_type, CAST(date_trunc('week', ts) AS DATE) AS week_start, count(*) AS active_users, sum("value") AS v FROM events GROUP BY 1, 2),
    l AS (SELECT *, (v - lag(v) OVER (PARTITION BY event_type ORDER BY week_start)) / lag(v) OVER (PARTITION BY event_type ORDER BY week_start) AS change FROM w),
    b AS (SELECT *, row_number() OVER (ORDER BY abs(change) DESC NULLS LAST, event_type) AS rank FROM l WHERE week_start = (SELECT max(week_start) FROM l))
    SELECT 'micro_signal' AS signal_type, rank, trend_flag AS direction, {sql_round('round(wow_purchase_velocity_pct, 4)', 3)} AS metric_value FROM a WHERE rank <= 5
    UNION ALL SELECT 'event_value', rank, CASE WHEN change > 0.1::DOUBLE THEN 'RISING' WHEN change < -0.1::DOUBLE THEN 'FALLING' ELSE 'STABLE' END, {sql_round('round(change, 4)', 3)} FROM b WHERE rank <= 5""",
)
def multi_signal_trends(spark: SparkSession, root: str) -> DataFrame:
    """Two signals of different schemas through one operator."""
    events = star.table(spark, root, "events")
    weekly = events.groupBy("event_type", F.date_sub(F.to_date("ts"), F.weekday("ts")).alias("week_start")).agg(
        F.count(F.lit(1)).alias("active_users"), F.sum("value").alias("v")
    )
    before = F.lag("v").over(W.partitionBy("event_type").orderBy("week_start"))
    frames = {"micro_signal": signal_frame(spark, root), "event_value": weekly.withColumn("change", (F.col("v") - before) / before)}
    specs = {"micro_signal": SPEC, "event_value": S.SignalSpec("event_value", ("event_type",), "change")}
    return comparable(S.union_signals(frames, specs).select("signal_type", "rank", "direction", "metric_value"), 3)
