"""Checks that trace generated answers to source rows.

Answers are tables with one row per statement. Every check yields long rows
``(doc, item, layer, field, severity, checks, passed, message)``; ``severity`` is NULL where the
check passed. A roll-up per document counts them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clientele.functions import rules as R
from clientele.functions.text import LOOSE_PERCENT_PATTERN, mentions, percents

# Required fields, campaign types, channels, tiers and the channels each tier may use.
TREND_FIELDS = (
    "rank", "trend_title", "direction", "metric_value", "metric_name", "confidence", "evidence_summary",
)
RECOMMENDATION_FIELDS = (
    "rank", "campaign_name", "cited_trend_ids", "target_segment", "product_focus", "campaign_type",
    "recommended_channels", "budget_tier", "key_message", "rationale",
)
SEGMENT_FIELDS = ("age_group", "gender", "city")
INSIGHT_FIELDS = (
    "insight_id", "insight", "why_interesting", "user_group", "product_category", "product_lob", "citations",
)
CAMPAIGN_TYPES = ("ACQUISITION", "RETENTION", "REACTIVATION", "UPSELL")
CHANNELS = ("PUSH_NOTIFICATION", "EMAIL", "SMS", "IN_APP_BANNER", "SOCIAL_ADS", "WHATSAPP")
TIER_CHANNELS = {
    "TIER_1": ("PUSH_NOTIFICATION", "IN_APP_BANNER", "EMAIL"),
    "TIER_2": ("PUSH_NOTIFICATION", "IN_APP_BANNER", "EMAIL", "SMS", "WHATSAPP"),
    "TIER_3": ("PUSH_NOTIFICATION", "IN_APP_BANNER", "EMAIL", "SMS", "WHATSAPP", "SOCIAL_ADS"),
}
PRODUCT_LINES = ("MB", "CE", "TV", "HA")

RECOMMENDATION_SCHEMA = (
    "doc string, rank int, campaign_name string, cited_trend_ids array<string>, "
    "target_segment map<string,string>, product_focus string, campaign_type string, "
    "recommended_channels array<string>, budget_tier string, key_message string, rationale string"
)
TREND_SCHEMA = (
    "doc string, rank int, trend_title string, segment map<string,string>, signal_type string, direction string, "
    "metric_value double, metric_name string, benchmark_comparison string, confidence string, evidence_summary string"
)
INSIGHT_SCHEMA = (
    "doc string, insight_id string, insight string, why_interesting string, user_group string, "
    "product_category string, product_lob string, citations array<struct<file:string,row_id:string,"
    "metric_value:string,is_text:boolean,metric_name:string,dimensions:map<string,string>>>"
)

REPORT = ("doc", "item", "layer", "field", "severity", "checks", "passed", "message")


def _literal_set(values: Sequence[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def _check(layer: str, field: str, ok: Column, severity: str, message: Column | str = "", checks: Column | int = 1) -> Column:
    ok = F.coalesce(ok, F.lit(False))
    text = message if isinstance(message, Column) else F.lit(message)
    n = checks if isinstance(checks, Column) else F.lit(checks)
    return F.struct(
        F.lit(layer).alias("layer"),
        F.lit(field).alias("field"),
        F.when(~ok, F.lit(severity)).cast("string").alias("severity"),
        n.cast("int").alias("checks"),
        F.when(ok, n).otherwise(F.lit(0)).cast("int").alias("passed"),
        F.when(~ok, text).cast("string").alias("message"),
    )


def _tally(layer: str, field: str, checks: Column, passed: Column, severity: str, message: Column | str) -> Column:
    """Several checks at once, where checks and passes are counted apart."""
    bad = F.coalesce(passed < checks, F.lit(False))
    text = message if isinstance(message, Column) else F.lit(message)
    return F.struct(
        F.lit(layer).alias("layer"), F.lit(field).alias("field"),
        F.when(bad, F.lit(severity)).cast("string").alias("severity"),
        checks.cast("int").alias("checks"), passed.cast("int").alias("passed"),
        F.when(bad, text).cast("string").alias("message"),
    )


def _notice(layer: str, field: str, message: str) -> Column:
    """A warning that is no check of its own."""
    return F.struct(
        F.lit(layer).alias("layer"), F.lit(field).alias("field"), F.lit("WARNING").alias("severity"),
        F.lit(0).alias("checks"), F.lit(0).alias("passed"), F.lit(message).alias("message"),
    )


def _missing(fields: Sequence[str]) -> Column:
    return F.filter(F.array(*[F.when(F.col(f).isNull(), F.lit(f)) for f in fields]), lambda x: x.isNotNull())


def _explode(df: DataFrame, item: Column, checks: Sequence[Column]) -> DataFrame:
    return df.select("doc", item.cast("string").alias("item"), F.inline(F.array(*checks)))


def dimension_values(source: DataFrame, dimensions: Sequence[str]) -> DataFrame:
    """Distinct (dimension, value) pairs of the data an answer was made from."""
    cells = [F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("value")) for d in dimensions]
    return source.select(F.inline(F.array(*cells))).where(F.col("value").isNotNull()).distinct()


def _segment_checks(claims: DataFrame, values: DataFrame, layer: str = "SEGMENT") -> DataFrame:
    """Claims ``(doc, item, dimension, value)`` against the values in the data, by join."""
    known = values.withColumn("__known", F.lit(True))
    joined = claims.join(known, ["dimension", "value"], "left")
    ok = F.col("__known").isNotNull() | (F.col("value") == "All")
    text = F.concat(F.lit("'"), F.col("value"), F.lit("' not in data"))
    rows = joined.select("doc", "item", "dimension", _check(layer, "", ok, "CRITICAL", text).alias("c"))
    return rows.select("doc", "item", "c.*", "dimension").select(
        "doc", "item", "layer", F.col("dimension").alias("field"), "severity", "checks", "passed", "message"
    )


def check_trends(trends: DataFrame, source: DataFrame, dimensions: Sequence[str], metrics: Sequence[str] = (),
                 lean: bool = False) -> DataFrame:
    """Structure, direction, segment, metric, confidence and evidence of trend rows.

    The lean form checks neither metric names nor confidence values.
    """
    item = F.concat(F.lit("trend["), (F.col("rank") - 1).cast("string"), F.lit("]"))
    missing = _missing(TREND_FIELDS)
    checks = [
        _check("STRUCTURE", "fields", F.size(missing) == 0, "CRITICAL", F.concat(F.lit("missing: "), F.array_join(missing, ", "))),
        _check("DIRECTION" if lean else "STRUCTURE", "direction", F.col("direction").isin(*R.DIRECTIONS), "WARNING",
               "invalid direction"),
        _check("EVIDENCE", "evidence_summary", F.length(F.coalesce("evidence_summary", F.lit(""))) >= 10, "WARNING",
               "evidence too short"),
    ]
    if not lean:
        known = set(metrics) | set(source.columns) | {"trend_flag"}
        name = F.coalesce("metric_name", F.lit(""))
        checks += [
            _check("METRIC", "metric_name", (name == "") | name.isin(*sorted(known)), "WARNING", "not a known metric"),
            _check("STRUCTURE", "confidence", F.col("confidence").isin(*R.CONFIDENCES), "WARNING", "invalid confidence"),
        ]
    plain = _explode(trends, item, checks)
    claims = (
        trends.select("doc", item.alias("item"), F.explode("segment").alias("dimension", "value"))
        .where(F.col("dimension").isin(*dimensions) & (F.col("value") != "All"))
    )
    return plain.unionByName(_segment_checks(claims, dimension_values(source, dimensions))).select(*REPORT)


def check_recommendations(recs: DataFrame, trends: DataFrame, source: DataFrame,
                          product: str = "product_category", tolerance: float = 0.05) -> DataFrame:
    """Schema, citations, segments, metric claims, business rules and product names of recommendations.

    Counts follow the original rules: a non-empty citation list adds a check of its own that no
    pass answers, and product names add one check per text but one pass per known name.
    """
    item = F.concat(F.lit("rec["), (F.col("rank") - 1).cast("string"), F.lit("]"))
    channels = F.coalesce("recommended_channels", F.array().cast("array<string>"))
    tier_map = F.create_map(*[x for t, cs in TIER_CHANNELS.items() for x in (F.lit(t), _literal_set(cs))])
    allowed = F.coalesce(
        F.try_element_at(tier_map, F.coalesce("budget_tier", F.lit("TIER_1"))), F.array().cast("array<string>")
    )
    missing = _missing(RECOMMENDATION_FIELDS)
    segment = F.coalesce("target_segment", F.create_map().cast("map<string,string>"))
    no_segment = F.array_except(_literal_set(SEGMENT_FIELDS), F.map_keys(segment))
    cited = F.coalesce("cited_trend_ids", F.array().cast("array<string>"))
    base = [
        _check("SCHEMA", "fields", F.size(missing) == 0, "CRITICAL", F.concat(F.lit("missing: "), F.array_join(missing, ", "))),
        _check("SCHEMA", "target_segment", F.size(no_segment) == 0, "WARNING", "segment incomplete"),
        _check("SCHEMA", "campaign_type", F.col("campaign_type").isin(*CAMPAIGN_TYPES), "WARNING", "invalid type"),
        _check("SCHEMA", "budget_tier", F.col("budget_tier").isin(*TIER_CHANNELS), "WARNING", "invalid tier"),
        _check("SCHEMA", "channels", F.size(F.array_except(channels, _literal_set(CHANNELS))) == 0, "WARNING", "invalid channel"),
        F.struct(
            F.lit("CITATION").alias("layer"), F.lit("cited").alias("field"),
            F.when(F.size(cited) == 0, "CRITICAL").cast("string").alias("severity"),
            F.lit(1).alias("checks"), F.lit(0).alias("passed"),
            F.when(F.size(cited) == 0, "no citations").cast("string").alias("message"),
        ),
        _check("BUSINESS", "channels", F.size(F.array_except(channels, allowed)) == 0, "WARNING", "channel above the tier"),
    ]
    out = _explode(recs, item, base)

    # citations, metric claims and direction: one joined row per cited trend
    known = trends.select(
        "doc", F.concat(F.lit("TREND-"), F.col("rank").cast("string")).alias("cited_id"),
        F.abs(F.coalesce("metric_value", F.lit(0.0))).alias("actual"), F.col("direction").alias("trend_direction"),
        F.lit(True).alias("__known"),
    )
    shares = percents(F.coalesce("rationale", F.lit("")))
    cites = recs.select("doc", item.alias("item"), "campaign_type", shares.alias("shares"),
                        F.explode("cited_trend_ids").alias("cited_id")).join(known, ["doc", "cited_id"], "left")
    hit = F.exists(F.col("shares"), lambda x: F.abs(x / 100 - F.col("actual")) <= tolerance)
    is_known = F.col("__known").isNotNull()
    traced = [
        _check("CITATION", "cited", is_known, "CRITICAL", F.concat(F.col("cited_id"), F.lit(" is not a trend"))),
        F.when(is_known & (F.size("shares") > 0), _check("METRIC", "rationale", hit, "WARNING", "no percentage matches the trend")),
        F.when(is_known, _check("BUSINESS", "type",
                                ~F.coalesce((F.col("trend_direction") == "FALLING") & (F.col("campaign_type") == "ACQUISITION"), F.lit(False)),
                                "WARNING", "acquisition on a falling trend")),
    ]
    rows = cites.select("doc", "item", F.explode(F.filter(F.array(*traced), lambda x: x.isNotNull())).alias("c"))
    out = out.unionByName(rows.select("doc", "item", "c.*"))

    # segments and product focus against the values in the data
    values = dimension_values(source, [*SEGMENT_FIELDS, product])
    parts = [F.struct(F.lit(f).alias("dimension"), F.coalesce(F.try_element_at(segment, F.lit(f)), F.lit("All")).alias("value"))
             for f in SEGMENT_FIELDS]
    parts.append(F.struct(F.lit(product).alias("dimension"), F.coalesce("product_focus", F.lit("All")).alias("value")))
    claims = recs.select("doc", item.alias("item"), F.inline(F.array(*parts)))
    out = out.unionByName(_segment_checks(claims, values))

    # product names in the texts
    texts = [F.struct(F.lit(f).alias("field"), mentions(F.coalesce(f, F.lit(""))).alias("names")) for f in ("rationale", "key_message")]
    named = recs.select("doc", item.alias("item"), F.inline(F.array(*texts)))
    products = values.where(F.col("dimension") == product).select(F.col("value").alias("name"), F.lit(True).alias("__known"))
    found = (
        named.select("doc", "item", "field", F.explode_outer("names").alias("name"))
        .join(products, "name", "left")
        .groupBy("doc", "item", "field")
        .agg(F.count("name").alias("n"), F.count("__known").alias("hits"))
    )
    unknown = F.col("n") > F.col("hits")
    return out.unionByName(found.select(
        "doc", "item", F.lit("HALLUCINATION").alias("layer"), "field",
        F.when(unknown, "CRITICAL").cast("string").alias("severity"),
        F.lit(1).alias("checks"), F.col("hits").cast("int").alias("passed"),
        F.when(unknown, "product not in data").cast("string").alias("message"),
    )).select(*REPORT)


def check_insights(insights: DataFrame, source: DataFrame, metrics: Sequence[str], dimensions: Sequence[str],
                   n_rows: Column | int, lines: Sequence[str] = PRODUCT_LINES, tolerance: float = 0.01) -> DataFrame:
    """Structure, product line and each citation of an insight: row, column, value, dimensions, percentages.

    ``source`` carries ``row_id`` (1-based). Only cited rows are joined.
    """
    n = n_rows if isinstance(n_rows, Column) else F.lit(n_rows)
    item = F.coalesce("insight_id", F.lit("?"))
    missing = _missing(INSIGHT_FIELDS)
    cited = F.coalesce(F.size("citations"), F.lit(0)) > 0
    base = [
        _check("STRUCTURE", "fields", F.size(missing) == 0, "CRITICAL", F.concat(F.lit("missing: "), F.array_join(missing, ", "))),
        _check("LINE", "product_lob", F.col("product_lob").isin(*lines), "CRITICAL", "unknown product line"),
        _check("CITATION", "citations", cited, "CRITICAL", "no citations"),
    ]
    out = _explode(insights, item, base)

    flat = insights.where(cited).select("doc", item.alias("item"), F.posexplode("citations").alias("pos", "c"))
    flat = flat.select("doc", "item", "pos", F.col("c.row_id").try_cast("bigint").alias("row_id"),
                       F.col("c.metric_name").alias("metric"), F.col("c.metric_value").alias("claim"),
                       F.coalesce("c.is_text", F.lit(False)).alias("is_text"),
                       F.col("c.dimensions").alias("dims"))
    cells = F.map_from_arrays(_literal_set(metrics), F.array(*[F.col(m).cast("double") for m in metrics]))
    places = F.map_from_arrays(_literal_set(dimensions), F.array(*[F.col(d).cast("string") for d in dimensions]))
    rows = source.select("row_id", cells.alias("cells"), places.alias("places"))
    traced = flat.join(rows, "row_id", "left").withColumn("__n", n)

    in_range = F.coalesce(F.col("row_id").between(F.lit(1), F.col("__n")), F.lit(False))
    is_column = F.coalesce(F.col("metric").isin(*metrics, *dimensions), F.lit(False))
    number = F.col("claim").try_cast("double")
    actual = F.try_element_at("cells", F.col("metric"))
    compared = F.col("claim").isNotNull() & actual.isNotNull()
    close = F.abs(actual - number) <= tolerance + 1e-12
    value_ok = ~compared | F.coalesce(close, F.lit(False))
    go = in_range & is_column
    parsed = ~compared | number.isNotNull()

    named = F.filter(F.map_keys(F.coalesce("dims", F.create_map().cast("map<string,string>"))), lambda k: k.isin(*dimensions))
    right = F.filter(named, lambda k: F.try_element_at(F.col("dims"), k) == F.try_element_at(F.col("places"), k))
    cite = [
        _check("CITATION_ROW", "row_id", in_range, "CRITICAL", "row id out of range"),
        F.when(in_range, _check("CITATION_NAME", "metric_name", is_column, "CRITICAL", "not a column of the data")),
        F.when(go & compared & F.col("is_text"), _notice("CITATION_VALUE", "metric_value", "text instead of a number")),
        F.when(go, _check("CITATION_VALUE", "metric_value", value_ok, "CRITICAL", "claim differs from the cell")),
        F.when(go & parsed & (F.size(named) > 0), _tally("CITATION_DIMS", "dimensions", F.size(named), F.size(right), "CRITICAL",
                                                        "dimension differs from the row")),
    ]
    exploded = traced.select("doc", "item", F.explode(F.filter(F.array(*cite), lambda x: x.isNotNull())).alias("c"))
    out = out.unionByName(exploded.select("doc", "item", "c.*"))

    claims = F.transform("citations", lambda c: c["metric_value"].try_cast("double"))
    claims = F.filter(claims, lambda v: v.isNotNull())
    stated = F.flatten(F.transform(claims, lambda v: F.array(F.round(v * 100, 1), F.round(v, 4), v.cast("bigint").cast("double"))))
    shares = percents(F.coalesce("insight", F.lit("")), LOOSE_PERCENT_PATTERN)
    texts = insights.where(cited).select("doc", item.alias("item"), shares.alias("shares"), stated.alias("stated"))
    backed = F.filter("shares", lambda s: F.array_contains(F.col("stated"), s) | F.array_contains(F.col("stated"), F.round(s, 1)))
    grounded = texts.where(F.size("shares") > 0).select(
        "doc", "item", _tally("GROUNDING", "insight", F.size("shares"), F.size(backed), "WARNING", "uncited percentage").alias("c")
    )
    return out.unionByName(grounded.select("doc", "item", "c.*")).select(*REPORT)


def roll_up(report: DataFrame) -> DataFrame:
    """Checks, passes, issues and status per document."""
    return report.groupBy("doc").agg(
        F.sum("checks").alias("checks"),
        F.sum("passed").alias("passed"),
        F.count_if(F.col("severity") == "CRITICAL").alias("critical"),
        F.count_if(F.col("severity") == "WARNING").alias("warnings"),
    ).withColumn("status", F.when(F.col("critical") > 0, "FAILED").otherwise("PASSED"))


def empty_documents(docs: DataFrame, statements: DataFrame) -> DataFrame:
    """Documents without any statement fail as a whole."""
    return docs.join(statements.select("doc").distinct(), "doc", "left_anti").select(
        "doc", F.lit("").alias("item"), F.lit("STRUCTURE").alias("layer"), F.lit("items").alias("field"),
        F.lit("CRITICAL").alias("severity"), F.lit(0).alias("checks"), F.lit(0).alias("passed"),
        F.lit("empty").alias("message"),
    )
