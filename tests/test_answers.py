from clientele.operators import cards as C
from clientele.operators import grounding as G
from clientele.operators import parsing as P

OK = '{"insights": [{"insight_id": "W7", "insight": "carts fill on Sundays", "citations": []}]}'
JSON_CASES = {
    "clean": (OK, "L1:strip_fences"),
    "fences": (f"```json\n{OK}\n```", "L1:strip_fences"),
    "commas": ('{"insights": [{"insight_id": "W7", "citations": [1, 2,],},],}', "L2:trailing_commas"),
    "preamble": (f"My reading of the week is below.\n{OK}\nMore on Monday.", "L1:strip_fences"),
    "quotes": ("{'insights': [{'insight_id': 'W7', 'insight': 'late baskets'}]}", "L3:single_quotes"),
    "newline": ('{"insights": [{"insight_id": "first\nsecond", "citations": []}]}', "L5:escape_control"),
    "two objects": ('{"left": 1}\n{"right": 2}', None),
    "list": ('["only", "items"]', None),
    "hopeless": ("The table was empty, so there is no answer.", None),
    "empty": ("  ", None),
}


def test_json_stages(spark):
    df = spark.createDataFrame([(n, raw) for n, (raw, _) in JSON_CASES.items()], "doc string, raw string")
    got = {r.doc: r for r in P.parse_json_answers(df).collect()}
    assert {n: r.stage for n, r in got.items()} == {n: s for n, (_, s) in JSON_CASES.items()}
    assert got["empty"].error == "Empty input" and got["hopeless"].error.startswith("all stages failed")
    assert {r.doc for r in P.insights_of(P.parse_json_answers(df)).collect()} == {n for n, (_, s) in JSON_CASES.items() if s}


CLEAN = """trends:
  - rank: 1
    trend_title: "Boots sell in May"
    direction: FALLING
    metric_value: 0.25
    metric_name: basket_size
    confidence: LOW
    evidence_summary: "baskets of walkers lost a quarter"
remarks: "all rows read"
"""
TITLE = '"Boots sell in May"'
DEEP = CLEAN.replace("    direction", "         direction").replace("    metric_name", "      metric_name")
YAML_CASES = {
    "clean": (CLEAN, "L1:strip_fences"),
    "colons": (CLEAN.replace(TITLE, "Boots: sold in May").replace('"all rows read"', "few rows: 12 walkers"), "L2:fix_colons"),
    "fences": (f"One pattern stands out.\n```yaml\n{CLEAN}```\n", "L1:strip_fences"),
    "indent": (DEEP, "L7:regex_extract"),
    "special": (CLEAN.replace(TITLE, "Boots & laces (25% down)"), "L1:strip_fences"),
    "json": ('```json\n{"trends": [{"rank": 1, "trend_title": "Boots", "direction": "FALLING", "metric_value": 0.25}]}\n```', "L1:strip_fences"),
    "worst": ("What I found:\n```yaml\n" + DEEP.replace(TITLE, "Boots: sold") + "```\nThat is all.\n", "L7:regex_extract"),
    "hopeless": ("no pattern at all", None),
    "empty": ("", None),
}


def test_yaml_answers_of_one_partition_are_read_by_many_tasks(spark):
    from pyspark.sql import functions as F

    df = spark.range(0, 40, 1, 1).select(F.col("id").cast("string").alias("doc"), F.lit(CLEAN).alias("raw"))
    parsed = P.parse_yaml_answers(df)
    assert parsed.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions")) > 1
    assert parsed.where("success").count() == 40


def test_yaml_stages(spark):
    df = spark.createDataFrame([(n, raw) for n, (raw, _) in YAML_CASES.items()], "doc string, raw string")
    parsed = P.parse_yaml_answers(df)
    assert {r.doc: r.stage for r in parsed.collect()} == {n: s for n, (_, s) in YAML_CASES.items()}
    trends = {r.doc: r for r in P.trends_of(parsed).collect()}
    assert {n for n, (_, s) in YAML_CASES.items() if s} == set(trends)
    assert all(abs(r.metric_value - 0.25) < 1e-9 and r.direction == "FALLING" for r in trends.values())
    assert trends["colons"].trend_title == "Boots: sold in May"
    assert {r.doc for r in P.dead_letters(parsed).collect()} == {"hopeless", "empty"}


def test_nothing_of_an_answer_is_cut(spark):
    ranks = "\n".join(f"- rank: {i}\n  trend_title: number {i}\n  direction: up" for i in range(1, 9))
    lost = "x" * 1000
    df = spark.createDataFrame([("many", "trends:\n   odd\n" + ranks + "\n\t- : [broken"), ("lost", lost)], "doc string, raw string")
    parsed = P.parse_yaml_answers(df)
    assert {r.rank for r in P.trends_of(parsed).where("doc = 'many'").collect()} == set(range(1, 9))
    assert P.dead_letters(parsed).first().error.endswith(lost)
    json = P.parse_json_answers(df.where("doc = 'lost'")).first()
    assert json.error.endswith(lost)


def test_line_repairs(spark):
    text = '    note: a: b\n\tkey: 5\n   odd: "x"\n            deep: y\nurl: http://a.b/c:1'
    df = spark.createDataFrame([(text,)], "t string")
    from pyspark.sql import functions as F

    r = df.select(P.quote_risky_values(F.col("t")).alias("q"), P.even_indent(F.col("t")).alias("i"), P.quote_all_values(F.col("t")).alias("a")).first()
    assert r.q.split("\n")[0] == '    note: "a: b"' and r.q.split("\n")[4] == "url: http://a.b/c:1"
    assert r.i.split("\n") == ["    note: a: b", "  key: 5", '  odd: "x"', "        deep: y", "url: http://a.b/c:1"]
    assert r.a.split("\n")[3] == '            deep: "y"' and r.a.split("\n")[1] == "\tkey: 5"


def source(spark):
    rows = [(1, "Gen-Z", "F", "Delhi", "Product-X", 0.5), (2, "Gen-X", "M", "Mumbai", "Product-Y", -0.2)]
    return spark.createDataFrame(rows, "row_id bigint, age_group string, gender string, city string, product_category string, velocity double")


def trends(spark):
    rows = [("d", 1, "t", {"age_group": "Gen-Z"}, "s", "RISING", 0.54, "velocity", "b", "HIGH", "long enough"),
            ("d", 2, "t", {"age_group": "Alien", "city": "All"}, "s", "FALLING", -0.45, "other", "b", "SURE", "short")]
    return spark.createDataFrame(rows, G.TREND_SCHEMA)


def test_trend_checks(spark):
    rows = G.check_trends(trends(spark), source(spark), ["age_group", "gender", "city"]).collect()
    bad = {(r.item, r.layer, r.field, r.severity) for r in rows if r.severity}
    assert bad == {("trend[1]", "METRIC", "metric_name", "WARNING"), ("trend[1]", "STRUCTURE", "confidence", "WARNING"),
                   ("trend[1]", "EVIDENCE", "evidence_summary", "WARNING"), ("trend[1]", "SEGMENT", "age_group", "CRITICAL")}
    r = G.roll_up(G.check_trends(trends(spark), source(spark), ["age_group", "gender", "city"])).first()
    assert (r.checks, r.passed, r.critical, r.warnings, r.status) == (12, 8, 1, 3, "FAILED")


def recommendation(spark, **changes):
    base = {"doc": "d", "rank": 1, "campaign_name": "n", "cited_trend_ids": ["TREND-1"], "target_segment": {"age_group": "Gen-Z", "gender": "All", "city": "All"},
            "product_focus": "Product-X", "campaign_type": "ACQUISITION", "recommended_channels": ["EMAIL"], "budget_tier": "TIER_1",
            "key_message": "try Product-X", "rationale": "velocity +54% WoW"}
    return spark.createDataFrame([tuple((base | changes).values())], G.RECOMMENDATION_SCHEMA)


def faults(spark, **changes):
    rows = G.check_recommendations(recommendation(spark, **changes), trends(spark), source(spark)).collect()
    return {(r.layer, r.field, r.severity) for r in rows if r.severity}


def test_recommendation_checks(spark):
    assert faults(spark) == set()
    r = G.roll_up(G.check_recommendations(recommendation(spark), trends(spark), source(spark))).first()
    # 5 schema, 1 + 1 citation, 4 segment, 1 metric, 2 business, 2 texts; the citation list and the product-free text add no pass
    assert (r.checks, r.passed, r.status) == (16, 14, "PASSED")
    assert faults(spark, recommended_channels=["SOCIAL_ADS"]) == {("BUSINESS", "channels", "WARNING")}
    assert faults(spark, cited_trend_ids=["TREND-2"], rationale="down") == {("BUSINESS", "type", "WARNING")}
    assert faults(spark, cited_trend_ids=["TREND-9"]) == {("CITATION", "cited", "CRITICAL")}
    assert faults(spark, cited_trend_ids=[]) == {("CITATION", "cited", "CRITICAL")}
    assert faults(spark, rationale="velocity +60% WoW") == {("METRIC", "rationale", "WARNING")}
    assert faults(spark, key_message="try Product-Z") == {("HALLUCINATION", "key_message", "CRITICAL")}
    assert faults(spark, product_focus="Product-Q") == {("SEGMENT", "product_category", "CRITICAL")}
    assert ("SCHEMA", "fields", "CRITICAL") in faults(spark, campaign_name=None)
    assert ("SCHEMA", "budget_tier", "WARNING") in faults(spark, budget_tier="TIER_9")


def insight(spark, cits, text="up 50.0%", line="MB"):
    return spark.createDataFrame([("d", "i1", text, "w", "g", "c", line, cits)], G.INSIGHT_SCHEMA)


def cite(row="1", value="0.5", is_text=False, name="velocity", dims=None):
    return ("f", row, value, is_text, name, dims or {"city": "Delhi"})


def insight_faults(spark, *cits, **kw):
    rows = G.check_insights(insight(spark, list(cits), **kw), source(spark), ["velocity"], ["age_group", "gender", "city", "product_category"], 2).collect()
    return {(r.layer, r.severity) for r in rows if r.severity}


def test_insight_citations(spark):
    assert insight_faults(spark, cite()) == set()
    assert insight_faults(spark, cite(row="0")) == {("CITATION_ROW", "CRITICAL")}
    assert insight_faults(spark, cite(row="3")) == {("CITATION_ROW", "CRITICAL")}
    assert insight_faults(spark, cite(value="0.51"), text="x") == set()
    assert insight_faults(spark, cite(value="0.511"), text="x") == {("CITATION_VALUE", "CRITICAL")}
    assert insight_faults(spark, cite(is_text=True)) == {("CITATION_VALUE", "WARNING")}
    assert insight_faults(spark, cite(value="much", is_text=True), text="x") == {("CITATION_VALUE", "WARNING"), ("CITATION_VALUE", "CRITICAL")}
    assert insight_faults(spark, cite(value=None), text="x") == set()
    assert insight_faults(spark, cite(name="nope")) == {("CITATION_NAME", "CRITICAL")}
    assert insight_faults(spark, cite(dims={"city": "Paris"})) == {("CITATION_DIMS", "CRITICAL")}
    assert insight_faults(spark, cite(), text="up 51%") == {("GROUNDING", "WARNING")}
    assert insight_faults(spark) == {("CITATION", "CRITICAL")}
    assert insight_faults(spark, cite(), line="XX") == {("LINE", "CRITICAL")}


def test_empty_documents_and_playbook(spark):
    docs = spark.createDataFrame([("d",), ("e",)], "doc string")
    assert [r.doc for r in G.empty_documents(docs, trends(spark)).collect()] == ["e"]
    text = C.playbook_text(C.playbook(trends(spark)), "few users").first().text
    assert text.startswith("[TREND-1]") and "[TREND-2]" in text and text.endswith("[DATA-QUALITY-NOTES]\n  few users")
