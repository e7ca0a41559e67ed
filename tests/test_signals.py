from datetime import date

import pytest
from tests.conftest import ts

from clientele.operators import cards as C
from clientele.operators import signals as S

WEEKLY = "age_group string, gender string, city string, product_category string, week_start date, purchasers bigint, purchase_count bigint, total_revenue double, page_views bigint, sessions bigint, add_to_cart_events bigint, active_users bigint"


def weekly(spark, rows):
    return spark.createDataFrame([("Gen-Z", "F", c, k, w, n, n, 1.0, v, v, n, 10) for c, k, w, n, v in rows], WEEKLY)


def test_lag_uses_previous_present_week(spark):
    w1, w3 = date(2024, 1, 1), date(2024, 1, 15)
    df = S.with_trends(weekly(spark, [("x", "k", w1, 10, 4), ("x", "k", w3, 11, 2), ("y", "k", w1, 0, 2), ("y", "k", w3, 5, 0), ("z", "k", w3, 9, 1)]))
    got = {(r.city, r.week_start): r for r in df.collect()}
    assert got["x", w3].wow_purchase_velocity_pct == pytest.approx(0.10)
    assert got["x", w3].trend_flag == "STABLE"  # exactly at the threshold
    assert got["y", w3].wow_purchase_velocity_pct is None and got["y", w3].trend_flag == "STABLE"  # previous count is 0
    assert got["z", w3].wow_purchase_velocity_pct is None
    assert got["x", w1].national_avg_page_views == 3.0 and got["y", w3].pages_per_session is None


def test_users_without_profile_drop_out(spark):
    events = spark.createDataFrame([("a", ts("2024-01-02T00:00:00"), "purchase", "k", 5.0, "s"), ("b", ts("2024-01-02T00:00:00"), "purchase", "k", 5.0, "s")],
                                   "user_id string, event_timestamp timestamp_ntz, event_type string, product_category string, revenue double, session_id string")
    profiles = spark.createDataFrame([("a", 17, "F", "x")], "user_id string, age int, gender string, city string")
    rows = S.micro_signals(events, profiles, "2024-01-10").collect()
    assert len(rows) == 1 and rows[0].age_group == "Unknown" and rows[0].active_users == 1


FRAME = "age_group string, gender string, city string, product_category string, week_start date, active_users int, purchase_rate double, web_footprint_vs_national double, wow_purchase_velocity_pct double, trend_flag string"


def frame(spark):
    old, new = date(2024, 1, 1), date(2024, 1, 8)
    rows = [
        ("Gen-Z", "F", "a", "k", old, 500, 0.1, 1.0, 0.5, "RISING"), ("Gen-Z", "F", "b", "k", old, 60, 0.1, 1.0, 7.0, "RISING"),
        ("Gen-Z", "F", "b", "k", old, 60, 0.1, 1.0, 7.0, "RISING"), ("Gen-X", "M", "a", "k", old, 80, 0.2, 1.0, None, "STABLE"),
        ("Gen-X", "M", "b", "k", old, -3, 0.2, 1.0, 0.2, "RISING"), ("Alien", "M", "b", "k", old, 70, 0.2, 1.0, -7.0, "FALLING"),
        ("Gen-X", "M", "c", "k", new, 3, 0.2, 1.0, 0.9, "RISING"),
    ]
    return spark.createDataFrame(rows, FRAME)


def test_gate_and_report(spark):
    df = frame(spark)
    out = {(r.city, r.wow_purchase_velocity_pct) for r in S.clean_signals(df).collect()}
    assert out == {("a", 0.5), ("b", 5.0), ("c", 0.9)}
    report = {r.issue: r.rows for r in S.clean_report(df).collect()}
    assert report["null:wow_purchase_velocity_pct"] == 1 and report["negative:active_users"] == 1
    assert report["capped:wow_purchase_velocity_pct"] == 3 and report["duplicate"] == 1
    assert report["invalid:age_group"] == 1 and (report["rows_before"], report["rows_after"]) == (7, 3)


def test_filter_order_decides_the_period(spark):
    df = frame(spark)
    cohort_first = {str(r.week_start) for r in S.select_period(df, "active_users", "week_start", 50).collect()}
    period_first = S.select_period(df, "active_users", "week_start", 50, filter_first=False).count()
    assert cohort_first == {"2024-01-01"} and period_first == 0


def test_top_per_group_and_ties(spark):
    w = date(2024, 1, 8)
    rows = [("Gen-Z", "F", c, "k", w, 100, 0.1, 1.0, 0.5, "RISING") for c in "edcba"] + [("Gen-Z", "F", "z", "k", w, 100, 0.1, 1.0, None, "STABLE")]
    df = spark.createDataFrame(rows, FRAME)
    assert [r.city for r in S.weighted_trim(df, 50, 3).collect()] == ["a", "b", "c"]
    assert {r.city for r in S.top_movers(df, 2).collect()} == {"a", "b"}


def test_roles(spark):
    roles = {r.column: (r.role, r["values"]) for r in S.detect_roles(frame(spark), "wow_purchase_velocity_pct").collect()}
    assert roles["week_start"][0] == "timestamp" and roles["wow_purchase_velocity_pct"][0] == "trend"
    assert roles["active_users"][0] == "metric" and roles["gender"] == ("dimension", "F, M")


SPEC = S.SignalSpec("s", S.COHORT, "wow_purchase_velocity_pct", min_cohort=1, metrics=("purchase_rate",))


def test_text_and_budget(spark):
    df = frame(spark).where("city <> 'b'")
    text = C.signal_text(df, SPEC).first().text
    assert "[1] ^ RISING -- Gen-X x M x c x k" in text and "+90.0%" in text and "confidence              : MEDIUM" in text
    lines = spark.createDataFrame([(i, "x" * 39) for i in range(1, 101)], "rank int, line string")
    # 40 characters a row, less the last line break: 100 rows take 999 tokens
    r = C.token_budget(lines, fixed_tokens=10, limit=700).first()
    assert (r.row_cap, r.data_tokens, r.within_budget) == (60, 599, True)
    none = C.token_budget(lines, fixed_tokens=10, limit=50).first()
    assert none.row_cap == 20 and not none.within_budget


def test_one_operator_for_unlike_signals(spark):
    other = spark.createDataFrame([("mail", date(2024, 1, 8), 10, 0.2), ("push", date(2024, 1, 8), 900, -0.4)], "channel string, week_start date, sent int, change double")
    specs = {"a": SPEC, "b": S.SignalSpec("b", ("channel",), "change", cohort="sent")}
    rows = S.union_signals({"a": frame(spark), "b": other}, specs).collect()
    b = [r for r in rows if r.signal_type == "b"]
    assert [(r.rank, r.direction, r.confidence, r.segment) for r in sorted(b, key=lambda r: r.rank)] == [
        (1, "FALLING", "HIGH", {"channel": "push"}), (2, "RISING", "MEDIUM", {"channel": "mail"})]
    assert b[0].benchmark_comparison.endswith("baseline")
