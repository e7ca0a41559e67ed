from pyspark.sql import functions as F

from clientele.functions import hashing as H
from clientele.functions import rules as R
from clientele.functions import text as X
from clientele.functions import timeutil as T


def one(spark, **cols):
    return spark.range(1).select(*[c.alias(n) for n, c in cols.items()]).first()


def at(text):
    return F.lit(text).cast("timestamp_ntz")


def test_days_are_floored_durations(spark):
    r = one(
        spark,
        night=T.floor_days(at("2020-01-01 23:00:00"), at("2020-01-02 01:00:00")),
        back=T.floor_days(at("2020-01-01 12:00:00"), at("2020-01-01 00:00:00")),
        exact=T.floor_days(at("2020-01-01 00:00:00"), at("2020-01-03 00:00:00")),
        before=T.floor_days(at("2020-01-01 00:00:00"), at("2020-01-02 23:59:59.999999")),
        null=T.floor_days(at("2020-01-01 00:00:00"), F.lit(None).cast("timestamp_ntz")),
    )
    assert (r.night, r.back, r.exact, r.before, r.null) == (0, -1, 2, 1, None)


def test_weeks_start_on_monday(spark):
    r = one(spark, mon=T.week_start(at("2024-01-01 00:00:00")), sun=T.week_start(at("2024-01-07 23:59:59")))
    assert str(r.mon) == str(r.sun) == "2024-01-01"


def test_clip_ratio_and_flags(spark):
    r = one(
        spark,
        high=R.clip(F.lit(7.0), -5.0, 5.0), low=R.clip(F.lit(-7.0), -5.0, 5.0),
        null=R.clip(F.lit(None).cast("double"), -5.0, 5.0), zero=R.safe_ratio(F.lit(1), F.lit(0)),
        edge_up=R.trend_flag(F.lit(0.10)), edge_down=R.trend_flag(F.lit(-0.10)), up=R.trend_flag(F.lit(0.11)),
        down=R.trend_flag(F.lit(-0.11)), unknown=R.trend_flag(F.lit(None).cast("double")),
    )
    assert (r.high, r.low, r.null, r.zero) == (5.0, -5.0, None, None)
    assert (r.edge_up, r.edge_down, r.up, r.down, r.unknown) == ("STABLE", "STABLE", "RISING", "FALLING", "STABLE")


def test_buckets(spark):
    ages = {17: "Unknown", 18: "Gen-Z", 27: "Gen-Z", 28: "Millennial", 43: "Millennial", 44: "Gen-X", 60: "Boomer"}
    for age, group in ages.items():
        assert one(spark, g=R.age_group(F.lit(age))).g == group
    assert one(spark, g=R.age_group(F.lit(None).cast("int"))).g == "Unknown"
    for n, segment in {1: "one_time", 2: "returning", 3: "regular", 4: "regular", 5: "power_buyer"}.items():
        assert one(spark, s=R.order_segment(F.lit(n))).s == segment


def test_confidence_variants(spark):
    r = one(
        spark,
        high=R.confidence_grade(F.lit(-0.4), F.lit(501), "generic"), card=R.confidence_grade(F.lit(0.1), F.lit(201), "card"),
        card_low=R.confidence_grade(F.lit(0.1), F.lit(200), "card"), lean=R.confidence_grade(F.lit(0.0), F.lit(1), "lean"),
        generic=R.confidence_grade(F.lit(0.16), F.lit(1), "generic"), low=R.confidence_grade(F.lit(0.15), F.lit(999), "generic"),
    )
    assert tuple(r) == ("HIGH", "MEDIUM", "LOW", "MEDIUM", "MEDIUM", "LOW")


def test_sanitised(spark):
    values = [F.lit("abc"), F.lit("1.5"), F.lit(float("nan")), F.lit(float("inf")), F.lit(None).cast("double"), F.lit(-2)]
    assert [one(spark, v=R.sanitised(v)).v for v in values] == [0.0, 1.5, 0.0, 0.0, 0.0, -2.0]


def test_text_helpers(spark):
    r = one(
        spark,
        p=X.percents(F.lit("up 12% and 3.5 % but 7 percent")), m=X.mentions(F.lit("Product-X beats Product-Y, not product-z")),
        rate=X.metric_text(F.lit(0.123), "purchase_rate"), big=X.metric_text(F.lit(12.5), "velocity"),
        money=X.metric_text(F.lit(2_500_000.0), "total_revenue"), thousand=X.metric_text(F.lit(2_500.0), "spend"),
        plain=X.metric_text(F.lit(1234.5), "page_views"), null=X.metric_text(F.lit(None).cast("double"), "x"),
        tokens=X.token_estimate(F.lit("abcdefg")), h=X.short_hash(F.lit("a")),
    )
    assert r.p == [12.0, 3.5] and r.m == ["Product-X", "Product-Y"]
    assert (r.rate, r.big, r.money, r.thousand, r.null) == ("+12.3%", "+12.50", "INR 2.5M", "INR 2.5K", "-")
    assert r.tokens == 1 and r.h == "ca978112ca1bbdca"


def test_poisson_draws_have_mean_and_variance_one(spark):
    h1, h2 = H.replicate_seeds(1, "id")
    draws = spark.range(200).select(h1.alias("a"), h2.alias("b"), F.explode(F.sequence(F.lit(1), F.lit(200))).alias("r"))
    r = draws.select(H.poisson_one(F.col("a"), F.col("b"), F.col("r").cast("bigint")).alias("w")).agg(F.avg("w").alias("m"), F.var_samp("w").alias("v")).first()
    assert abs(r.m - 1) < 0.03 and abs(r.v - 1) < 0.06


def test_unit_hash_is_even(spark):
    r = spark.range(5000).select(H.unit_hash(9, "id").alias("u")).agg(F.avg("u").alias("m"), F.min("u").alias("a"), F.max("u").alias("b")).first()
    assert abs(r.m - 0.5) < 0.02 and r.a >= 0 and r.b < 1


def test_column_helpers(spark):
    df = spark.createDataFrame([(1, "a", None, 2.0)], "n int, s string, t string, _score double")
    assert R.ordered_columns(df, ["s"], ["n", "s"]) == ["s", "n", "t"]
    assert R.numeric_columns(df, ["_score"]) == ["n"]
    assert R.fill_by_type(df).first().t == "unknown"
