"""Planted violations of dependencies and cross-table rules are counted, also under a hot determinant."""

import pytest
from pyspark.sql import functions as F

from clientele.operators import quality as Q


def rows(df):
    return {r.rule: (r.checked, r.violations, round(r.share, 6)) for r in df.collect()}


def test_dependencies_with_a_hot_determinant(spark):
    # a third of all rows share one determinant, whose dependent is wrong in 7 rows
    df = spark.range(3000, numPartitions=11).select(
        F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.col("id").cast("string")).alias("a"),
        F.when(F.col("id") < 21, F.col("id").cast("string")).otherwise("x").alias("b"),
        F.when(F.col("id") % 2 == 0, 1).alias("c"), F.lit(None).cast("string").alias("d"),
    )
    got = rows(Q.consistency(df, {("a",): ["b", "c", "d"], ("a", "c"): ["b"]}))
    assert got == {"a -> b": (3000, 7, 0.997667), "a -> c": (1500, 0, 1.0), "a -> d": (0, 0, 1.0), "a, c -> b": (1500, 4, 0.997333)}


def test_rows_without_a_determinant_are_not_checked(spark):
    df = spark.createDataFrame([(None, 1), (None, 2), ("k", 1), ("k", 2), ("k", None)], "a string, b int")
    assert rows(Q.consistency(df, {("a",): ["b"]})) == {"a -> b": (2, 1, 0.5)}


def test_cross_rules_do_not_multiply_rows(spark):
    heads = spark.createDataFrame([(1, 10), (2, 20), (3, 5), (4, 1), (None, 1)], "k int, total int")
    lines = spark.createDataFrame([(1, 4), (1, 6), (2, 19), (3, None), (9, 1)], "k2 int, v int")
    rule = Q.CrossRule("adds up", lines, (("k", "k2"),), {"whole": F.sum("v")}, F.col("whole") == F.col("total"))
    assert rows(Q.consistency(heads, rules=[rule])) == {"adds up": (3, 2, 0.333333)}
    card = {r.dimension: r.value for r in Q.scorecard(heads, "t", "k", ["k"], {}, dependencies={("k",): ["total"]}, rules=[rule]).collect()}
    assert round(card["consistency"], 6) == round((1 + 1 / 3) / 2, 6)


def test_empty_table_and_no_rule(spark):
    none = spark.createDataFrame([], "a string, b int")
    assert rows(Q.consistency(none, {("a",): ["b"]})) == {"a -> b": (0, 0, 1.0)}
    with pytest.raises(ValueError, match="needs"):
        Q.consistency(none)
