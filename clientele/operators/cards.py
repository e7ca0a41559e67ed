"""Signals as text: cards, compact rows, benchmarks, token budgets, playbooks and state."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from clientele.functions import rules as R
from clientele.functions.text import metric_text, token_estimate
from clientele.operators.signals import SignalSpec, distinct_values, metric_columns, prepare, value_lists
from clientele.sources.sinks import serialised_rows

# Cards shown in full, rows shown compactly, row caps tried in turn, token limit.
CARDS = 5
COMPACT = 30
ROW_CAPS = (100, 80, 60, 40, 20)
TOKEN_LIMIT = 120_000


def ranked_prefix(df: DataFrame, order: Sequence[Column], n: int, out: str = "rank") -> DataFrame:
    """First ``n`` rows of a total order with their rank; only those rows reach one task."""
    top = df.orderBy(*order).limit(n)
    return top.withColumn(out, F.row_number().over(W.partitionBy(F.lit(0)).orderBy(*order)))


def _line(name: str, text: Column, width: int) -> Column:
    return F.concat(F.lit(f"  {name:<{width}s}: "), text)


def _arrow(flag: Column | str) -> Column:
    flag = F.col(flag) if isinstance(flag, str) else flag
    return F.when(flag == "RISING", "^").when(flag == "FALLING", "v").otherwise("-")


def cohort_label(dimensions: Sequence[str]) -> Column:
    return F.concat_ws(" x ", *[F.coalesce(F.col(d).cast("string"), F.lit("?")) for d in dimensions])


def signal_cards(df: DataFrame, spec: SignalSpec, cards: int = CARDS, compact: int = COMPACT) -> DataFrame:
    """Strongest signals as cards, the next ones as table lines: one row per shown signal."""
    rows = prepare(df, spec)
    metrics = metric_columns(rows, spec)
    order = [F.col("_score").desc_nulls_last(), *[F.col(d) for d in spec.dimensions]]
    shown = ranked_prefix(rows, order, cards + compact)
    label = cohort_label(spec.dimensions)
    lines = [
        F.format_string("[%d] %s %s -- %s", F.col("rank"), _arrow("trend_flag"), F.col("trend_flag"), label),
        _line(spec.trend, metric_text(spec.trend, spec.trend), 24),
        _line(spec.cohort, F.format_string("%,d", F.col(spec.cohort).cast("bigint")), 24),
        *[F.when(F.col(m).isNotNull(), _line(m, metric_text(m, m), 24)) for m in metrics],
        _line("confidence", R.confidence_grade(spec.trend, spec.cohort), 24),
    ]
    few = metrics[:2] if len(metrics) > 2 else metrics
    cells = [label, F.col(spec.trend).cast("string"), F.col("trend_flag"), F.col(spec.cohort).cast("string"),
             *[F.coalesce(F.col(m).cast("string"), F.lit("")) for m in few]]
    table = F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))
    is_card = F.col("rank") <= cards
    return shown.select(
        "rank",
        F.when(is_card, "card").otherwise("compact").alias("kind"),
        F.when(is_card, F.concat_ws("\n", *lines)).otherwise(table).alias("text"),
    )


def signal_benchmark(df: DataFrame, spec: SignalSpec) -> DataFrame:
    """Mean trend, total cohort and mean of the first two metrics per value of the first dimension."""
    rows = prepare(df, spec)
    first = spec.dimensions[0]
    extra = [F.round(F.avg(m), 4).alias(m) for m in metric_columns(rows, spec)[:2]]
    return rows.groupBy(first).agg(
        F.round(F.avg(spec.trend), 4).alias(spec.trend), F.sum(spec.cohort).alias(spec.cohort), *extra
    )


def signal_text(df: DataFrame, spec: SignalSpec) -> DataFrame:
    """The whole data block of a signal as one text: cards, compact table and benchmark.

    All three parts are bounded (35 rows and the values of one dimension of the newest period).
    """
    parts = signal_cards(df, spec).select(
        F.when(F.col("kind") == "card", 0).otherwise(1).alias("block"), F.col("rank").alias("at"), "text"
    )
    bench = serialised_rows(signal_benchmark(df, spec), "markdown")
    first = F.dense_rank().over(W.partitionBy(F.lit(0)).orderBy(spec.dimensions[0]))
    parts = parts.unionByName(bench.select(F.lit(2).alias("block"), first.alias("at"), F.col("line").alias("text")))
    ordered = F.array_sort(F.collect_list(F.struct("block", "at", "text")))
    text = F.array_join(F.transform(ordered, lambda r: r["text"]), "\n")
    return parts.agg(text.alias("text")).select(F.lit(spec.name).alias("signal"), "text")


def row_cards(df: DataFrame, spec: SignalSpec, key: Sequence[str], n: int = CARDS) -> DataFrame:
    """Cards that carry the row id a citation refers to. Ids follow the stated key order of the input."""
    from clientele.operators.ordering import global_row_number

    numbered = global_row_number(df, list(key), "row_id")
    flagged = numbered.withColumn("trend_flag", R.trend_flag(spec.trend))
    order = [R.signal_score(spec.trend, spec.cohort).desc_nulls_last(), F.col("row_id")]
    lines = [
        F.format_string("[ROW %d] %s %s -- %s", F.col("row_id"), _arrow("trend_flag"), F.col("trend_flag"),
                        cohort_label(spec.dimensions)),
        *[F.when(F.col(m).isNotNull(), _line(m, F.format_string("%.4f", F.col(m).cast("double")), 30))
          for m in metric_columns(df, spec)],
    ]
    return ranked_prefix(flagged, order, n).select("rank", "row_id", F.concat_ws("\n", *lines).alias("text"))


def column_summary(df: DataFrame, dimensions: Sequence[str], metrics: Sequence[str], max_values: int = 15) -> DataFrame:
    """Values (or their number) of each dimension, range and mean of each metric, as one line per column."""
    lists = value_lists(distinct_values(df, dimensions), max_values)
    dims = lists.select(
        F.col("column"),
        F.coalesce("values", F.format_string("(%d unique values)", F.col("n_values"))).alias("summary"),
    )
    aggs = []
    for m in metrics:
        v = F.col(m).cast("double")
        aggs.append(F.format_string("range [%.4f to %.4f], avg=%.4f", F.min(v), F.max(v), F.avg(v)).alias(m))
    ranges = df.agg(*aggs).unpivot([], list(metrics), "column", "summary")
    return dims.unionByName(ranges)


# ---------------------------------------------------------------- budget


def token_budget(lines: DataFrame, fixed_tokens: int, limit: int = TOKEN_LIMIT, caps: Sequence[int] = ROW_CAPS) -> DataFrame:
    """Largest row cap whose text still fits, with the tokens it takes.

    ``lines`` has ``rank`` and ``line``; only rows up to the largest cap are read.
    """
    kept = lines.where(F.col("rank") <= max(caps)).select("rank", F.length("line").alias("chars"))
    sums = kept.agg(
        *[F.coalesce(F.sum(F.when(F.col("rank") <= c, F.col("chars"))), F.lit(0)).alias(f"c{c}") for c in caps],
        *[F.count_if(F.col("rank") <= c).alias(f"n{c}") for c in caps],
    )

    def tokens(c: int) -> Column:
        breaks = F.greatest(F.col(f"n{c}") - 1, F.lit(0))
        return F.floor((F.col(f"c{c}") + breaks) / 4)

    best = tokens(caps[-1])
    cap = F.lit(caps[-1])
    for c in reversed(caps[:-1]):
        fits = tokens(c) + fixed_tokens <= limit
        best, cap = F.when(fits, tokens(c)).otherwise(best), F.when(fits, F.lit(c)).otherwise(cap)
    total = F.col("data_tokens") + fixed_tokens
    return sums.select(cap.cast("bigint").alias("row_cap"), best.cast("bigint").alias("data_tokens")).select(
        "row_cap",
        "data_tokens",
        total.alias("total_tokens"),
        F.greatest(limit - total, F.lit(0)).cast("bigint").alias("remaining"),
        F.round(F.lit(fixed_tokens) / F.greatest(total, F.lit(1)), 3).alias("cache_ratio"),
        (total <= limit).alias("within_budget"),
    )


def text_tokens(df: DataFrame, text: str = "text") -> DataFrame:
    return df.withColumn("tokens", token_estimate(text))


# ---------------------------------------------------------------- playbook and state


def segment_text(age: Column | str, gender: Column | str, city: Column | str) -> Column:
    return F.concat_ws(" / ", age, gender, F.coalesce(city, F.lit("All")))


def _doc(df: DataFrame) -> list[str]:
    return ["doc"] if "doc" in df.columns else []


def playbook(trends: DataFrame) -> DataFrame:
    """Trend rows as playbook entries with the id recommendations cite; ``doc`` stays if there is one.

    Ids count within a document, so entries of several documents are told apart by ``doc`` and id.
    """
    segment = (
        F.array_join(F.transform(F.array_sort(F.map_entries("segment")), lambda e: F.concat_ws("=", e["key"], e["value"])), " / ")
        if "segment" in trends.columns
        else segment_text(F.col("age_group"), F.col("gender"), F.col("city"))
    )
    return trends.select(
        *_doc(trends),
        F.concat(F.lit("TREND-"), F.col("rank").cast("string")).alias("trend_id"),
        "rank",
        F.col("trend_title").alias("title"),
        segment.alias("segment"),
        F.col("signal_type").alias("signal"),
        "direction",
        "metric_name",
        "metric_value",
        F.col("benchmark_comparison").alias("benchmark"),
        "confidence",
        F.col("evidence_summary").alias("evidence"),
    )


def playbook_text(entries: DataFrame, notes: Column | str | None = None) -> DataFrame:
    """The entries of each document as one text in rank order; an answer holds a handful of trends.

    Without a column ``doc`` all entries are one document.
    """
    block = F.concat_ws(
        "\n",
        F.concat(F.lit("["), F.col("trend_id"), F.lit("]")),
        F.concat(F.lit("  Title      : "), "title"),
        F.concat(F.lit("  Segment    : "), "segment"),
        F.concat(F.lit("  Signal     : "), "signal", F.lit(" -> "), "direction"),
        F.concat(F.lit("  Value      : "), "metric_name", F.lit(" = "), F.col("metric_value").cast("string")),
        F.concat(F.lit("  Benchmark  : "), "benchmark"),
        F.concat(F.lit("  Confidence : "), "confidence"),
        F.concat(F.lit("  Evidence   : "), "evidence"),
    )
    blocks = F.array_sort(F.collect_list(F.struct("rank", block.alias("text"))))
    text = F.array_join(F.transform(blocks, lambda b: b["text"]), "\n\n")
    if notes is not None:
        tail = notes if isinstance(notes, Column) else F.lit(notes)
        text = F.concat(text, F.lit("\n\n\n[DATA-QUALITY-NOTES]\n  "), tail)
    return entries.groupBy(*_doc(entries)).agg(text.alias("text"))


def compact_state(trends: DataFrame, signal: str, status: Column | str, generated_at: Column | str) -> DataFrame:
    """What the next run needs of this one: one small row per trend (and document), for an append-only table."""
    stated = status if isinstance(status, Column) else F.lit(status)
    at = generated_at if isinstance(generated_at, Column) else F.lit(generated_at)
    return trends.select(
        *_doc(trends),
        F.lit(signal).alias("signal_id"),
        at.alias("generated_at"),
        F.concat(F.lit("TREND-"), F.col("rank").cast("string")).alias("trend_id"),
        F.col("trend_title").alias("title"),
        "direction",
        F.col("metric_value").alias("value"),
        "confidence",
        stated.alias("validation"),
    )


def append_state(state: DataFrame, path: str) -> None:
    state.write.mode("append").partitionBy("signal_id").parquet(path)
