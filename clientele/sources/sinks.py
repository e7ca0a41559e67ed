"""Writers. All write folders from the executors; nothing is gathered on the driver."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clientele.functions.rules import ordered_columns

# Column order of an exported cohort signal.
SIGNAL_COLUMNS = (
    "age_group", "product_category", "trend_flag", "wow_purchase_velocity_pct", "gender", "city",
    "week_start", "active_users", "purchasers", "purchase_count", "total_revenue", "page_views",
    "sessions", "add_to_cart_events", "purchase_rate", "cart_conversion_rate", "pages_per_session",
    "web_footprint_vs_national", "national_avg_page_views",
)


def write_table(df: DataFrame, path: str, fmt: str = "parquet", compression: str | None = None) -> str:
    """CSV (with header), JSON or Parquet, with an optional codec."""
    writer = df.write.mode("overwrite")
    if fmt == "csv":
        writer = writer.option("header", True)
    if compression:
        writer = writer.option("compression", compression)
    writer.format(fmt).save(path)
    return path


def write_tables(tables: dict[str, DataFrame], root: str, fmt: str = "csv", compression: str | None = None) -> None:
    for name, df in tables.items():
        write_table(df, f"{root}/{name}", fmt, compression)


def write_sequences(sequences: DataFrame, path: str) -> str:
    """One JSON object per user: ``{"user_id": ..., "events": [{...}]}``."""
    return write_table(sequences, path, "json")


def write_splits(splits: DataFrame, path: str) -> str:
    """One folder per split, so that a reader of one split prunes the others."""
    splits.write.mode("overwrite").partitionBy("split").parquet(path)
    return path


def write_metadata(metadata: DataFrame, path: str) -> str:
    return write_table(metadata.coalesce(1), path, "json")


def write_signal(df: DataFrame, root: str, stamp: datetime | None = None) -> str:
    """Time-stamped export in the fixed column order; known columns only."""
    at = (stamp or datetime.now()).strftime("%Y%m%d_%H%M%S")
    columns = [c for c in SIGNAL_COLUMNS if c in df.columns]
    return write_table(df.select(*columns), f"{root}/micro_signals_{at}", "csv")


def result_rows(results: DataFrame, keys: tuple[str, ...] = ("task", "model")) -> DataFrame:
    """A wide metric table as ``(task, model, metric, value)`` rows."""
    metrics = [c for c in results.columns if c not in keys]
    return results.unpivot(list(keys), metrics, "metric", "value")


def write_results(results: DataFrame, root: str) -> None:
    """Per task (as partitions) and combined."""
    results.write.mode("overwrite").partitionBy("task").json(f"{root}/per_task")
    write_table(results, f"{root}/all_results", "parquet")


def serialised_rows(df: DataFrame, fmt: str = "markdown", columns: tuple[str, ...] = ()) -> DataFrame:
    """Each row as one line of a markdown table, of CSV or of JSON records."""
    names = ordered_columns(df, columns)
    if fmt == "markdown":
        cells = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in names]
        line = F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))
    elif fmt == "csv":
        line = F.to_csv(F.struct(*names))
    elif fmt == "json_records":
        line = F.to_json(F.struct(*names))
    else:
        raise ValueError(f"unknown row format {fmt!r}")
    return df.withColumn("line", line)


def markdown_header(columns: list[str]) -> str:
    return "| " + " | ".join(columns) + " |\n|" + "|".join(":--" for _ in columns) + "|"
