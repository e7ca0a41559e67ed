"""Text helpers: percentages in prose, number formats, token estimates, prompt hashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The patterns of percentages and product names in generated text.
PERCENT_PATTERN = r"(\d+(?:\.\d+)?)\s*%"
LOOSE_PERCENT_PATTERN = r"(\d+\.?\d*)\s*%"
PRODUCT_PATTERN = r"Product-[A-Z]"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def percents(text: Column | str, pattern: str = PERCENT_PATTERN) -> Column:
    """The numbers that stand before a percent sign, as doubles."""
    found = F.regexp_extract_all(_col(text), F.lit(pattern), F.lit(1))
    return F.transform(found, lambda x: x.cast("double"))


def mentions(text: Column | str, pattern: str = PRODUCT_PATTERN) -> Column:
    return F.regexp_extract_all(_col(text), F.lit(pattern), F.lit(0))


def token_estimate(text: Column | str) -> Column:
    """Four characters per token, rounded down."""
    return F.floor(F.length(_col(text)) / F.lit(4)).cast("bigint")


def short_hash(text: Column | str, length: int = 16) -> Column:
    return F.substring(F.sha2(_col(text), 256), 1, length)


def metric_text(value: Column | str, name: str) -> Column:
    """Readable number: percent for rate-like names, money for revenue-like ones."""
    v = _col(value).cast("double")
    size, low = F.abs(v), name.lower()
    if any(k in low for k in ("rate", "pct", "velocity", "change")):
        out = F.when(size < 10, F.format_string("%+.1f%%", v * 100)).otherwise(F.format_string("%+.2f", v))
    elif any(k in low for k in ("revenue", "spend")):
        out = (
            F.when(size >= 1e6, F.format_string("INR %.1fM", v / 1e6))
            .when(size >= 1e3, F.format_string("INR %.1fK", v / 1e3))
            .otherwise(F.format_string("INR %,.0f", v))
        )
    else:
        out = F.when(size < 100, F.format_string("%,.2f", v)).otherwise(F.format_string("%,.0f", v))
    return F.when(v.isNull() | F.isnan(v), "-").otherwise(out)


def map_text(m: Column | str, between: str = ", ") -> Column:
    """``k=v`` pairs of a map in key order."""
    entries = F.array_sort(F.map_entries(_col(m)))
    pairs = F.transform(entries, lambda e: F.concat_ws("=", e["key"], e["value"]))
    return F.array_join(pairs, between)
