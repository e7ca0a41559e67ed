"""Scalar business rules: clips, ratios, buckets, flags, grades and masks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Order states, cohort names, segment names and confidence thresholds.
VALID_ORDER_STATUSES = ("delivered", "shipped", "invoiced", "processing")
EXCLUDED_ORDER_STATUSES = ("canceled", "unavailable")
AGE_GROUPS = ("Gen-Z", "Millennial", "Gen-X", "Boomer", "Unknown")
DIRECTIONS = ("RISING", "FALLING", "STABLE")
CONFIDENCES = ("HIGH", "MEDIUM", "LOW")


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clip(x: Column | str, low: float | None = None, high: float | None = None) -> Column:
    """Bound a value; NULL stays NULL."""
    x = _col(x)
    out = x
    if high is not None:
        out = F.when(x > high, F.lit(high)).otherwise(out)
    if low is not None:
        out = F.when(x < low, F.lit(low)).otherwise(out)
    return out


def safe_ratio(num: Column | str, den: Column | str) -> Column:
    """Division that gives NULL when the denominator is zero."""
    return F.try_divide(_col(num).cast("double"), _col(den).cast("double"))


def trend_flag(x: Column | str, rising: float = 0.10, falling: float = -0.10) -> Column:
    """RISING above, FALLING below, else STABLE; NULL is STABLE."""
    x = _col(x)
    return F.when(x > rising, "RISING").when(x < falling, "FALLING").otherwise("STABLE")


def age_group(age: Column | str) -> Column:
    age = _col(age)
    return (
        F.when(age.between(18, 27), "Gen-Z")
        .when(age.between(28, 43), "Millennial")
        .when(age.between(44, 59), "Gen-X")
        .when(age >= 60, "Boomer")
        .otherwise("Unknown")
    )


def order_segment(n: Column | str) -> Column:
    """Right-closed buckets of the order count: 1, 2, 3-4, more."""
    n = _col(n)
    return (
        F.when(n <= 0, "nan")
        .when(n <= 1, "one_time")
        .when(n <= 2, "returning")
        .when(n <= 4, "regular")
        .otherwise("power_buyer")
    )


def signal_score(trend: Column | str, cohort: Column | str) -> Column:
    """Strength of a signal weighted by the size of its cohort."""
    return F.abs(_col(trend)) * F.log1p(_col(cohort))


def confidence_grade(trend: Column | str, cohort: Column | str, variant: str = "card") -> Column:
    """HIGH needs a strong trend and a big cohort; the variants differ below that."""
    strength, size = F.abs(_col(trend)), _col(cohort)
    high = (strength > 0.3) & (size > 500)
    if variant == "card":
        return F.when(high, "HIGH").when((strength > 0.15) | (size > 200), "MEDIUM").otherwise("LOW")
    if variant == "lean":
        return F.when(high, "HIGH").otherwise("MEDIUM")
    if variant == "generic":
        return F.when(high, "HIGH").when(strength > 0.15, "MEDIUM").otherwise("LOW")
    raise ValueError(f"unknown confidence variant {variant!r}")


def to_log_target(y: Column | str) -> Column:
    return F.log1p(F.greatest(_col(y), F.lit(0.0)))


def from_log_target(y: Column | str) -> Column:
    return F.greatest(F.expm1(_col(y)), F.lit(0.0))


def sanitised(x: Column | str) -> Column:
    """Text, NaN, infinities and NULL become 0."""
    v = _col(x).try_cast("double")
    bad = v.isNull() | F.isnan(v) | (F.abs(v) == F.lit(float("inf")))
    return F.when(bad, F.lit(0.0)).otherwise(v)


def is_infinite(x: Column | str) -> Column:
    return F.abs(_col(x).cast("double")) == F.lit(float("inf"))


def numeric_columns(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    """Numeric columns of a frame in schema order, minus the excluded ones."""
    skip = set(exclude)
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType) and f.name not in skip]


def string_columns(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    skip = set(exclude)
    return [f.name for f in df.schema if isinstance(f.dataType, T.StringType) and f.name not in skip]


def fill_by_type(df: DataFrame, text: str = "unknown") -> DataFrame:
    """Numbers become 0 and text becomes ``text`` where NULL."""
    return df.fillna(0, numeric_columns(df)).fillna(text, string_columns(df))


def ordered_columns(df: DataFrame, *groups: Sequence[str]) -> list[str]:
    """Columns in the order of the groups, then the rest; each once, hidden ones left out."""
    wanted = [c for g in groups for c in g if c in df.columns]
    rest = [c for c in df.columns if not c.startswith("_")]
    return list(dict.fromkeys(wanted + rest))


def require_columns(df: DataFrame, names: Sequence[str], what: str = "table") -> DataFrame:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"{what} lacks columns {missing}")
    return df
