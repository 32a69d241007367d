"""Input validation: columns, nulls, emptiness and parameter domains."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def require_columns(df: DataFrame, columns: list[str]) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}; found {df.columns}")


def null_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row: ``n_rows`` and ``<column>_nulls`` for each column, in one pass."""
    require_columns(df, columns)
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        *[F.count_if(F.col(c).isNull()).alias(f"{c}_nulls") for c in columns],
    )


def require_complete(df: DataFrame, columns: list[str]) -> int:
    """Raise unless the table has rows and the columns have no null."""
    counts = null_counts(df, columns).first().asDict()
    if counts["n_rows"] == 0:
        raise ValueError("the table is empty")
    bad = [c for c in columns if counts[f"{c}_nulls"]]
    if bad:
        raise ValueError(f"null values in {bad}")
    return counts["n_rows"]


def require_rows(df: DataFrame, what: str = "table") -> DataFrame:
    if df.isEmpty():
        raise ValueError(f"the {what} has no usable rows")
    return df


def require_unit_range(low: float | None, high: float | None) -> None:
    for name, value in (("min_confidence", low), ("max_confidence", high)):
        if value is not None and not 0 <= value <= 1:
            raise ValueError(f"{name} must lie in [0, 1], got {value}")
    if low is not None and high is not None and low > high:
        raise ValueError("min_confidence is above max_confidence")


def require_k_range(k_min: int, k_max: int) -> None:
    if k_min < 2 or k_max < k_min:
        raise ValueError("need 2 <= k_min <= k_max")


def require_choice(name: str, value: str, choices) -> None:
    if value not in choices:
        raise ValueError(f"{name} must be one of {sorted(choices)}, got {value!r}")
