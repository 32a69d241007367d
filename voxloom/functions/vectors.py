"""Expressions on embedding arrays."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def to_json_text(col: Column) -> Column:
    """Embedding array as JSON text, the form kept in CSV files."""
    return F.to_json(col)


def from_json_text(col: Column) -> Column:
    """JSON (or list literal) text to an array of doubles."""
    return F.from_json(col, "array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def l2_norm(col: Column) -> Column:
    return F.sqrt(F.aggregate(col, F.lit(0.0), lambda s, v: s + v * v))


def l2_normalise(col: Column, floor: float = 1e-12) -> Column:
    norm = F.greatest(l2_norm(col), F.lit(floor))
    return F.transform(col, lambda v: v / norm)


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v
    )


def argmax(col: Column) -> Column:
    """Position of the largest element, first one on ties, counted from 0."""
    return (F.array_position(col, F.array_max(col)) - 1).cast("int")


def mean_by(df: DataFrame, by: list[str], vector: str, out: str = "centroid") -> DataFrame:
    """Mean vector and row count per group: one map-side-combined aggregate."""
    return (
        df.groupBy(*by)
        .agg(
            Summarizer.mean(array_to_vector(F.col(vector).cast("array<double>"))).alias("_mean"),
            F.count(F.lit(1)).alias("size"),
        )
        .withColumn(out, vector_to_array("_mean"))
        .drop("_mean")
    )


def masked_mean(
    tokens: DataFrame, by: str, vector: str, mask: str, normalise: bool = True, floor: float = 1e-9
) -> DataFrame:
    """Mean of the token vectors whose mask is set, then unit length.

    One row per token in, one row per ``by`` out. The divisor is the mask sum,
    held at ``floor`` or above, so a row without any token gives zeros.
    """
    weighted = F.transform(
        F.col(vector).cast("array<double>"), lambda v: v * F.col(mask).cast("double")
    )
    out = (
        tokens.groupBy(by)
        .agg(
            Summarizer.sum(array_to_vector(weighted)).alias("_sum"),
            F.sum(F.col(mask).cast("double")).alias("_n"),
        )
        .withColumn(
            "embedding",
            F.transform(
                vector_to_array("_sum"), lambda v: v / F.greatest(F.col("_n"), F.lit(floor))
            ),
        )
    )
    if normalise:
        out = out.withColumn("embedding", l2_normalise(F.col("embedding")))
    return out.select(by, "embedding")
