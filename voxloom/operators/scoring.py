"""Relevance scores: batch scoring, thresholds, ranges, uncertainty."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from voxloom.checks import require_choice, require_columns, require_unit_range

SCORE = "prediction_score"
BINARY = "binary_prediction"

# Accepted names of the glossary feature, with the long spellings.
KNOWLEDGE = {
    "None": "None",
    "RC": "RC",
    "RP": "RP",
    "Relevant Count (RC)": "RC",
    "Relevant Position (RP)": "RP",
}


def knowledge_kind(name: str) -> str:
    require_choice("knowledge", name, KNOWLEDGE)
    return KNOWLEDGE[name]


def score_with(
    df: DataFrame,
    make_model: Callable[[], Callable[[list[str]], list[float]]],
    text: str = "Review",
    batch_size: int = 16,
) -> DataFrame:
    """Score every text with a caller's model, in Arrow batches.

    ``make_model`` runs once per Python worker and returns a function from a
    list of texts to a list of scores in [0, 1].
    """
    require_columns(df, [text])

    @pandas_udf("double")
    def scores(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = make_model()
        for series in batches:
            texts = series.tolist()
            out: list[float] = []
            for start in range(0, len(texts), batch_size):
                out.extend(model(texts[start : start + batch_size]))
            yield pd.Series(out, dtype="float64")

    return with_prediction(df.withColumn(SCORE, scores(F.col(text))))


def score_with_fitted(df: DataFrame, model: PipelineModel, threshold: float = 0.5) -> DataFrame:
    """Score with a fitted Spark ML classifier; the score is P(relevant)."""
    scored = model.transform(df)
    probability = vector_to_array(F.col("probability"))[1]
    keep = [F.col(c) for c in df.columns]
    return with_prediction(scored.select(*keep, probability.alias(SCORE)), threshold)


def with_prediction(df: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Add the binary prediction: 1 strictly above the threshold."""
    return df.withColumn(BINARY, (F.col(SCORE) > threshold).cast("int"))


def keep_relevant(df: DataFrame) -> DataFrame:
    """Rows predicted relevant, with the columns the caller had."""
    return df.where(F.col(BINARY) == 1)


def confidence_range(
    df: DataFrame,
    low: float | None = None,
    high: float | None = None,
    include_score: bool = True,
    include_binary: bool = True,
) -> DataFrame:
    """Keep scores in [low, high]; each bound and each result column is optional."""
    require_unit_range(low, high)
    if low is not None:
        df = df.where(F.col(SCORE) >= low)
    if high is not None:
        df = df.where(F.col(SCORE) <= high)
    dropped = [c for c, keep in ((SCORE, include_score), (BINARY, include_binary)) if not keep]
    return df.drop(*dropped)


def most_uncertain(df: DataFrame, distance: float = 0.1, order: str = "review_id") -> DataFrame:
    """Scores within ``distance`` of 0.5, nearest first."""
    near = confidence_range(df, 0.5 - distance, 0.5 + distance)
    return near.orderBy(F.abs(F.col(SCORE) - 0.5), order)
