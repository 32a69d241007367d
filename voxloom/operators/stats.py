"""Score statistics, confidence bands and cluster sizes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxloom.functions.ranking import exact_quantiles
from voxloom.operators.scoring import BINARY, SCORE


def _totals() -> list[Column]:
    score, hit = F.col(SCORE), F.col(BINARY)
    return [
        F.count(F.lit(1)).alias("total_comments"),
        F.count_if(hit == 1).alias("relevant_comments"),
        F.count_if(hit == 0).alias("irrelevant_comments"),
        F.avg(hit.cast("double")).alias("relevance_rate"),
        F.avg(score).alias("mean"),
        F.stddev_samp(score).alias("std"),
        F.min(score).alias("min"),
        F.max(score).alias("max"),
    ]


def _bands() -> list[Column]:
    """The five bands overlap at 0.6, so each is its own conditional count."""
    score, hit = F.col(SCORE), F.col(BINARY)
    return [
        F.count_if((score >= 0.8) & (hit == 1)).alias("very_confident_relevant"),
        F.count_if((score >= 0.6) & (score < 0.8) & (hit == 1)).alias("confident_relevant"),
        F.count_if((score >= 0.4) & (score <= 0.6)).alias("uncertain"),
        F.count_if((score > 0.2) & (score < 0.4) & (hit == 0)).alias("confident_irrelevant"),
        F.count_if((score <= 0.2) & (hit == 0)).alias("very_confident_irrelevant"),
    ]


def confidence_bands(df: DataFrame) -> DataFrame:
    return df.agg(*_bands())


def prediction_statistics(df: DataFrame) -> DataFrame:
    """One row: totals, rate, moments, median and quartiles, confidence bands."""
    scores = df.select(SCORE, BINARY)
    quartiles = exact_quantiles(scores, SCORE, [0.5, 0.25, 0.75]).select("quantiles").scalar()
    return (
        scores.agg(*_totals(), *_bands())
        .withColumn("_q", quartiles)
        .withColumn("relevance_rate", F.coalesce("relevance_rate", F.lit(0.0)))
        .withColumn("median", F.col("_q")[0])
        .withColumn("q25", F.col("_q")[1])
        .withColumn("q75", F.col("_q")[2])
        .drop("_q")
    )


def cluster_sizes(df: DataFrame, cluster: str = "Cluster") -> DataFrame:
    """Rows and share per cluster, sorted by cluster."""
    sizes = df.groupBy(cluster).agg(F.count(F.lit(1)).alias("size"))
    total = df.agg(F.count(F.lit(1))).scalar()
    return sizes.withColumn("percent", F.col("size") * 100.0 / total).orderBy(cluster)


def cluster_totals(df: DataFrame, cluster: str = "Cluster") -> DataFrame:
    """One row: number of clusters, number of rows, mean rows per cluster."""
    sizes = df.groupBy(cluster).agg(F.count(F.lit(1)).alias("size"))
    return sizes.agg(
        F.count(F.lit(1)).alias("n_clusters"),
        F.coalesce(F.sum("size"), F.lit(0)).alias("n_texts"),
        F.coalesce(F.avg("size"), F.lit(0.0)).alias("mean_size"),
    )


def mean_text_length(df: DataFrame, text: str = "Review", cluster: str = "Cluster") -> DataFrame:
    return df.groupBy(cluster).agg(F.avg(F.length(text)).alias("avg_text_length"))
