"""Row filters, truncation, deduplication and cluster selections."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from voxloom.checks import require_columns
from voxloom.functions.ranking import id_bucket, number_rows
from voxloom.functions.text import NULL_MARKERS, is_blank


def drop_unusable(df: DataFrame, text: str = "Review", null_markers: bool = True) -> DataFrame:
    """Keep rows whose text is present and not blank."""
    require_columns(df, [text])
    keep = F.col(text).isNotNull() & ~is_blank(F.col(text))
    if null_markers:
        keep = keep & ~F.col(text).isin([m for m in NULL_MARKERS if m])
    return df.where(keep)


def as_text(df: DataFrame, text: str = "Review") -> DataFrame:
    """Drop null values of any type and cast the column to text."""
    require_columns(df, [text])
    return df.na.drop(subset=[text]).withColumn(text, F.col(text).cast("string"))


def text_windows(df: DataFrame, text: str = "Review", size: int = 500) -> DataFrame:
    """Cut every text into consecutive pieces of ``size`` characters.

    Piece 0 is the part a model with an input limit of ``size`` sees; the other
    pieces keep the rest of the text available.
    """
    last = F.greatest(F.ceil(F.length(text) / F.lit(size)) - 1, F.lit(0))
    pieces = F.transform(
        F.sequence(F.lit(0), last.cast("int")),
        lambda i: F.substring(F.col(text), i * size + 1, F.lit(size)),
    )
    return df.select(
        *[c for c in df.columns if c != text],
        F.posexplode(pieces).alias("piece_no", "piece"),
    )


def keep_first(
    df: DataFrame, keys: list[str] | str = "Review", order: str = "review_id"
) -> DataFrame:
    """One row per key: the one with the smallest ``order`` value.

    Spark keeps one candidate per key in every input task before the shuffle,
    so a text with very many copies does not fill one task.
    """
    keys = [keys] if isinstance(keys, str) else keys
    first = W.partitionBy(*keys).orderBy(order)
    return df.withColumn("_rn", F.row_number().over(first)).where("_rn = 1").drop("_rn")


def duplicate_summary(df: DataFrame, key: str = "Review") -> DataFrame:
    """One row: original size, duplicates removed, final size, percent removed."""
    per_key = df.groupBy(key).agg(F.count(F.lit(1)).alias("_c"))
    return (
        per_key.agg(
            F.coalesce(F.sum("_c"), F.lit(0)).alias("original_size"),
            F.count(F.lit(1)).alias("final_size"),
        )
        .withColumn("duplicates_removed", F.col("original_size") - F.col("final_size"))
        .withColumn(
            "removed_percent",
            F.when(
                F.col("original_size") > 0,
                F.col("duplicates_removed") * 100.0 / F.col("original_size"),
            ).otherwise(0.0),
        )
    )


def distinct_assignments(df: DataFrame, text: str = "Review", cluster: str = "Cluster") -> DataFrame:
    """Distinct (text, cluster) pairs; every other column goes."""
    return df.select(text, cluster).dropDuplicates()


def numbered_clusters(
    df: DataFrame, text: str = "Review", cluster: str = "Cluster", order: str = "review_id"
) -> DataFrame:
    """Clustered table ``ID, Review, Cluster``: distinct pairs, sorted by cluster.

    IDs run from 1 over the whole table; inside a cluster the pair first seen
    (smallest ``order``) comes first.
    """
    pairs = df.groupBy(cluster, text).agg(F.min(order).alias("_first"))
    numbered = number_rows(
        pairs,
        order=["_first"],
        buckets={"cluster": F.col(cluster), "slice": id_bucket("_first")},
        out="ID",
    )
    return numbered.select(
        "ID", F.col(text).alias("Review"), F.col(cluster).cast("int").alias("Cluster")
    )


def first_per_cluster(
    df: DataFrame, n: int = 3, cluster: str = "Cluster", order: str = "review_id"
) -> DataFrame:
    """The first ``n`` rows of each cluster, as samples for a report."""
    rank = F.row_number().over(W.partitionBy(cluster).orderBy(order))
    return df.withColumn("sample_no", rank).where(F.col("sample_no") <= n)


def distinct_clusters(df: DataFrame, cluster: str = "Cluster") -> DataFrame:
    return df.select(cluster).distinct().orderBy(cluster)


def drop_noise(df: DataFrame, label: str = "label") -> DataFrame:
    return df.where(F.col(label) != -1)
