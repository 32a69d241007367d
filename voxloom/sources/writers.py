"""Writers. Each writes in parallel, one file per task."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxloom.functions.vectors import to_json_text

WRITE_OPTIONS = {
    "header": True,
    "quoteAll": True,
    "escape": '"',
    "ignoreLeadingWhiteSpace": False,
    "ignoreTrailingWhiteSpace": False,
    "encoding": "UTF-8",
}


def write_csv(df: DataFrame, path: str, partition_by: list[str] | None = None) -> str:
    writer = df.write.mode("overwrite").options(**WRITE_OPTIONS)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.csv(path)
    return path


def write_embeddings(
    df: DataFrame, source_path: str, embeddings: str = "embeddings", suffix: str = "_embeddings"
) -> str:
    """Write next to the source, name plus suffix, the vectors as JSON text."""
    stem = source_path.rstrip("/").removesuffix(".csv")
    return write_csv(
        df.withColumn(embeddings, to_json_text(F.col(embeddings))), f"{stem}{suffix}.csv"
    )


def write_run_tables(run_folder: str, **tables: DataFrame) -> dict[str, str]:
    """Clustered, initial, unified and citation tables of a run, one folder each."""
    return {name: write_csv(df, f"{run_folder}/{name}.csv") for name, df in tables.items()}


def assignment_rows(df: DataFrame, combination: str, text: str = "text") -> DataFrame:
    """One row per (review, cluster) of a run; ``assignments`` is the cluster array."""
    return df.select(
        F.col("review_id").alias("original_index"),
        F.col(text).alias("text"),
        F.explode("assignments").alias("cluster"),
        F.lit(combination).alias("combination_id"),
        (F.size("assignments") > 1).alias("is_multiple_membership"),
    )


def write_assignments(df: DataFrame, path: str) -> str:
    """Assignments of many runs, one folder per combination."""
    df.write.mode("overwrite").partitionBy("combination_id").parquet(path)
    return path


def run_folder(base: str, moment: datetime | None = None) -> str:
    """A folder per run, named by its start time."""
    moment = moment or datetime.now(timezone.utc)
    return f"{base.rstrip('/')}/run_id={moment:%Y%m%d_%H%M%S}"
