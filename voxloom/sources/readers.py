"""Readers. CSV columns are read as text and cast by name, never inferred."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxloom.checks import require_columns
from voxloom.functions.text import strip
from voxloom.functions.vectors import from_json_text
from voxloom.sources.split_csv import read_split_csv

# Review files hold newlines inside quotes and double a quote to escape it.
CSV_OPTIONS = {"header": True, "multiLine": True, "escape": '"', "quote": '"', "encoding": "UTF-8"}


def read_csv(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """CSV with quoted newlines. A multi-line file is one task, so keep many files."""
    reader = spark.read.options(**CSV_OPTIONS)
    return (reader.schema(schema) if schema else reader).csv(path)


def with_column_named(df: DataFrame, name: str) -> DataFrame:
    """Rename the column that matches ``name`` up to case and outer spaces."""
    match = [c for c in df.columns if c.strip().lower() == name.lower()]
    if not match:
        raise ValueError(f"no column {name!r}; found {df.columns}")
    return df.withColumnRenamed(match[0], name)


def read_numbered(spark: SparkSession, path: str, split: bool = True) -> DataFrame:
    """CSV rows with a ``review_id``: their own, else their place in the files.

    ``split`` reads every file by many tasks and numbers the rows 0, 1, .. in the order of
    files and records, the same however the files are cut; it wants quotes by the usual
    rules (``read_split_csv``). Without it a file is one task, a quote mark may stand
    anywhere, and the numbers depend on how files are dealt to tasks.
    """
    df = read_csv(spark, path)
    named = "review_id" in df.columns
    if split and df.columns:
        number = "_number" if named else "review_id"
        df = read_split_csv(spark, path, df.schema, CSV_OPTIONS, number).drop("_number")
    elif not named:
        return df.select(F.monotonically_increasing_id().alias("review_id"), *df.columns)
    return df.withColumn("review_id", F.col("review_id").cast("bigint")) if named else df


def read_reviews(spark: SparkSession, path: str, split: bool = True) -> DataFrame:
    """Reviews with a ``review_id``; other columns pass through as text."""
    return with_column_named(read_numbered(spark, path, split), "Review")


def read_labelled(spark: SparkSession, path: str, split: bool = True) -> DataFrame:
    """Training reviews: ``review_id, Review, Relevant``."""
    df = with_column_named(read_reviews(spark, path, split), "Relevant")
    return df.withColumn("Relevant", F.col("Relevant").cast("int"))


def read_glossary(spark: SparkSession, path: str) -> DataFrame:
    """Glossary rows with the outer white space of ``Term`` removed."""
    df = with_column_named(read_csv(spark, path), "Term")
    return df.withColumn("Term", strip(F.col("Term")))


def read_embeddings(
    spark: SparkSession,
    path: str,
    embeddings: str = "embeddings",
    text: str = "text",
    split: bool = True,
) -> DataFrame:
    """Rows with the embedding text parsed; a missing text column becomes the row id."""
    df = read_numbered(spark, path, split)
    require_columns(df, [embeddings])
    if text not in df.columns:
        df = df.withColumn(text, F.col("review_id").cast("string"))
    return df.withColumn(embeddings, from_json_text(F.col(embeddings)))


def read_clustered(
    spark: SparkSession, path: str, text: str = "Review", cluster: str = "Cluster"
) -> DataFrame:
    """Clustered reviews: trimmed column names, no null text or cluster."""
    df = read_csv(spark, path)
    df = df.toDF(*[c.strip() for c in df.columns])
    require_columns(df, [text, cluster])
    return df.na.drop(subset=[text, cluster]).withColumn(cluster, F.col(cluster).cast("int"))
