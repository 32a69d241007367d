"""The engine's tables, derived from the given ones."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxloom.operators.scoring import with_prediction
from voxloom.session import shared_folder


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def reviews(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select(
        F.col("doc_id").alias("review_id"), F.col("text").alias("Review")
    )


REVIEWS = "reviews AS (SELECT doc_id AS review_id, text AS Review FROM documents)"


def clustered(spark: SparkSession, folder: str) -> DataFrame:
    """Reviews with a cluster: the number in the name of their source."""
    return table(spark, folder, "documents").select(
        F.col("doc_id").alias("review_id"),
        F.col("text").alias("Review"),
        F.regexp_extract("source", "([0-9]+)", 1).cast("int").alias("Cluster"),
    )


CLUSTERED = (
    "clustered AS (SELECT doc_id AS review_id, text AS Review,"
    " CAST(regexp_extract(source, '([0-9]+)', 1) AS INTEGER) AS Cluster FROM documents)"
)


def scored(spark: SparkSession, folder: str) -> DataFrame:
    """Reviews with a score computed from their id, for exact checks."""
    score = F.pmod(F.col("review_id") * 37, F.lit(101)) / 100.0
    return with_prediction(reviews(spark, folder).withColumn("prediction_score", score))


SCORED = (
    "scored AS (SELECT *, CAST(prediction_score > 0.5 AS INTEGER) AS binary_prediction FROM ("
    " SELECT doc_id AS review_id, text AS Review, ((doc_id * 37) % 101) / 100.0::DOUBLE"
    " AS prediction_score FROM documents))"
)


def labelled(spark: SparkSession, folder: str) -> DataFrame:
    labels = table(spark, folder, "labels").select("doc_id", "quality")
    joined = table(spark, folder, "documents").join(labels, "doc_id")
    return joined.select(
        F.col("doc_id").alias("review_id"),
        F.col("text").alias("Review"),
        F.col("quality").alias("Relevant"),
    )


LABELLED = (
    "labelled AS (SELECT d.doc_id AS review_id, d.text AS Review, l.quality AS Relevant"
    " FROM documents d JOIN labels l USING (doc_id))"
)


def embeddings(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "embeddings").select(
        F.col("vec_id").alias("review_id"),
        F.col("embedding").cast("array<double>").alias("features"),
        "label",
    )


EMBEDDINGS = (
    "emb AS (SELECT vec_id AS review_id, embedding::DOUBLE[] AS features, label FROM embeddings)"
)


def experiments(spark: SparkSession, folder: str) -> DataFrame:
    """Experiment rows with the ten summary columns, one per order."""
    failed = F.col("o_orderkey") % 50 == 0
    cents = F.round(F.col("o_totalprice") * 100).cast("bigint")
    return table(spark, folder, "orders").select(
        F.concat(F.lit("run_"), F.lpad(F.col("o_orderkey").cast("string"), 12, "0")).alias(
            "combination_id"
        ),
        F.substring("o_orderpriority", 3, 20).alias("algorithm"),
        F.when(F.col("o_orderstatus") == "O", "none")
        .when(F.col("o_orderstatus") == "F", "pca")
        .otherwise("umap")
        .alias("reduction_method"),
        F.when(F.col("o_orderstatus") != "O", (F.col("o_custkey") % 50 + 2).cast("int")).alias(
            "n_components"
        ),
        F.when(F.col("o_custkey") % 7 != 0, (F.col("o_custkey") % 9 + 2).cast("int")).alias(
            "k_value"
        ),
        (F.col("o_custkey") % 9 + 2).cast("int").alias("n_clusters_found"),
        F.when(failed, -1.0).otherwise((cents % 19001 - 9000) / 10000.0).alias("silhouette_score"),
        F.when(failed, 0.0).otherwise((cents % 900001 + 1) / 100.0).alias("calinski_harabasz_score"),
        F.when(failed, float("inf"))
        .otherwise((cents % 50021 + 1) / 10000.0)
        .alias("davies_bouldin_score"),
        ((cents % 36007) / 100.0).alias("execution_time"),
    )


EXPERIMENTS = """experiments AS (
  SELECT 'run_' || lpad(CAST(o_orderkey AS VARCHAR), 12, '0') AS combination_id,
    substr(o_orderpriority, 3, 20) AS algorithm,
    CASE o_orderstatus WHEN 'O' THEN 'none' WHEN 'F' THEN 'pca' ELSE 'umap' END AS reduction_method,
    CASE WHEN o_orderstatus <> 'O' THEN CAST(o_custkey % 50 + 2 AS INTEGER) END AS n_components,
    CASE WHEN o_custkey % 7 <> 0 THEN CAST(o_custkey % 9 + 2 AS INTEGER) END AS k_value,
    CAST(o_custkey % 9 + 2 AS INTEGER) AS n_clusters_found,
    CASE WHEN o_orderkey % 50 = 0 THEN -1.0::DOUBLE
      ELSE (cents % 19001 - 9000)::DOUBLE / 10000 END AS silhouette_score,
    CASE WHEN o_orderkey % 50 = 0 THEN 0.0::DOUBLE
      ELSE (cents % 900001 + 1)::DOUBLE / 100 END AS calinski_harabasz_score,
    CASE WHEN o_orderkey % 50 = 0 THEN 'inf'::DOUBLE
      ELSE (cents % 50021 + 1)::DOUBLE / 10000 END AS davies_bouldin_score,
    (cents % 36007)::DOUBLE / 100 AS execution_time
  FROM (SELECT *, CAST(round(o_totalprice * 100) AS BIGINT) AS cents FROM orders))"""


def glossary(spark: SparkSession, folder: str) -> DataFrame:
    """Glossary: the distinct words of the part names and the part types."""
    part = table(spark, folder, "part")
    terms = F.concat(F.split("p_name", " "), F.array(F.lower("p_type")))
    return part.select(F.explode(terms).alias("Term")).distinct()


GLOSSARY = (
    "glossary AS (SELECT DISTINCT unnest(list_concat(string_split(p_name, ' '),"
    " [lower(p_type)])) AS Term FROM part)"
)


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder all executors see, for queries that write and read back."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c), digits) for c in columns})
