"""Write-and-read-back queries over the readers and writers."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxloom.catalog import inputs as I
from voxloom.sources import readers, writers

QUERIES: dict = {}
SQL: dict = {}


def query(name: str, sql: str | None = None):
    def add(run):
        QUERIES[name] = run
        if sql is not None:
            SQL[name] = sql
        return run

    return add


@query("s1_read_reviews", f"WITH {I.REVIEWS} SELECT review_id, Review FROM reviews")
def s1(spark, folder):
    path = writers.write_csv(I.reviews(spark, folder), I.scratch(spark, "reviews"))
    return readers.read_reviews(spark, path).select("review_id", "Review")


@query("s2_read_labelled", f"WITH {I.LABELLED} SELECT review_id, Review, Relevant FROM labelled")
def s2(spark, folder):
    path = writers.write_csv(I.labelled(spark, folder), I.scratch(spark, "labelled"))
    return readers.read_labelled(spark, path).select("review_id", "Review", "Relevant")


@query(
    "s3_read_glossary",
    f"WITH {I.GLOSSARY} SELECT Term FROM glossary",
)
def s3(spark, folder):
    padded = I.glossary(spark, folder).select(
        F.concat(F.lit(" \t"), "Term", F.lit("\n ")).alias("term")
    )
    path = writers.write_csv(padded, I.scratch(spark, "glossary"))
    return readers.read_glossary(spark, path)


_EMB_SQL = (
    f"WITH {I.EMBEDDINGS} SELECT review_id, CAST(review_id AS VARCHAR) AS text,"
    " CAST(len(features) AS INTEGER) AS dimension, round(list_sum(features), 6) AS total,"
    " round(features[1], 6) AS first, round(features[64], 6) AS last FROM emb"
)


def _emb_view(df, vector="embeddings"):
    v = F.col(vector)
    return df.select(
        "review_id",
        "text",
        F.size(v).alias("dimension"),
        F.round(F.aggregate(v, F.lit(0.0), lambda s, x: s + x), 6).alias("total"),
        F.round(v[0], 6).alias("first"),
        F.round(v[63], 6).alias("last"),
    )


@query("s4_read_embeddings", _EMB_SQL)
def s4(spark, folder):
    source = I.embeddings(spark, folder).select("review_id", F.col("features").alias("embeddings"))
    path = writers.write_embeddings(source, I.scratch(spark, "emb"))
    return _emb_view(readers.read_embeddings(spark, path))


@query("s5_read_literal_lists", _EMB_SQL)
def s5(spark, folder):
    items = F.array_join(F.transform("features", lambda v: v.cast("string")), ", ")
    source = I.embeddings(spark, folder).select(
        "review_id", F.concat(F.lit("["), items, F.lit("]")).alias("embeddings")
    )
    path = writers.write_csv(source, I.scratch(spark, "lists"))
    return _emb_view(readers.read_embeddings(spark, path))


@query(
    "s6_read_clustered",
    f"WITH {I.CLUSTERED} SELECT review_id, Review, Cluster FROM clustered WHERE Cluster <> 0",
)
def s6(spark, folder):
    source = I.clustered(spark, folder).select(
        F.col("review_id").alias(" review_id"),
        F.col("Review").alias("Review "),
        F.when(F.col("Cluster") != 0, F.col("Cluster")).alias(" Cluster "),
    )
    path = writers.write_csv(source, I.scratch(spark, "clustered"))
    df = readers.read_clustered(spark, path)
    return df.withColumn("review_id", F.col("review_id").cast("bigint"))


@query(
    "s7_write_embeddings",
    f"WITH {I.EMBEDDINGS} SELECT review_id, label, round(list_sum(features), 6) AS total FROM emb",
)
def s7(spark, folder):
    path = writers.write_embeddings(
        I.embeddings(spark, folder), I.scratch(spark, "out"), embeddings="features"
    )
    df = readers.read_embeddings(spark, path, embeddings="features", text="label")
    total = F.aggregate("features", F.lit(0.0), lambda s, x: s + x)
    return df.select("review_id", F.col("label").cast("int"), F.round(total, 6).alias("total"))


@query(
    "s8_write_run_tables",
    f"WITH {I.CLUSTERED} SELECT review_id AS ID, Review, Cluster FROM clustered",
)
def s8(spark, folder):
    tables = I.clustered(spark, folder).withColumnRenamed("review_id", "ID")
    paths = writers.write_run_tables(
        writers.run_folder(I.scratch(spark, "run")), clustered_reviews=tables
    )
    df = readers.read_clustered(spark, paths["clustered_reviews"])
    return df.withColumn("ID", F.col("ID").cast("bigint"))


@query(
    "s9_write_assignments",
    f"WITH {I.CLUSTERED} SELECT review_id AS original_index, Review AS text, c AS cluster,"
    " 'multi' AS combination_id, len(a) > 1 AS is_multiple_membership FROM ("
    " SELECT *, unnest(a) AS c FROM (SELECT *, CASE WHEN Cluster < 5 THEN [Cluster, 20]"
    " ELSE [Cluster] END AS a FROM clustered))",
)
def s9(spark, folder):
    own = F.col("Cluster")
    df = I.clustered(spark, folder).withColumn(
        "assignments", F.when(own < 5, F.array(own, F.lit(20))).otherwise(F.array(own))
    )
    rows = writers.assignment_rows(df, "multi", text="Review")
    path = writers.write_assignments(rows, I.scratch(spark, "assignments"))
    return spark.read.parquet(path)


@query(
    "s11_write_summary",
    f"WITH {I.EXPERIMENTS} SELECT combination_id, algorithm, n_components, k_value,"
    " silhouette_score, execution_time FROM experiments",
)
def s11(spark, folder):
    from voxloom.schemas import EXPERIMENTS

    path = writers.write_csv(I.experiments(spark, folder), I.scratch(spark, "summary"))
    return readers.read_csv(spark, path, EXPERIMENTS).select(
        "combination_id", "algorithm", "n_components", "k_value", "silhouette_score",
        "execution_time",
    )
