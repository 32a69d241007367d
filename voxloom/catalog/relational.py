"""Filters, projections, deduplication, numbering, statistics, reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxloom.catalog import inputs as I
from voxloom.checks import null_counts
from voxloom.operators import cleaning, reports, scoring, stats

QUERIES: dict = {}
SQL: dict = {}


def query(name: str, sql: str | None = None):
    def add(run):
        QUERIES[name] = run
        if sql is not None:
            SQL[name] = sql
        return run

    return add


# Orders priorities as free text with blanks, padding and null markers.
_MESSY = (
    "messy AS (SELECT o_orderkey AS review_id, CASE o_custkey % 5 WHEN 0 THEN NULL"
    " WHEN 1 THEN ' ' || chr(9) || chr(160) WHEN 2 THEN 'NA' WHEN 3 THEN o_orderstatus"
    " ELSE o_orderpriority || chr(10) END AS Review FROM orders)"
)


def _messy(spark, folder):
    kind = F.col("o_custkey") % 5
    return I.table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("review_id"),
        F.when(kind == 0, F.lit(None).cast("string"))
        .when(kind == 1, F.lit(" \t "))
        .when(kind == 2, F.lit("NA"))
        .when(kind == 3, F.col("o_orderstatus"))
        .otherwise(F.concat("o_orderpriority", F.lit("\n")))
        .alias("Review"),
    )


@query(
    "f1_drop_unusable",
    f"WITH {_MESSY} SELECT review_id, Review FROM messy WHERE Review IS NOT NULL"
    " AND Review <> 'NA' AND regexp_matches(Review, '[A-Za-z0-9]')",
)
def f1(spark, folder):
    return cleaning.drop_unusable(_messy(spark, folder))


@query(
    "f2_as_text",
    f"WITH {I.EXPERIMENTS} SELECT combination_id, CAST(k_value AS VARCHAR) AS k_value"
    " FROM experiments WHERE k_value IS NOT NULL",
)
def f2(spark, folder):
    df = I.experiments(spark, folder).select("combination_id", "k_value")
    return cleaning.as_text(df, "k_value")


@query(
    "f3_text_windows",
    "SELECT review_id, CAST(i AS INTEGER) AS piece_no,"
    " substr(Review, CAST(i * 500 + 1 AS BIGINT), 500) AS piece FROM ("
    f" WITH {I.REVIEWS} SELECT review_id, Review,"
    " unnest(range(0, greatest(CAST(ceil(length(Review) / 500.0) AS BIGINT), 1))) AS i FROM reviews)",
)
def f3(spark, folder):
    return cleaning.text_windows(I.reviews(spark, folder))


@query("f4_keep_relevant", f"WITH {I.SCORED} SELECT * FROM scored WHERE prediction_score > 0.5")
def f4(spark, folder):
    return scoring.keep_relevant(I.scored(spark, folder))


@query("f5_threshold", f"WITH {I.SCORED} SELECT review_id, binary_prediction FROM scored")
def f5(spark, folder):
    return I.scored(spark, folder).select("review_id", "binary_prediction")


@query(
    "f6_confidence_range",
    f"WITH {I.SCORED} SELECT review_id, Review, prediction_score FROM scored"
    " WHERE prediction_score BETWEEN 0.25 AND 0.75",
)
def f6(spark, folder):
    return scoring.confidence_range(I.scored(spark, folder), 0.25, 0.75, include_binary=False)


@query("f7_project", f"WITH {I.CLUSTERED} SELECT Review, Cluster FROM clustered")
def f7(spark, folder):
    return I.clustered(spark, folder).select("Review", "Cluster")


@query(
    "f8_per_cluster",
    f"WITH {I.CLUSTERED} SELECT Cluster, count(*) AS n, min(review_id) AS first_id,"
    " max(review_id) AS last_id, sum(length(Review))::BIGINT AS chars FROM clustered GROUP BY Cluster",
)
def f8(spark, folder):
    return (
        I.clustered(spark, folder)
        .groupBy("Cluster")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.min("review_id").alias("first_id"),
            F.max("review_id").alias("last_id"),
            F.sum(F.length("Review")).alias("chars"),
        )
    )


@query(
    "f9_null_counts",
    f"WITH {_MESSY} SELECT count(*) AS n_rows, count(*) FILTER (review_id IS NULL) AS review_id_nulls,"
    " count(*) FILTER (Review IS NULL) AS Review_nulls FROM messy",
)
def f9(spark, folder):
    return null_counts(_messy(spark, folder), ["review_id", "Review"])


@query(
    "f10_drop_noise",
    f"WITH {I.EMBEDDINGS} SELECT review_id, l AS label FROM (SELECT review_id,"
    " CASE WHEN label = 9 THEN -1 ELSE label END AS l FROM emb) WHERE l <> -1",
)
def f10(spark, folder):
    label = F.when(F.col("label") == 9, -1).otherwise(F.col("label"))
    df = I.embeddings(spark, folder).select("review_id", label.alias("label"))
    return cleaning.drop_noise(df)


@query(
    "d1_keep_first",
    f"WITH {I.REVIEWS} SELECT min(review_id) AS review_id, Review FROM reviews GROUP BY Review",
)
def d1(spark, folder):
    return cleaning.keep_first(I.reviews(spark, folder))


@query(
    "d1_duplicate_summary",
    f"WITH {I.REVIEWS} SELECT count(*) AS original_size, count(DISTINCT Review) AS final_size,"
    " count(*) - count(DISTINCT Review) AS duplicates_removed,"
    " round((count(*) - count(DISTINCT Review)) * 100.0::DOUBLE / count(*), 6) AS removed_percent"
    " FROM reviews",
)
def d1_summary(spark, folder):
    return I.rounded(cleaning.duplicate_summary(I.reviews(spark, folder)), "removed_percent")


@query(
    "d2_distinct_assignments",
    f"WITH {I.CLUSTERED} SELECT DISTINCT Review, Cluster FROM clustered",
)
def d2(spark, folder):
    return cleaning.distinct_assignments(I.clustered(spark, folder))


_NUMBERED = (
    "numbered AS (SELECT row_number() OVER (ORDER BY Cluster, first_id) AS ID, Review, Cluster"
    " FROM (SELECT Cluster, Review, min(review_id) AS first_id FROM clustered GROUP BY ALL))"
)


@query("d3_numbered_clusters", f"WITH {I.CLUSTERED}, {_NUMBERED} SELECT ID, Review, Cluster FROM numbered")
def d3(spark, folder):
    return cleaning.numbered_clusters(I.clustered(spark, folder))


@query(
    "d5_most_uncertain",
    f"WITH {I.SCORED} SELECT review_id, prediction_score, binary_prediction FROM scored"
    " WHERE prediction_score >= 0.4 AND prediction_score <= 0.6"
    " ORDER BY abs(prediction_score - 0.5), review_id",
)
def d5(spark, folder):
    df = scoring.most_uncertain(I.scored(spark, folder))
    return df.select("review_id", "prediction_score", "binary_prediction")


@query(
    "d9_first_per_cluster",
    f"WITH {I.CLUSTERED} SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY Cluster"
    " ORDER BY review_id) AS INTEGER) AS sample_no FROM clustered) WHERE sample_no <= 3",
)
def d9(spark, folder):
    return cleaning.first_per_cluster(I.clustered(spark, folder))


@query(
    "d10_distinct_clusters",
    f"WITH {I.CLUSTERED} SELECT DISTINCT Cluster FROM clustered ORDER BY Cluster",
)
def d10(spark, folder):
    return cleaning.distinct_clusters(I.clustered(spark, folder))


_BANDS = """
  count(*) FILTER (prediction_score >= 0.8 AND binary_prediction = 1) AS very_confident_relevant,
  count(*) FILTER (prediction_score >= 0.6 AND prediction_score < 0.8 AND binary_prediction = 1)
    AS confident_relevant,
  count(*) FILTER (prediction_score >= 0.4 AND prediction_score <= 0.6) AS uncertain,
  count(*) FILTER (prediction_score > 0.2 AND prediction_score < 0.4 AND binary_prediction = 0)
    AS confident_irrelevant,
  count(*) FILTER (prediction_score <= 0.2 AND binary_prediction = 0) AS very_confident_irrelevant"""


@query(
    "a1_prediction_statistics",
    f"""WITH {I.SCORED} SELECT count(*) AS total_comments,
  sum(binary_prediction)::BIGINT AS relevant_comments,
  (count(*) - sum(binary_prediction))::BIGINT AS irrelevant_comments,
  round(avg(binary_prediction), 6) AS relevance_rate, round(avg(prediction_score), 6) AS mean,
  round(stddev_samp(prediction_score), 6) AS std, min(prediction_score) AS min,
  max(prediction_score) AS max, round(quantile_cont(prediction_score, 0.5), 6) AS median,
  round(quantile_cont(prediction_score, 0.25), 6) AS q25,
  round(quantile_cont(prediction_score, 0.75), 6) AS q75, {_BANDS} FROM scored""",
)
def a1(spark, folder):
    out = stats.prediction_statistics(I.scored(spark, folder))
    return I.rounded(out, "relevance_rate", "mean", "std", "median", "q25", "q75")


@query("a2_confidence_bands", f"WITH {I.SCORED} SELECT {_BANDS} FROM scored")
def a2(spark, folder):
    return stats.confidence_bands(I.scored(spark, folder))


@query(
    "a3_cluster_sizes",
    f"WITH {I.CLUSTERED} SELECT Cluster, count(*) AS size,"
    " round(count(*) * 100.0::DOUBLE / sum(count(*)) OVER (), 6) AS percent"
    " FROM clustered GROUP BY Cluster",
)
def a3(spark, folder):
    return I.rounded(stats.cluster_sizes(I.clustered(spark, folder)), "percent")


_TOTALS = (
    f"WITH {I.CLUSTERED} SELECT count(DISTINCT Cluster) AS n_clusters, count(*) AS n_texts,"
    " round(count(*)::DOUBLE / count(DISTINCT Cluster), 6) AS mean_size FROM clustered"
)


@query("a4_cluster_totals", _TOTALS)
def a4(spark, folder):
    return I.rounded(stats.cluster_totals(I.clustered(spark, folder)), "mean_size")


@query(
    "a5_filtering_report",
    f"""WITH {I.SCORED}, c AS (SELECT count(*) AS o, sum(binary_prediction)::BIGINT AS f FROM scored)
SELECT 'lexical' AS model, 'RC' AS knowledge, o AS original_count, f AS filtered_count,
  round(f * 100.0::DOUBLE / o, 6) AS remaining_percent, o - f AS removed_count,
  round(100 - f * 100.0::DOUBLE / o, 6) AS removed_percent FROM c""",
)
def a5(spark, folder):
    scored = I.scored(spark, folder)
    out = reports.filtering_report(scored, scoring.keep_relevant(scored), "lexical", "RC")
    return I.rounded(out, "remaining_percent", "removed_percent")


@query(
    "a6_clustering_report",
    f"""WITH {I.CLUSTERED}, s AS (SELECT Cluster, count(*) AS size FROM clustered GROUP BY Cluster)
SELECT 'k-means' AS algorithm, 'None' AS reduction, Cluster, size,
  round(size * 100.0::DOUBLE / sum(size) OVER (), 6) AS percent,
  (sum(size) OVER ())::BIGINT AS total_reviews, count(*) OVER () AS n_clusters,
  round(avg(size) OVER (), 6) AS mean_cluster_size FROM s""",
)
def a6(spark, folder):
    out = reports.clustering_report(I.clustered(spark, folder), "k-means", "None")
    return I.rounded(out, "percent", "mean_cluster_size")


# Requirement tables over the parts: one requirement per part, repeats unified.
_REQS = """initial AS (SELECT CAST(p_size % 10 AS INTEGER) AS cluster,
    'R' || p_partkey AS requirement_id,
    CASE WHEN p_size % 3 = 0 THEN 'Non_Functional' ELSE 'FUNCTIONAL' END AS type,
    'The system shall offer a ' || p_name AS description,
    CAST(p_size AS VARCHAR) AS based_on_comments FROM part),
  unified AS (SELECT min(requirement_id) AS requirement_id, type, description,
    min(based_on_comments) AS based_on_comments FROM initial GROUP BY type, description)"""


def _requirements(spark, folder):
    initial = I.table(spark, folder, "part").select(
        (F.col("p_size") % 10).cast("int").alias("cluster"),
        F.concat(F.lit("R"), "p_partkey").alias("requirement_id"),
        F.when(F.col("p_size") % 3 == 0, "Non_Functional").otherwise("FUNCTIONAL").alias("type"),
        F.concat(F.lit("The system shall offer a "), "p_name").alias("description"),
        F.col("p_size").cast("string").alias("based_on_comments"),
    )
    unified = initial.groupBy("type", "description").agg(
        F.min("requirement_id").alias("requirement_id"),
        F.min("based_on_comments").alias("based_on_comments"),
    )
    return initial, unified


_TYPES = """i AS (SELECT count(*) FILTER (upper(type) = 'FUNCTIONAL') AS fr,
    count(*) FILTER (upper(type) = 'NON_FUNCTIONAL') AS nfr, count(*) AS n,
    count(DISTINCT cluster) AS k FROM initial),
  u AS (SELECT count(*) FILTER (upper(type) = 'FUNCTIONAL') AS fr,
    count(*) FILTER (upper(type) = 'NON_FUNCTIONAL') AS nfr, count(*) AS n FROM unified)"""


@query(
    "a7_generation_report",
    f"""WITH {_REQS}, {_TYPES}, r AS (SELECT (i.n - u.n) * 100.0::DOUBLE / i.n AS red FROM i, u)
SELECT 'stub' AS model, 'local' AS provider, i.fr AS initial_functional,
  i.nfr AS initial_non_functional, i.n AS initial_total, u.fr AS unified_functional,
  u.nfr AS unified_non_functional, u.n AS unified_total, i.fr - u.fr AS eliminated_functional,
  i.nfr - u.nfr AS eliminated_non_functional, i.n - u.n AS eliminated_total,
  round(red, 6) AS reduction_percent, round(100 - red, 6) AS retained_percent,
  round(u.fr * 100.0::DOUBLE / i.fr, 6) AS functional_retention,
  round(u.nfr * 100.0::DOUBLE / i.nfr, 6) AS non_functional_retention,
  CASE WHEN red > 30 THEN 'high' WHEN red > 10 THEN 'moderate' ELSE 'low' END AS redundancy
FROM i, u, r""",
)
def a7(spark, folder):
    out = reports.generation_report(*_requirements(spark, folder), "stub", "local")
    return I.rounded(
        out, "reduction_percent", "retained_percent", "functional_retention",
        "non_functional_retention",
    )


@query(
    "a8_run_summary",
    f"""WITH {I.SCORED}, {I.CLUSTERED}, {_REQS}, s AS (SELECT count(*) AS n,
  sum(binary_prediction)::BIGINT AS kept FROM scored),
  sizes AS (SELECT Cluster, count(*) AS n FROM clustered GROUP BY Cluster)
SELECT 'demo' AS application, s.n AS original_reviews, s.kept AS relevant_reviews,
  round(s.kept::DOUBLE / s.n, 6) AS retention_rate, (SELECT count(*) FROM sizes) AS n_clusters,
  (SELECT string_agg(Cluster || ':' || n, ',' ORDER BY Cluster) FROM sizes) AS distribution,
  (SELECT count(*) FROM initial) AS initial_requirements,
  (SELECT count(*) FROM unified) AS unified_requirements,
  round((SELECT count(*) FROM unified)::DOUBLE / (SELECT count(*) FROM initial), 6)
    AS consolidation_ratio FROM s""",
)
def a8(spark, folder):
    scored = I.scored(spark, folder)
    out = reports.run_summary(
        scored,
        scoring.keep_relevant(scored),
        I.clustered(spark, folder),
        *_requirements(spark, folder),
        application="demo",
    )
    pairs = F.transform(
        F.sort_array(F.map_entries("clustering.cluster_distribution")),
        lambda e: F.concat_ws(":", e["key"], e["value"]),
    )
    return out.select(
        F.col("metadata.application").alias("application"),
        "filtering.original_reviews",
        "filtering.relevant_reviews",
        F.round("filtering.retention_rate", 6).alias("retention_rate"),
        "clustering.n_clusters",
        F.array_join(pairs, ",").alias("distribution"),
        "generation.initial_requirements",
        "generation.unified_requirements",
        F.round("generation.consolidation_ratio", 6).alias("consolidation_ratio"),
    )


@query(
    "a9_requirement_summary",
    f"""WITH {_REQS}, {_TYPES} SELECT i.n AS initial_total, i.fr AS initial_functional,
  i.nfr AS initial_non_functional, i.k AS clusters_processed, u.n AS unified_total,
  u.fr AS unified_functional, u.nfr AS unified_non_functional,
  round(u.n::DOUBLE / i.n, 6) AS consolidation_ratio FROM i, u""",
)
def a9(spark, folder):
    out = reports.requirement_summary(*_requirements(spark, folder))
    return I.rounded(out, "consolidation_ratio")


@query(
    "a13_mean_text_length",
    f"WITH {I.CLUSTERED} SELECT Cluster, round(avg(length(Review)), 6) AS avg_text_length"
    " FROM clustered GROUP BY Cluster",
)
def a13(spark, folder):
    return I.rounded(stats.mean_text_length(I.clustered(spark, folder)), "avg_text_length")


@query("a16_cluster_analysis_summary", _TOTALS)
def a16(spark, folder):
    return I.rounded(stats.cluster_totals(I.clustered(spark, folder)), "mean_size")
