"""The experiment grid, its ids, and the tables that compare its results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from voxloom.functions.ranking import exact_quantiles

# The default grid of the clustering study.
K_ALGORITHMS = ["kmeans", "fuzzy_cmeans", "lda", "agglomerative"]
REDUCTIONS = ["none", "pca", "umap"]
COMPONENTS = [2, 10, 50, 100]
DBSCAN_SETTINGS = [(0.3, 5), (0.5, 5), (0.7, 5), (0.5, 3), (0.5, 10)]

# Score column, larger is better, test for a usable value.
METRICS = {
    "silhouette": ("silhouette_score", True),
    "calinski_harabasz": ("calinski_harabasz_score", True),
    "davies_bouldin": ("davies_bouldin_score", False),
}


def usable(metric: str) -> Column:
    """Whether the score is a real value and not the failure sentinel."""
    column = F.col(METRICS[metric][0])
    if metric == "silhouette":
        return column > -1
    if metric == "calinski_harabasz":
        return column > 0
    return column < F.lit(float("inf"))


def combination_id(
    algorithm: str = "algorithm",
    reduction: str = "reduction_method",
    components: str = "n_components",
    k: str = "k_value",
    eps: str | None = None,
    min_samples: str | None = None,
) -> Column:
    """Text id ``algorithm_reduction_compN_kN``; density runs end in their settings."""

    def number(prefix: str, name: str) -> Column:
        return F.concat(F.lit(prefix), F.coalesce(F.col(name).cast("string"), F.lit("None")))

    tail = number("k", k)
    if eps is not None:
        settings = F.concat(
            F.lit("eps"), F.col(eps).cast("string"), F.lit("_min"), F.col(min_samples).cast("string")
        )
        tail = F.when((F.col(algorithm) == "dbscan") & F.col(eps).isNotNull(), settings).otherwise(tail)
    return F.concat_ws("_", F.col(algorithm), F.col(reduction), number("comp", components), tail)


def _options(values: list, dtype: str) -> Column:
    return F.explode(F.array(*[F.lit(v).cast(dtype) for v in values]))


def grid(
    spark: SparkSession,
    dimension: int,
    k_min: int = 2,
    k_max: int = 10,
    algorithms: list[str] | None = None,
    reductions: list[str] | None = None,
    components: list[int] | None = None,
    dbscan: list[tuple[float, int]] | None = None,
    rows_for_umap: int | None = None,
) -> DataFrame:
    """All combinations to run, without those whose components do not fit.

    A combination is kept when its components are below ``dimension``; with
    ``rows_for_umap`` the neighbour-graph reduction is bounded by the row count
    instead.
    """
    algorithms = K_ALGORITHMS if algorithms is None else algorithms
    reductions = REDUCTIONS if reductions is None else reductions
    components = COMPONENTS if components is None else components
    dbscan = DBSCAN_SETTINGS if dbscan is None else dbscan
    start = spark.range(1).select(_options(reductions, "string").alias("reduction_method"))
    none = F.array(F.lit(None).cast("int"))
    some = F.array(*[F.lit(c) for c in components]) if components else F.array().cast("array<int>")
    base = start.select(
        "reduction_method",
        F.explode(F.when(F.col("reduction_method") == "none", none).otherwise(some)).alias(
            "n_components"
        ),
    )
    limit = F.lit(dimension)
    if rows_for_umap is not None:
        limit = F.when(F.col("reduction_method") == "umap", F.lit(rows_for_umap)).otherwise(limit)
    base = base.where(F.col("n_components").isNull() | (F.col("n_components") < limit))
    nothing = F.lit(None)
    parts = []
    if algorithms:
        with_k = base.withColumn("algorithm", _options(algorithms, "string"))
        with_k = with_k.withColumn("k_value", F.explode(F.sequence(F.lit(k_min), F.lit(k_max))))
        parts.append(
            with_k.withColumn("eps", nothing.cast("double")).withColumn(
                "min_samples", nothing.cast("int")
            )
        )
    if dbscan:
        settings = F.array(
            *[F.struct(F.lit(float(e)).alias("e"), F.lit(m).alias("m")) for e, m in dbscan]
        )
        density = base.withColumn("_s", F.explode(settings))
        parts.append(
            density.select(
                "reduction_method",
                "n_components",
                F.lit("dbscan").alias("algorithm"),
                nothing.cast("int").alias("k_value"),
                F.col("_s.e").alias("eps"),
                F.col("_s.m").alias("min_samples"),
            )
        )
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.withColumn("combination_id", combination_id(eps="eps", min_samples="min_samples"))


def best_per_metric(
    results: DataFrame, n: int = 5, order: str = "combination_id", only_usable: bool = True
) -> DataFrame:
    """The ``n`` best experiments by each metric; ties go to the smaller ``order``."""
    parts = []
    for metric, (column, larger) in METRICS.items():
        rows = results.where(usable(metric)) if only_usable else results
        score = F.col(column)
        parts.append(
            rows.orderBy(score.desc() if larger else score.asc(), F.col(order))
            .limit(n)
            .withColumn("metric", F.lit(metric))
            .withColumn("score", score)
        )
    ranked = parts[0].unionByName(parts[1]).unionByName(parts[2])
    key = F.when(F.col("metric") == "davies_bouldin", F.col("score")).otherwise(-F.col("score"))
    return ranked.withColumn(
        "place", F.row_number().over(W.partitionBy("metric").orderBy(key, order))
    )


def best_row_per_metric(results: DataFrame, order: str = "combination_id") -> DataFrame:
    """One row: the best experiment id and its score by each metric."""
    out = []
    for metric, (column, larger) in METRICS.items():
        score = F.when(usable(metric), F.col(column)) if metric == "davies_bouldin" else F.col(column)
        key = -score if larger else score
        rank = F.when(score.isNotNull(), F.struct(key.alias("k"), F.col(order).alias("o")))
        best = F.min(F.struct(rank.isNull().alias("missing"), rank.alias("rank")))
        value = best["rank"]["k"]
        out.append(best["rank"]["o"].alias(f"best_{metric}_id"))
        out.append((-value if larger else value).alias(f"best_{metric}"))
    return results.agg(*out)


def algorithm_averages(results: DataFrame, by: str = "algorithm") -> DataFrame:
    """Averages per algorithm, over all rows and over usable scores only."""
    plain, usable_only = [], []
    for metric, (column, _) in METRICS.items():
        plain.append(F.avg(column).alias(f"avg_{metric}"))
        usable_only.append(F.avg(F.when(usable(metric), F.col(column))).alias(f"avg_usable_{metric}"))
    return results.groupBy(by).agg(
        F.count(F.lit(1)).alias("combinations"),
        *plain,
        *usable_only,
        F.avg("execution_time").alias("avg_time"),
    )


def overall_statistics(results: DataFrame) -> DataFrame:
    """One row: mean, population deviation, maximum and minimum of usable scores."""
    out = [F.count(F.lit(1)).alias("combinations")]
    for metric, (column, _) in METRICS.items():
        value = F.when(usable(metric), F.col(column))
        out += [
            F.avg(value).alias(f"{metric}_mean"),
            F.stddev_pop(value).alias(f"{metric}_std"),
            F.max(value).alias(f"{metric}_max"),
            F.min(value).alias(f"{metric}_min"),
        ]
    return results.agg(*out)


def score_boxes(results: DataFrame, metric: str = "silhouette", by: str = "algorithm") -> DataFrame:
    """Minimum, quartiles and maximum of a score per group (box-plot data)."""
    column = METRICS[metric][0]
    box = exact_quantiles(results, column, [0.0, 0.25, 0.5, 0.75, 1.0], by=[by])
    names = ["low", "q25", "median", "q75", "high"]
    return box.select(by, *[F.col("quantiles")[i].alias(n) for i, n in enumerate(names)])


def reduction_comparison(results: DataFrame) -> DataFrame:
    """Mean and best silhouette for each reduction and algorithm."""
    return results.groupBy("reduction_method", "algorithm").agg(
        F.count(F.lit(1)).alias("combinations"),
        F.avg("silhouette_score").alias("mean_silhouette"),
        F.max("silhouette_score").alias("best_silhouette"),
    )


def k_against_silhouette(results: DataFrame) -> DataFrame:
    """Points of the k chart; runs without k are left out."""
    return results.where(F.col("k_value").isNotNull()).select(
        "combination_id", "algorithm", "k_value", "silhouette_score",
        "calinski_harabasz_score", "davies_bouldin_score", "execution_time",
    )


def score_matrix(results: DataFrame, n: int = 20, order: str = "combination_id") -> DataFrame:
    """Heat-map rows of the ``n`` best runs: silhouette, CH / 1000, 1 / (DB + 0.1)."""
    top = results.orderBy(F.col("silhouette_score").desc(), F.col(order)).limit(n)
    return top.select(
        "combination_id",
        F.col("silhouette_score").alias("silhouette"),
        (F.col("calinski_harabasz_score") / 1000).alias("calinski_harabasz"),
        (1 / (F.col("davies_bouldin_score") + 0.1)).alias("davies_bouldin"),
    )


def time_against_silhouette(results: DataFrame) -> DataFrame:
    return results.select("combination_id", "algorithm", "execution_time", "silhouette_score")


def best_results_report(results: DataFrame, n: int = 5) -> DataFrame:
    """The best runs by each metric beside the averages of their algorithm."""
    averages = algorithm_averages(results).select(
        "algorithm",
        F.col("combinations").alias("algorithm_runs"),
        F.col("avg_usable_silhouette").alias("algorithm_silhouette"),
    )
    best = best_per_metric(results, n).select(
        "metric", "combination_id", "score", "place", "algorithm"
    )
    return best.join(averages, "algorithm")


def best_runs(results: DataFrame, n: int = 5) -> DataFrame:
    """The best runs by each metric with what makes a run: reduction, components and k."""
    setting = results.select(
        "combination_id", "reduction_method", "n_components", "k_value", "n_clusters_found"
    )
    best = best_per_metric(results, n).select(
        "metric", "place", "combination_id", "score", "algorithm"
    )
    return best.join(setting, "combination_id")


def recommendation(results: DataFrame) -> DataFrame:
    """One row: the run with the best silhouette and its whole setting; none if no run has one."""
    best = best_per_metric(results, 1).where("metric = 'silhouette'").select("combination_id")
    return results.join(best, "combination_id").select(
        "combination_id", "algorithm", "reduction_method", "n_components", "k_value",
        "n_clusters_found", "silhouette_score", "execution_time",
    )
