"""Report tables of the run: filtering, clustering, generation, summary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxloom.checks import require_columns
from voxloom.operators.stats import cluster_sizes

FUNCTIONAL = "FUNCTIONAL"
NON_FUNCTIONAL = "NON_FUNCTIONAL"


def _ratio(part: Column, whole: Column, scale: float = 1.0) -> Column:
    return F.when(whole > 0, part * F.lit(float(scale)) / whole).otherwise(F.lit(0.0))


def _count(df: DataFrame) -> Column:
    return df.agg(F.count(F.lit(1))).scalar()


def _one_row(df: DataFrame, **columns: Column) -> DataFrame:
    return df.sparkSession.range(1).select(*[c.alias(n) for n, c in columns.items()])


def filtering_report(original: DataFrame, filtered: DataFrame, model: str, knowledge: str) -> DataFrame:
    """One row: counts before and after, percent kept, rows and percent removed."""
    require_columns(original, ["Review"])
    require_columns(filtered, ["Review"])
    out = _one_row(
        original,
        model=F.lit(model),
        knowledge=F.lit(knowledge),
        original_count=_count(original),
        filtered_count=_count(filtered),
    )
    out = out.withColumn(
        "remaining_percent", _ratio(F.col("filtered_count"), F.col("original_count"), 100)
    )
    return out.withColumn(
        "removed_count", F.col("original_count") - F.col("filtered_count")
    ).withColumn("removed_percent", 100.0 - F.col("remaining_percent"))


def clustering_report(df: DataFrame, algorithm: str, reduction: str) -> DataFrame:
    """Cluster sizes with shares, and the run's totals on each line."""
    sizes = cluster_sizes(df)
    per_cluster = df.groupBy("Cluster").agg(F.count(F.lit(1)).alias("_n"))
    totals = per_cluster.agg(
        F.struct(
            F.sum("_n").alias("total"),
            F.count(F.lit(1)).alias("clusters"),
            F.avg("_n").alias("mean"),
        )
    ).scalar()
    return (
        sizes.withColumn("_t", totals)
        .select(
            F.lit(algorithm).alias("algorithm"),
            F.lit(reduction).alias("reduction"),
            "Cluster",
            "size",
            "percent",
            F.col("_t.total").alias("total_reviews"),
            F.col("_t.clusters").alias("n_clusters"),
            F.col("_t.mean").alias("mean_cluster_size"),
        )
        .orderBy("Cluster")
    )


def _by_type(df: DataFrame) -> Column:
    """Functional, non-functional and all requirements, as one scalar struct."""
    kind = F.upper("type")
    return df.agg(
        F.struct(
            F.count_if(kind == FUNCTIONAL).alias("fr"),
            F.count_if(kind == NON_FUNCTIONAL).alias("nfr"),
            F.count(F.lit(1)).alias("total"),
        )
    ).scalar()


def generation_report(initial: DataFrame, unified: DataFrame, model: str, provider: str) -> DataFrame:
    """One row: requirements by type before and after unification, and the change."""
    require_columns(initial, ["cluster", "requirement_id", "type", "description", "based_on_comments"])
    require_columns(unified, ["requirement_id", "type", "description", "based_on_comments"])
    i, u = F.col("_i"), F.col("_u")
    reduction = _ratio(i["total"] - u["total"], i["total"], 100)
    counts = _one_row(initial, _i=_by_type(initial), _u=_by_type(unified))
    return counts.select(
        F.lit(model).alias("model"),
        F.lit(provider).alias("provider"),
        i["fr"].alias("initial_functional"),
        i["nfr"].alias("initial_non_functional"),
        i["total"].alias("initial_total"),
        u["fr"].alias("unified_functional"),
        u["nfr"].alias("unified_non_functional"),
        u["total"].alias("unified_total"),
        (i["fr"] - u["fr"]).alias("eliminated_functional"),
        (i["nfr"] - u["nfr"]).alias("eliminated_non_functional"),
        (i["total"] - u["total"]).alias("eliminated_total"),
        reduction.alias("reduction_percent"),
        (100.0 - reduction).alias("retained_percent"),
        _ratio(u["fr"], i["fr"], 100).alias("functional_retention"),
        _ratio(u["nfr"], i["nfr"], 100).alias("non_functional_retention"),
        F.when(reduction > 30, "high").when(reduction > 10, "moderate").otherwise("low")
        .alias("redundancy"),
    )


def requirement_summary(initial: DataFrame, unified: DataFrame) -> DataFrame:
    """One row: totals by type, clusters processed, consolidation ratio."""
    i, u = F.col("_i"), F.col("_u")
    clusters = initial.agg(F.count_distinct("cluster")).scalar()
    counts = _one_row(initial, _i=_by_type(initial), _u=_by_type(unified), _k=clusters)
    return counts.select(
        i["total"].alias("initial_total"),
        i["fr"].alias("initial_functional"),
        i["nfr"].alias("initial_non_functional"),
        F.col("_k").alias("clusters_processed"),
        u["total"].alias("unified_total"),
        u["fr"].alias("unified_functional"),
        u["nfr"].alias("unified_non_functional"),
        _ratio(u["total"], i["total"]).alias("consolidation_ratio"),
    )


def run_summary(
    reviews: DataFrame,
    relevant: DataFrame,
    clustered: DataFrame,
    initial: DataFrame,
    unified: DataFrame,
    **metadata: str,
) -> DataFrame:
    """The nested one-row result of a run: filtering, clustering, generation."""
    sizes = clustered.groupBy("Cluster").agg(F.count(F.lit(1)).alias("n"))
    clustering = sizes.agg(
        F.struct(
            F.count(F.lit(1)).alias("n_clusters"),
            F.coalesce(F.sum("n"), F.lit(0)).alias("clustered_reviews"),
            F.map_from_entries(
                F.sort_array(F.collect_list(F.struct(F.col("Cluster"), F.col("n"))))
            ).alias("cluster_distribution"),
        )
    ).scalar()
    out = _one_row(
        reviews,
        _n=_count(reviews),
        _kept=_count(relevant),
        clustering=clustering,
        _i=_count(initial),
        _u=_count(unified),
    )
    return out.select(
        F.struct(*[F.lit(v).alias(k) for k, v in sorted(metadata.items())] or [F.lit(None).alias("note")])
        .alias("metadata"),
        F.struct(
            F.col("_n").alias("original_reviews"),
            F.col("_kept").alias("relevant_reviews"),
            _ratio(F.col("_kept"), F.col("_n")).alias("retention_rate"),
        ).alias("filtering"),
        "clustering",
        F.struct(
            F.col("_i").alias("initial_requirements"),
            F.col("_u").alias("unified_requirements"),
            _ratio(F.col("_u"), F.col("_i")).alias("consolidation_ratio"),
        ).alias("generation"),
    )
