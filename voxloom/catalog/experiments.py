"""Grid, ids and comparison tables of the clustering study."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxloom.catalog import inputs as I
from voxloom.operators import experiments as X

QUERIES: dict = {}
SQL: dict = {}


def query(name: str, sql: str | None = None):
    def add(run):
        QUERIES[name] = run
        if sql is not None:
            SQL[name] = sql
        return run

    return add


@query(
    "f11_usable_scores",
    f"""WITH {I.EXPERIMENTS} SELECT count(*) FILTER (silhouette_score > -1) AS silhouette,
  count(*) FILTER (calinski_harabasz_score > 0) AS calinski_harabasz,
  count(*) FILTER (davies_bouldin_score < 'inf'::DOUBLE) AS davies_bouldin FROM experiments""",
)
def f11(spark, folder):
    return I.experiments(spark, folder).agg(*[F.count_if(X.usable(m)).alias(m) for m in X.METRICS])


_BEST = """
  SELECT * FROM (SELECT 'silhouette' AS metric, combination_id, silhouette_score AS score,
    row_number() OVER (ORDER BY silhouette_score DESC, combination_id) AS place
    FROM experiments WHERE silhouette_score > -1)
  UNION ALL SELECT * FROM (SELECT 'calinski_harabasz', combination_id, calinski_harabasz_score,
    row_number() OVER (ORDER BY calinski_harabasz_score DESC, combination_id)
    FROM experiments WHERE calinski_harabasz_score > 0)
  UNION ALL SELECT * FROM (SELECT 'davies_bouldin', combination_id, davies_bouldin_score,
    row_number() OVER (ORDER BY davies_bouldin_score, combination_id)
    FROM experiments WHERE davies_bouldin_score < 'inf'::DOUBLE)"""


@query(
    "d6_best_per_metric",
    f"WITH {I.EXPERIMENTS}, b AS ({_BEST}) SELECT metric, combination_id, score,"
    " CAST(place AS INTEGER) AS place FROM b WHERE place <= 10",
)
def d6(spark, folder):
    best = X.best_per_metric(I.experiments(spark, folder), 10)
    return best.select("metric", "combination_id", "score", "place")


@query(
    "d7_best_row_per_metric",
    f"""WITH {I.EXPERIMENTS}, b AS ({_BEST}) SELECT
  max(combination_id) FILTER (metric = 'silhouette') AS best_silhouette_id,
  max(score) FILTER (metric = 'silhouette') AS best_silhouette,
  max(combination_id) FILTER (metric = 'calinski_harabasz') AS best_calinski_harabasz_id,
  max(score) FILTER (metric = 'calinski_harabasz') AS best_calinski_harabasz,
  max(combination_id) FILTER (metric = 'davies_bouldin') AS best_davies_bouldin_id,
  max(score) FILTER (metric = 'davies_bouldin') AS best_davies_bouldin FROM b WHERE place = 1""",
)
def d7(spark, folder):
    return X.best_row_per_metric(I.experiments(spark, folder))


@query(
    "a10_algorithm_averages",
    f"""WITH {I.EXPERIMENTS} SELECT algorithm, count(*) AS combinations,
  round(avg(silhouette_score), 6) AS avg_silhouette,
  round(avg(calinski_harabasz_score), 4) AS avg_calinski_harabasz,
  avg(davies_bouldin_score) = 'inf'::DOUBLE AS davies_bouldin_infinite,
  round(avg(silhouette_score) FILTER (silhouette_score > -1), 6) AS avg_usable_silhouette,
  round(avg(calinski_harabasz_score) FILTER (calinski_harabasz_score > 0), 4)
    AS avg_usable_calinski_harabasz,
  round(avg(davies_bouldin_score) FILTER (davies_bouldin_score < 'inf'::DOUBLE), 6)
    AS avg_usable_davies_bouldin,
  round(avg(execution_time), 6) AS avg_time FROM experiments GROUP BY algorithm""",
)
def a10(spark, folder):
    df = X.algorithm_averages(I.experiments(spark, folder))
    df = df.withColumn("davies_bouldin_infinite", F.col("avg_davies_bouldin") == float("inf"))
    df = I.rounded(df, "avg_calinski_harabasz", "avg_usable_calinski_harabasz", digits=4)
    return I.rounded(
        df.drop("avg_davies_bouldin"), "avg_silhouette", "avg_usable_silhouette",
        "avg_usable_davies_bouldin", "avg_time",
    )


_STAT_SQL = ",\n".join(
    f"round({fn}(CASE WHEN {ok} THEN {col} END), 4) AS {name}_{suffix}"
    for name, col, ok in (
        ("silhouette", "silhouette_score", "silhouette_score > -1"),
        ("calinski_harabasz", "calinski_harabasz_score", "calinski_harabasz_score > 0"),
        ("davies_bouldin", "davies_bouldin_score", "davies_bouldin_score < 'inf'::DOUBLE"),
    )
    for fn, suffix in (("avg", "mean"), ("stddev_pop", "std"), ("max", "max"), ("min", "min"))
)


@query(
    "a11_overall_statistics",
    f"WITH {I.EXPERIMENTS} SELECT count(*) AS combinations, {_STAT_SQL} FROM experiments",
)
def a11(spark, folder):
    df = X.overall_statistics(I.experiments(spark, folder))
    return I.rounded(df, *[c for c in df.columns if c != "combinations"], digits=4)


@query(
    "a12_score_boxes",
    f"""WITH {I.EXPERIMENTS} SELECT algorithm, round(min(silhouette_score), 6) AS low,
  round(quantile_cont(silhouette_score, 0.25), 6) AS q25,
  round(quantile_cont(silhouette_score, 0.5), 6) AS median,
  round(quantile_cont(silhouette_score, 0.75), 6) AS q75,
  round(max(silhouette_score), 6) AS high FROM experiments GROUP BY algorithm""",
)
def a12_boxes(spark, folder):
    df = X.score_boxes(I.experiments(spark, folder))
    return I.rounded(df, "low", "q25", "median", "q75", "high")


@query(
    "a12_reduction_comparison",
    f"""WITH {I.EXPERIMENTS} SELECT reduction_method, algorithm, count(*) AS combinations,
  round(avg(silhouette_score), 6) AS mean_silhouette, max(silhouette_score) AS best_silhouette
  FROM experiments GROUP BY ALL""",
)
def a12_reduction(spark, folder):
    return I.rounded(X.reduction_comparison(I.experiments(spark, folder)), "mean_silhouette")


@query(
    "a12_k_against_silhouette",
    f"WITH {I.EXPERIMENTS} SELECT combination_id, algorithm, k_value, silhouette_score,"
    " execution_time FROM experiments WHERE k_value IS NOT NULL",
)
def a12_k(spark, folder):
    df = X.k_against_silhouette(I.experiments(spark, folder))
    return df.drop("calinski_harabasz_score", "davies_bouldin_score")


@query(
    "a12_score_matrix",
    f"""WITH {I.EXPERIMENTS} SELECT combination_id, round(silhouette_score, 6) AS silhouette,
  round(calinski_harabasz_score / 1000, 6) AS calinski_harabasz,
  round(1 / (davies_bouldin_score + 0.1), 6) AS davies_bouldin FROM experiments
  ORDER BY silhouette_score DESC, combination_id LIMIT 20""",
)
def a12_matrix(spark, folder):
    df = X.score_matrix(I.experiments(spark, folder))
    return I.rounded(df, "silhouette", "calinski_harabasz", "davies_bouldin")


@query(
    "a12_time_against_silhouette",
    f"WITH {I.EXPERIMENTS} SELECT combination_id, algorithm, execution_time, silhouette_score"
    " FROM experiments",
)
def a12_time(spark, folder):
    return X.time_against_silhouette(I.experiments(spark, folder))


@query(
    "t13_combination_id",
    f"""WITH {I.EXPERIMENTS} SELECT combination_id AS run, algorithm || '_' || reduction_method
  || '_comp' || coalesce(CAST(n_components AS VARCHAR), 'None') || CASE WHEN algorithm = 'HIGH'
  THEN '_eps' || CASE n_clusters_found % 2 WHEN 0 THEN '0.5' ELSE '0.3' END || '_min'
  || CAST(n_clusters_found AS VARCHAR) ELSE '_k' || coalesce(CAST(k_value AS VARCHAR), 'None') END
  AS id FROM experiments""",
)
def t13(spark, folder):
    df = I.experiments(spark, folder).withColumnRenamed("combination_id", "run")
    df = df.withColumn("eps", F.when(F.col("n_clusters_found") % 2 == 0, 0.5).otherwise(0.3))
    df = df.withColumn(
        "algorithm", F.when(F.col("algorithm") == "HIGH", "dbscan").otherwise(F.col("algorithm"))
    )
    text = X.combination_id(eps="eps", min_samples="n_clusters_found")
    return df.select("run", F.regexp_replace(text, "^dbscan", "HIGH").alias("id"))


def grid_sql(limits: str) -> str:
    """The grid of a study; ``limits`` has the bounds of the components: ``d``, and ``u`` for umap."""
    return f"""WITH dims AS ({limits}),
  r AS (SELECT unnest(['none', 'pca', 'umap']) AS reduction_method),
  base AS (SELECT reduction_method, CASE WHEN reduction_method = 'none' THEN NULL ELSE c END
      AS n_components FROM r, (SELECT unnest([2, 10, 50, 100]) AS c)
    WHERE reduction_method <> 'none' OR c = 2),
  ok AS (SELECT base.* FROM base, dims WHERE n_components IS NULL
    OR n_components < CASE WHEN reduction_method = 'umap' THEN u ELSE d END)
SELECT algorithm, reduction_method, n_components, CAST(k AS INTEGER) AS k_value,
  NULL::DOUBLE AS eps, NULL::INTEGER AS min_samples,
  algorithm || '_' || reduction_method || '_comp' || coalesce(n_components::VARCHAR, 'None')
    || '_k' || k AS combination_id
FROM ok, (SELECT unnest(['kmeans', 'fuzzy_cmeans', 'lda', 'agglomerative']) AS algorithm),
  (SELECT unnest(range(2, 11)) AS k)
UNION ALL
SELECT 'dbscan', reduction_method, n_components, NULL, s.e, s.m,
  'dbscan_' || reduction_method || '_comp' || coalesce(n_components::VARCHAR, 'None')
    || '_eps' || s.t || '_min' || s.m
FROM ok, (SELECT unnest([{{'e': 0.3::DOUBLE, 't': '0.3', 'm': 5}}, {{'e': 0.5, 't': '0.5', 'm': 5}},
  {{'e': 0.7, 't': '0.7', 'm': 5}}, {{'e': 0.5, 't': '0.5', 'm': 3}}, {{'e': 0.5, 't': '0.5', 'm': 10}}])
  AS s)"""


_GRID_SQL = grid_sql("SELECT max(len(embedding)) AS d, max(len(embedding)) AS u FROM embeddings")


@query("t14_experiment_grid", _GRID_SQL)
def t14(spark, folder):
    sizes = I.embeddings(spark, folder).agg(F.max(F.size("features"))).first()
    return X.grid(spark, dimension=sizes[0])


@query(
    "m29_best_results_report",
    f"""WITH {I.EXPERIMENTS}, b AS ({_BEST}),
  a AS (SELECT algorithm, count(*) AS n, avg(silhouette_score) FILTER (silhouette_score > -1) AS s
    FROM experiments GROUP BY algorithm)
SELECT b.metric, b.combination_id, b.score, CAST(b.place AS INTEGER) AS place, e.algorithm,
  a.n AS algorithm_runs, round(a.s, 6) AS algorithm_silhouette
FROM b JOIN experiments e USING (combination_id) JOIN a ON a.algorithm = e.algorithm
WHERE b.place <= 5""",
)
def m29(spark, folder):
    return I.rounded(X.best_results_report(I.experiments(spark, folder), 5), "algorithm_silhouette")


_SETTING = "e.reduction_method, e.n_components, e.k_value, e.n_clusters_found"


@query(
    "m29_best_runs",
    f"""WITH {I.EXPERIMENTS}, b AS ({_BEST})
SELECT b.metric, CAST(b.place AS INTEGER) AS place, b.combination_id, b.score, e.algorithm, {_SETTING}
FROM b JOIN experiments e USING (combination_id) WHERE b.place <= 5""",
)
def m29_runs(spark, folder):
    return X.best_runs(I.experiments(spark, folder), 5)


@query(
    "m29_recommendation",
    f"""WITH {I.EXPERIMENTS}, b AS ({_BEST})
SELECT e.combination_id, e.algorithm, {_SETTING}, e.silhouette_score, e.execution_time
FROM b JOIN experiments e USING (combination_id) WHERE b.place = 1 AND b.metric = 'silhouette'""",
)
def m29_recommended(spark, folder):
    return X.recommendation(I.experiments(spark, folder))
