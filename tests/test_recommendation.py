from voxloom.operators.experiments import best_runs, recommendation

COLUMNS = (
    "combination_id string, algorithm string, reduction_method string, n_components int, k_value int, "
    "n_clusters_found int, silhouette_score double, calinski_harabasz_score double, "
    "davies_bouldin_score double, execution_time double"
)


def results(spark):
    rows = [
        ("a", "kmeans", "pca", 2, 3, 3, 0.5, 10.0, 0.9, 1.0),
        ("b", "dbscan", "none", None, None, 4, 0.5, 12.0, 0.2, 2.0),
        ("c", "lda", "svd", 5, 6, 5, -1.0, 0.0, float("inf"), 3.0),
    ]
    return spark.createDataFrame(rows, COLUMNS)


def test_the_recommendation_has_its_whole_setting(spark):
    # "a" and "b" tie; the smaller id is taken.
    (row,) = recommendation(results(spark)).collect()
    assert tuple(row) == ("a", "kmeans", "pca", 2, 3, 3, 0.5, 1.0)
    assert recommendation(results(spark).where("combination_id = 'c'")).count() == 0


def test_best_runs_leave_out_unusable_scores(spark):
    rows = best_runs(results(spark), 2).where("metric = 'davies_bouldin'").orderBy("place").collect()
    assert [(r["combination_id"], r["reduction_method"], r["k_value"]) for r in rows] == [
        ("b", "none", None), ("a", "pca", 3),
    ]
