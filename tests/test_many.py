"""Many models and many labellings at once against one at a time, and against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_learning import blobs, frame
from voxloom.operators import fuzzy, many
from voxloom.operators.kmeans import fit_many_kmeans
from voxloom.operators.quality import SENTINEL, clustering_metrics, many_metrics
from voxloom.operators.ward import ward, ward_labels

NAMES = ["silhouette_score", "calinski_harabasz_score", "davies_bouldin_score"]


@pytest.fixture(scope="module")
def points(spark):
    x, _ = blobs(3, dim=3)
    df = frame(spark, x).drop("label")
    return x, df.withColumn("half", F.slice("features", 1, 2))


def test_kmeans_models_are_fixed_points_of_numpy_rounds(spark, points):
    x, df = points
    wanted = [("features", k) for k in (2, 3, 5)] + [("half", 3)]
    walks, passes = many.kmeans_walks(df, wanted, restarts=4)
    assert len(walks) == 16
    # A round is one pass for all models together.
    assert passes <= max(w.iterations for w in walks) + 2 + many.SEED_ROUNDS + 2
    for walk in walks:
        rows = x if walk.slot == "features" else x[:, :2]
        d2 = ((rows[:, None] - walk.centres[None]) ** 2).sum(axis=2)
        assert np.isclose(walk.inertia, d2.min(axis=1).sum())
        label = d2.argmin(axis=1)
        means = np.array([rows[label == c].mean(axis=0) for c in range(walk.k)])
        assert np.abs(means - walk.centres).max() < 1e-3
    best = fit_many_kmeans(df, wanted, restarts=4)
    for slot, fit in best.items():
        assert fit.inertia == min(w.inertia for w in walks if (w.slot, w.k) == slot)


def test_few_distinct_points_and_many_copies(spark):
    df = spark.createDataFrame([(i, [float(i % 3), 0.0]) for i in range(600)], "review_id long, features array<double>")
    fit = fit_many_kmeans(df, [("features", k) for k in (2, 3, 6)], restarts=2)
    assert fit["features", 3].inertia == fit["features", 6].inertia == 0
    assert np.isclose(fit["features", 2].inertia, 100)
    with pytest.raises(ValueError):
        fit_many_kmeans(df.limit(0), [("features", 2)])


def test_fuzzy_models_equal_one_at_a_time(spark, points):
    _, df = points
    wanted = [("features", 2), ("half", 3), ("features", 4)]
    together = fuzzy.fit_many_fuzzy(df, wanted)
    for slot, k in wanted:
        alone = fuzzy.fit_fuzzy(df, k, features=slot)
        assert np.allclose(alone.centres, together[slot, k].centres)
        assert alone.iterations == together[slot, k].iterations


@pytest.mark.parametrize("mode", ["exact", "squared"])
def test_many_labellings_score_as_one_at_a_time(spark, points, mode):
    x, df = points
    draw = np.random.default_rng(4)
    n = len(x)
    labellings = [draw.integers(0, 3, n), draw.integers(-1, 4, n), np.zeros(n, int), np.arange(n) % 2]
    labellings[3][5] = 2  # a lone point
    widths = [3, 4, 1, 3]
    rows = [
        (i, x[i].tolist(), [[int(a[i])] if a[i] >= 0 else [] for a in labellings], [int(a[i]) for a in labellings])
        for i in range(n)
    ]
    table = spark.createDataFrame(
        rows, "review_id long, features array<double>, assigned array<array<int>>, labels array<int>"
    )
    got = many_metrics(table, "assigned", widths, mode=mode)
    for i, record in enumerate(got):
        one = clustering_metrics(table.withColumn("label", F.col("labels")[i]), mode=mode).first()
        assert np.allclose([record[c] for c in NAMES], [one[c] for c in NAMES]), (i, record, one)
        assert record["n_clusters_found"] == one["n_clusters_found"] or i == 2
    assert tuple(got[2][c] for c in NAMES) == SENTINEL


def test_points_in_several_clusters_score_as_expanded_rows(spark, points):
    x, df = points
    member = fuzzy.with_assignments(fuzzy.fit_fuzzy(df, 3).memberships(df), threshold=0.002)
    expanded = fuzzy.expand_assignments(member).withColumn("review_id", F.col("review_id") * 3 + F.col("label"))
    assert expanded.count() > len(x)
    one = clustering_metrics(expanded).first()
    got = many_metrics(member.withColumn("all", F.array("assignments")), "all", [3])[0]
    assert np.allclose([got[c] for c in NAMES], [one[c] for c in NAMES])


def test_no_points(spark, points):
    _, df = points
    none = df.limit(0).withColumn("all", F.array(F.array(F.lit(0))))
    assert tuple(many_metrics(none, "all", [2])[0][c] for c in NAMES) == SENTINEL


def test_one_tree_gives_every_cut(spark, points):
    x, df = points
    both = {r["review_id"]: r["labels"] for r in ward_labels(df, [2, 5, 3], driver_clusters=20).collect()}
    for i, k in enumerate((2, 5, 3)):
        alone = {r["review_id"]: r["label"] for r in ward(df, k).collect()}
        assert alone == {key: labels[i] for key, labels in both.items()}
        assert len(set(alone.values())) == k
