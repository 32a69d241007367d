"""Clustering, quality and reduction against numpy on small fixtures."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxloom.functions.vectors import masked_mean
from voxloom.operators import dbscan as D
from voxloom.operators import experiments as X
from voxloom.operators import fuzzy, quality, relevance, tiles
from voxloom.operators.kmeans import fit_kmeans
from voxloom.operators.neighbours import fuzzy_graph, nearest_neighbours
from voxloom.operators.reduce import pca, reduce_dimensions, spectral_layout
from voxloom.operators.respond import respond
from voxloom.operators.topics import fit_topics
from voxloom.operators.ward import ward
from voxloom.plans.choose_k import choose_k, cluster_reviews
from voxloom.plans import study
from voxloom.plans.study import fuzzy_study, run_study


def frame(spark, x, labels=None):
    rows = [(i, [float(v) for v in p], int(labels[i]) if labels is not None else 0) for i, p in enumerate(x)]
    return spark.createDataFrame(rows, "review_id long, features array<double>, label int")


def blobs(seed=0, sizes=(30, 20, 25), dim=2, spread=0.3):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(len(sizes), dim)) * 6
    x = np.concatenate([c + rng.normal(size=(n, dim)) * spread for c, n in zip(centres, sizes)])
    labels = np.repeat(np.arange(len(sizes)), sizes)
    order = rng.permutation(len(x))
    return x[order], labels[order]


def same_partition(a, b):
    pairs = set(zip(a, b))
    return len(pairs) == len(set(a)) == len(set(b))


def distances(x):
    return np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))


@pytest.fixture
def many_tiles(monkeypatch):
    monkeypatch.setattr(tiles, "tile_count", lambda rows, *a, **k: max(1, rows // 10))


def brute_ward(x, k):
    groups = [[i] for i in range(len(x))]
    while len(groups) > k:
        best = None
        for i in range(len(groups)):
            for j in range(i + 1, len(groups)):
                a, b = x[groups[i]], x[groups[j]]
                cost = len(a) * len(b) / (len(a) + len(b)) * ((a.mean(0) - b.mean(0)) ** 2).sum()
                if best is None or cost < best[0]:
                    best = (cost, i, j)
        _, i, j = best
        groups[i] += groups.pop(j)
    out = np.zeros(len(x), int)
    for g, members in enumerate(groups):
        out[members] = g
    return out


@pytest.mark.parametrize("driver_clusters", [512, 6])
def test_ward_equals_brute_force(spark, many_tiles, driver_clusters):
    x = np.random.default_rng(1).normal(size=(48, 3))
    rows = ward(frame(spark, x), 5, driver_clusters=driver_clusters).orderBy("review_id").collect()
    assert same_partition([r["label"] for r in rows], brute_ward(x, 5))


def test_ward_over_micro_clusters(spark):
    x, labels = blobs(2)
    rows = ward(frame(spark, x), 3, micro_clusters=12).orderBy("review_id").collect()
    assert same_partition([r["label"] for r in rows], labels)


def brute_dbscan(x, eps, m):
    near = distances(x) <= eps
    core = near.sum(1) >= m
    label = np.full(len(x), -1)
    c = 0
    for i in range(len(x)):
        if label[i] != -1 or not core[i]:
            continue
        stack = [i]
        while stack:
            p = stack.pop()
            if label[p] == -1:
                label[p] = c
                if core[p]:
                    stack += [q for q in np.nonzero(near[p])[0] if label[q] == -1]
        c += 1
    return label, core


@pytest.mark.parametrize("tile_rows", [2048, 7])
def test_dbscan_equals_brute_force(spark, tile_rows):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.uniform(0, 5, size=(150, 2)), np.repeat([[9.0, 9.0]], 40, axis=0)])
    want, core = brute_dbscan(x, 0.45, 5)
    rows = D.dbscan(frame(spark, x), 0.45, 5, tile_rows=tile_rows).orderBy("review_id").collect()
    assert [r["label"] for r in rows] == list(want)
    assert [r["is_core"] for r in rows] == list(core)


def test_dbscan_with_only_noise(spark):
    x = np.arange(10)[:, None] * [5.0, 5.0]
    rows = D.dbscan(frame(spark, x), 0.5, 3).collect()
    assert {r["label"] for r in rows} == {-1}


def test_neighbours_with_copies(spark, many_tiles):
    x = np.concatenate([np.zeros((15, 2)), np.random.default_rng(4).normal(size=(25, 2))])
    rows = nearest_neighbours(frame(spark, x), 4).collect()
    d = distances(x)
    np.fill_diagonal(d, np.inf)
    for r in rows:
        order = sorted(range(len(x)), key=lambda j: (d[r["key"], j], j))
        assert order[r["place"] - 1] == r["neighbour"]
    assert len(rows) == 40 * 4


def test_graph_is_symmetric_and_layout_splits_it(spark):
    x, labels = blobs(5, sizes=(20, 20), spread=0.5)
    graph = fuzzy_graph(nearest_neighbours(frame(spark, x), 14), 15)
    weights = {(r["src"], r["dst"]): r["weight"] for r in graph.collect()}
    assert all(abs(weights[(b, a)] - w) < 1e-12 for (a, b), w in weights.items())
    assert all(0 <= w <= 1 for w in weights.values())
    # The leading eigenvector of the normalised graph, found by numpy.
    w = np.zeros((40, 40))
    for (a, b), value in weights.items():
        w[a, b] = value
    root = np.sqrt(w.sum(1))
    values, basis = np.linalg.eigh(w / np.outer(root, root))
    layout = spectral_layout(graph, 2, rounds=25).orderBy("node").collect()
    block = np.array([r["layout"] for r in layout]) * root[:, None]
    assert np.allclose(block.T @ block, np.eye(2), atol=1e-8)
    assert np.allclose(block.T @ root, 0, atol=1e-8)
    ritz = np.sort(np.linalg.eigvalsh(block.T @ (w / np.outer(root, root)) @ block))[::-1]
    assert abs(ritz[0] - values[-2]) < 0.02
    assert labels.max() == 1


def test_silhouette_over_many_tiles(spark, many_tiles):
    x, labels = blobs(6, sizes=(20, 15, 1), spread=2.0)
    d = distances(x)
    want = []
    for i in range(len(x)):
        own = labels == labels[i]
        if own.sum() == 1:
            want.append(0.0)
            continue
        a = d[i, own].sum() / (own.sum() - 1)
        b = min(d[i, labels == g].mean() for g in set(labels) if g != labels[i])
        want.append((b - a) / max(a, b))
    rows = quality.silhouette_samples(frame(spark, x, labels)).orderBy("review_id").collect()
    assert np.allclose([r["silhouette"] for r in rows], want)


def test_metric_sentinels(spark):
    x, _ = blobs(7)
    row = quality.clustering_metrics(frame(spark, x, np.zeros(len(x)))).first()
    assert tuple(row)[:3] == quality.SENTINEL
    noise = quality.clustering_metrics(frame(spark, x, -np.ones(len(x)))).first()
    assert tuple(noise)[:3] == quality.SENTINEL


def test_fuzzy_finds_separated_groups(spark):
    x, labels = blobs(8)
    df = frame(spark, x)
    fit = fuzzy.fit_fuzzy(df, 3)
    rows = fuzzy.with_assignments(fit.memberships(df)).orderBy("review_id").collect()
    u = np.array([r["membership"] for r in rows])
    assert np.allclose(u.sum(1), 1)
    assert 1 / 3 <= fit.fpc <= 1
    assert same_partition(list(u.argmax(1)), list(labels))
    assert all(r["assignments"] == [int(np.argmax(r["membership"]))] for r in rows)
    again = fuzzy.fit_fuzzy(df.repartition(5), 3)
    assert np.allclose(fit.centres, again.centres)


def test_point_on_a_centre_has_full_membership(spark):
    fit = fuzzy.FuzzyFit(np.array([[0.0, 0.0], [5.0, 5.0]]), 2.0, 0, 0.0, 0.0)
    u = fit.memberships(frame(spark, [[0.0, 0.0]])).first()["membership"]
    assert np.allclose(u, [1.0, 0.0])


def test_below_threshold_falls_back_to_the_largest(spark):
    df = spark.createDataFrame(
        [([0.2, 0.2, 0.25, 0.2],), ([0.5, 0.3, 0.2, 0.0],)], "membership array<double>"
    )
    got = [r["assignments"] for r in fuzzy.with_assignments(df).collect()]
    assert got == [[2], [0, 1]]


def test_kmeans_and_pca(spark):
    x, labels = blobs(9, dim=4)
    df = frame(spark, x)
    fit = fit_kmeans(df, 3, restarts=3)
    rows = fit.assign(df).orderBy("review_id").collect()
    assert same_partition([r["label"] for r in rows], list(labels))
    scores, share = pca(df, 2)
    got = np.array([r["reduced"] for r in scores.orderBy("review_id").collect()])
    centred = x - x.mean(0)
    s = np.linalg.svd(centred, compute_uv=False)
    assert np.isclose(share, (s[:2] ** 2).sum() / (s**2).sum())
    assert np.allclose(got.mean(0), 0, atol=1e-9)


def test_topics_give_a_label_per_row(spark):
    x, _ = blobs(10, dim=4)
    fit = fit_topics(frame(spark, x), 3, passes=3)
    assert fit.labels.where("label BETWEEN 0 AND 2").count() == len(x)
    assert np.isfinite(fit.perplexity) and np.isfinite(fit.log_likelihood)


@pytest.mark.parametrize("algorithm", ["k-means", "agglomerative", "fuzzy c-means"])
def test_choose_k_finds_the_groups(spark, algorithm):
    x, labels = blobs(11)
    k, labelled, table = choose_k(frame(spark, x), algorithm, 2, 4)
    assert k == 3
    assert table.where("chosen").first()["k"] == 3
    rows = labelled.orderBy("review_id").collect()
    assert same_partition([r["label"] for r in rows], list(labels))


def test_cluster_reviews_numbers_rows_by_cluster(spark):
    x, labels = blobs(12)
    df = frame(spark, x).withColumn("Review", F.concat(F.lit("text "), "review_id"))
    rows = cluster_reviews(df, "k-means", "none", 2, 4).orderBy("ID").collect()
    assert [r["ID"] for r in rows] == list(range(1, len(x) + 1))
    clusters = [r["Cluster"] for r in rows]
    assert clusters == sorted(clusters)
    assert len(set(clusters)) == 3


def test_study_runs_every_algorithm(spark):
    x, _ = blobs(13, dim=3)
    df = frame(spark, x).drop("label")
    plan = X.grid(spark, 3, 3, 3, reductions=["pca"], components=[2, 10], dbscan=[(1.0, 3)])
    assert plan.where("n_components = 10").count() == 0
    out = run_study(df, plan, restarts=1).collect()
    assert len(out) == 5
    assert {r["algorithm"] for r in out} == {"kmeans", "fuzzy_cmeans", "lda", "agglomerative", "dbscan"}


def test_study_scores_settings_together_as_alone(spark, monkeypatch, tmp_path):
    x, _ = blobs(13, dim=3)
    df = frame(spark, x).drop("label")
    settings = [(1.0, 3), (0.05, 3), (0.4, 2)]
    plan = X.grid(spark, 3, 3, 3, ["kmeans"], ["none"], [], settings)
    out = {r["combination_id"]: r for r in run_study(df, plan, restarts=1, assignments_path=str(tmp_path)).collect()}
    monkeypatch.setattr(study, "SCORED_TOGETHER", 1)
    lone = {r["combination_id"]: r for r in run_study(df, plan, restarts=1).collect()}
    assert set(out) == set(lone) and len(out) == 4
    for row in plan.where("algorithm = 'dbscan'").collect():
        name = row["combination_id"]
        labelled, record = study.run_combination(df, row.asDict())
        for got in (out[name], lone[name]):
            assert np.allclose(tuple(got)[6:9], record[6:9]), name
            assert got["n_clusters_found"] == record[5]
            assert got["params"]["noise"] == labelled.where("label = -1").count()
        written = spark.read.parquet(f"{tmp_path}/combination_id={name}")
        assert written.count() == len(x)


def test_failing_combination_is_left_out(spark):
    x, _ = blobs(14)
    plan = X.grid(spark, 2, 3, 3, ["kmeans"], ["none"], [], []).unionByName(
        X.grid(spark, 2, 3, 3, ["unknown"], ["none"], [], [])
    )
    out = run_study(frame(spark, x).drop("label"), plan, restarts=1).collect()
    assert [r["algorithm"] for r in out] == ["kmeans"]


def test_fuzzy_study_scores_expanded_points(spark, tmp_path):
    x, _ = blobs(15)
    df = frame(spark, x).withColumn("Review", F.concat(F.lit("t"), F.col("review_id") % 60))
    out = fuzzy_study(df, 3, 3, reductions=["none"], components=[], details_path=str(tmp_path)).collect()
    assert len(out) == 1 and -1 <= out[0]["silhouette_score"] <= 1
    details = spark.read.parquet(str(tmp_path))
    assert details.select("original_index").distinct().count() == 60


def test_neighbour_graph_reduction_keeps_groups_apart(spark):
    x, labels = blobs(16, sizes=(20, 20))
    rows = reduce_dimensions(frame(spark, x), "umap", 2, rounds=5).orderBy("review_id").collect()
    assert len(rows) == 40 and all(len(r["reduced"]) == 2 for r in rows)


def test_default_grid_size(spark):
    assert X.grid(spark, 1000).count() == 369
    assert X.grid(spark, 1000, algorithms=["fuzzy_cmeans"], dbscan=[]).count() == 81


def test_folds_are_even_and_seeded(spark):
    df = spark.range(103).withColumnRenamed("id", "review_id")
    folds = relevance.with_folds(df, 5)
    sizes = [r["count"] for r in folds.groupBy("fold").count().collect()]
    assert sorted(sizes) == [20, 20, 21, 21, 21]
    again = relevance.with_folds(df.repartition(7), 5)
    assert folds.exceptAll(again).count() == 0


def test_metrics_without_positive_predictions_are_null(spark):
    df = spark.createDataFrame([(1, 0), (0, 0)], "Relevant int, binary_prediction int")
    row = relevance.classification_metrics(relevance.confusion(df)).first()
    assert row["accuracy"] == 0.5 and row["precision"] is None and row["recall"] == 0.0


def test_classifier_learns_a_word(spark):
    texts = [("please fix the crash " + "x" * (i % 5), 1) if i % 2 else ("nice app " + "y" * (i % 5), 0) for i in range(80)]
    df = spark.createDataFrame([(i, t, y) for i, (t, y) in enumerate(texts)], "review_id long, Review string, Relevant int")
    model = relevance.train(df)
    row = relevance.classification_metrics(relevance.confusion(relevance.predict(model, df))).first()
    assert row["f1"] == 1.0


def test_masked_mean_of_no_token_is_zero(spark):
    df = spark.createDataFrame([(1, [3.0, 4.0], 1), (1, [9.0, 9.0], 0), (2, [1.0, 1.0], 0)], "id long, v array<double>, m int")
    got = {r["id"]: r["embedding"] for r in masked_mean(df, "id", "v", "m").collect()}
    assert np.allclose(got[1], [0.6, 0.8]) and got[2] == [0.0, 0.0]


def test_responder_errors_are_kept_apart(spark):
    calls = {"n": 0}

    def make():
        def answer(prompt):
            if prompt == "bad":
                raise RuntimeError("down")
            return prompt.upper()

        return answer

    df = spark.createDataFrame([(1, "good"), (2, "bad")], "cluster int, prompt string")
    rows = {r["cluster"]: r for r in respond(df, make, attempts=2).collect()}
    assert rows[1]["response"] == "GOOD" and rows[1]["error"] is None and rows[1]["attempts"] == 1
    assert rows[2]["response"] is None and "down" in rows[2]["error"] and rows[2]["attempts"] == 2
    assert calls["n"] == 0
