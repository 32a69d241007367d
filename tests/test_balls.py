"""Tiles of near points: no close pair is lost, far tiles are left out."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_learning import brute_dbscan

from voxloom.operators import balls as B
from voxloom.operators.dbscan import dbscan, dbscan_settings, density_points
from voxloom.operators.neighbours import nearest_neighbours, neighbour_search, visited_share


def frame(spark, x):
    rows = [(i, [float(v) for v in row]) for i, row in enumerate(x)]
    return spark.createDataFrame(rows, "review_id bigint, features array<double>")


def groups(dimensions, seed=0, n=12, size=60, spread=0.02):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(n, dimensions))
    centres /= np.linalg.norm(centres, axis=1)[:, None]
    return np.concatenate([c + rng.normal(scale=spread, size=(size, dimensions)) for c in centres])


def distances(x):
    return np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))


def wanted_neighbours(x, k):
    d = distances(x)
    np.fill_diagonal(d, np.inf)
    return {
        (i, place + 1): int(j)
        for i in range(len(x))
        for place, j in enumerate(np.lexsort((np.arange(len(x)), d[i]))[: min(k, len(x) - 1)])
    }


@pytest.mark.parametrize("dimensions", [3, 64])
def test_bounds_lose_no_close_pair(spark, dimensions):
    x = groups(dimensions, spread=0.05)
    made = B.ball_tiles(frame(spark, x).withColumnRenamed("review_id", "key"), tile_rows=40)
    tile = {r["key"]: r["_tile"] for r in made.points.select("key", "_tile").collect()}
    sizes = np.unique(list(tile.values()), return_counts=True)[1]
    assert len(tile) == len(x) and sizes.max() <= 40
    radius = 0.4
    reached = {
        (r["key"], r["_to"]): r["bound"]
        for r in B.reach(made, made.points, F.lit(radius)).collect()
    }
    d = distances(x)
    for i, j in np.argwhere(d <= radius):
        assert reached[(i, tile[j])] <= d[i, j] + 1e-12
    assert len(reached) < len(x) * len(set(tile.values())) / 2


@pytest.mark.parametrize("dimensions", [2, 64])
def test_neighbours_visit_few_tiles_of_grouped_points(spark, dimensions):
    x = groups(dimensions)
    found, visits = neighbour_search(frame(spark, x), 6, tile_rows=40)
    got = {(r["key"], r["place"]): r["neighbour"] for r in found.collect()}
    assert got == wanted_neighbours(x, 6)
    share = visited_share(visits).first()
    assert share["n_tiles"] >= 18 and share["share"] < 0.5


def test_points_without_structure_are_still_exact(spark):
    x = np.random.default_rng(5).normal(size=(150, 20))
    found, visits = neighbour_search(frame(spark, x), 5, tile_rows=30)
    assert {(r["key"], r["place"]): r["neighbour"] for r in found.collect()} == wanted_neighbours(x, 5)


def test_a_third_of_the_rows_is_one_vector(spark):
    rng = np.random.default_rng(6)
    x = np.concatenate([np.full((60, 3), 2.0), rng.normal(size=(120, 3))])[rng.permutation(180)]
    found, visits = neighbour_search(frame(spark, x), 4, tile_rows=25)
    assert {(r["key"], r["place"]): r["neighbour"] for r in found.collect()} == wanted_neighbours(x, 4)
    # Copies are one point of the search.
    assert visited_share(visits).first()["n_tiles"] <= 12


@pytest.mark.parametrize("n", [0, 1, 3])
def test_few_points(spark, n):
    x = np.arange(n * 2, dtype=float).reshape(n, 2)
    rows = nearest_neighbours(frame(spark, x), 5).collect()
    assert {(r["key"], r["place"]): r["neighbour"] for r in rows} == (
        wanted_neighbours(x, 5) if n else {}
    )
    assert dbscan(frame(spark, x), 0.5, 3).count() == n


def test_density_visits_few_tiles_in_many_dimensions(spark):
    x = groups(64, spread=0.01)
    made = B.ball_tiles(frame(spark, x).withColumnRenamed("review_id", "key"), tile_rows=40)
    pairs = B.reached_pairs(made, 0.3).count()
    tiles = made.tiles()
    assert pairs < tiles * (tiles + 1) / 4
    labels = {r["review_id"]: r["label"] for r in dbscan(frame(spark, x), 0.3, 5, tile_rows=40).collect()}
    assert [labels[i] for i in range(len(x))] == [i // 60 for i in range(len(x))]


@pytest.mark.parametrize("tile_rows", [25, 2048])
def test_all_settings_at_once_equal_each_alone(spark, tile_rows):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.uniform(0, 5, size=(150, 2)), np.repeat([[9.0, 9.0]], 40, axis=0)])
    # Keys beyond the range of small numbers, in the same order.
    df = frame(spark, x).withColumn("review_id", F.col("review_id") * F.lit(2**54) - F.lit(2**62))
    settings = [(0.45, 5), (0.3, 3), (0.45, 9), (0.01, 2), (6.0, 1), (0.3, 3)]
    shared = density_points(df, tile_rows=tile_rows)
    got = dbscan_settings(shared, settings).orderBy("review_id").collect()
    assert len(got) == len(x)
    for i, (eps, least) in enumerate(settings):
        want, core = brute_dbscan(x, eps, least)
        assert [r["labels"][i] for r in got] == list(want), (eps, least)
        assert [r["cores"][i] for r in got] == list(core)
    alone = dbscan(df, 0.3, 3, points=shared).orderBy("review_id").collect()
    assert [(r["label"], r["is_core"]) for r in alone] == [(r["labels"][1], r["cores"][1]) for r in got]


def test_no_points_under_settings(spark):
    shared = density_points(frame(spark, np.zeros((3, 2))).limit(0))
    assert dbscan_settings(shared, [(0.5, 3), (0.1, 2)]).count() == 0
