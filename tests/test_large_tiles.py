"""Distances by a matrix product: the results of plain differences, in much less time."""

import time

import numpy as np
import pandas as pd
import pytest

from voxloom.operators import balls, dbscan, neighbours, quality, tiles, ward
from voxloom.plans import choose_k as C


def grouped(rows, dimensions, seed=0, away=0.0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(rows, dimensions)) + away
    x[: rows // 5] = x[rows // 5 : 2 * (rows // 5)]
    return x


@pytest.mark.parametrize("away", [0.0, 1e4])
@pytest.mark.parametrize("dimensions", [2, 64])
def test_distances_are_those_of_plain_differences(dimensions, away):
    x, y = grouped(300, dimensions, away=away), grouped(280, dimensions, away=away)
    want = np.sqrt(tiles.squared_distances(x, y))
    got = tiles.distances(x, y)
    assert np.allclose(got, want, rtol=1e-9, atol=0)
    estimate, error = tiles.estimated_squares(x, y)
    assert (np.abs(estimate - want**2) <= error[:, None] + 1e-15 * want**2).all()
    i, j = np.nonzero(want < 3 + away)
    assert (tiles.squared_pairs(x, y, i, j) == tiles.squared_distances(x, y)[i, j]).all()


def test_sums_by_group_go_both_ways():
    x, y = grouped(700, 6), grouped(1_500, 6, 1)
    rng = np.random.default_rng(2)
    gx, gy = rng.integers(0, 5, 700), rng.integers(0, 5, 1_500)
    d = np.sqrt(tiles.squared_distances(x, y))
    of_x, of_y = tiles.distance_sums(x, y, gx, gy, 5, False)
    for g in range(5):
        assert np.allclose(of_x[:, g], d[:, gy == g].sum(axis=1))
        assert np.allclose(of_y[:, g], d[gx == g].sum(axis=0))


def test_two_tiles_take_a_fraction_of_the_time_of_plain_differences():
    x, y = grouped(2_048, 64), grouped(2_048, 64, 1)
    a, b = (pd.DataFrame({"key": range(2_048), "label": np.arange(2_048) % 10, "features": list(v)}) for v in (x, y))
    start = time.perf_counter()
    tiles.squared_distances(x, y)
    plain = time.perf_counter() - start
    start = time.perf_counter()
    quality._distance_sums(a, b, False)
    assert time.perf_counter() - start < plain


def test_all_k_are_scored_in_one_look(spark, monkeypatch):
    rng = np.random.default_rng(3)
    x = np.concatenate([c + rng.normal(scale=0.3, size=(40, 5)) for c in rng.normal(size=(4, 5))])
    x = np.concatenate((x, x[:10]))
    keys = [*range(160), *range(10)]
    rows = [(k, [float(v) for v in p]) for k, p in zip(keys, x)]
    df = spark.createDataFrame(rows, "review_id bigint, features array<double>")
    looks = []
    run = quality.over_all_pairs
    monkeypatch.setattr(quality, "over_all_pairs", lambda *a, **k: looks.append(1) or run(*a, **k))
    best, labelled, table = C.choose_k(df, "k-means", 3, 6)
    assert len(looks) == 1
    for r in table.collect():
        alone = C.cluster_once(df, "k-means", r["k"])
        assert r["silhouette"] == pytest.approx(quality.silhouette(alone).first()[0], abs=1e-9)
        assert r["chosen"] == (r["k"] == best)
    assert labelled.columns == ["review_id", "features", "label"] and labelled.count() == 170


@pytest.mark.parametrize("dimensions,away", [(2, 0.0), (32, 0.0), (32, 1e3)])
def test_nearest_rows_of_two_tiles(dimensions, away):
    x, y = grouped(300, dimensions, away=away), grouped(2_500, dimensions, 1, away)
    y[:300] = x
    a = pd.DataFrame({"key": np.arange(300), "features": list(x)})
    b = pd.DataFrame({"key": np.arange(2_500), "features": list(y)})
    d = np.sqrt(tiles.squared_distances(x, y))
    d[np.arange(300), np.arange(300)] = np.inf
    got = neighbours._nearest(7, a, b)
    for i in range(300):
        order = np.lexsort((np.arange(2_500), d[i]))[:7]
        mine = got[got["key"] == i]
        assert list(mine["neighbour"]) == list(order) and list(mine["distance"]) == list(d[i, order])


@pytest.mark.parametrize("same", [False, True])
def test_cheapest_partners_of_two_tiles(same):
    x, y = grouped(300, 32), grouped(1_300, 32, 1)
    rng = np.random.default_rng(4)
    sizes = [rng.integers(1, 4, n).astype(float) for n in (300, 1_300)]
    a = pd.DataFrame({"key": rng.permutation(300), "features": list(x), "size": sizes[0]})
    b = pd.DataFrame({"key": 300 + rng.permutation(1_300), "features": list(y), "size": sizes[1]})
    b = a if same else b
    cost, ids_a, ids_b = ward._costs(a, b), a["key"].to_numpy(), b["key"].to_numpy()
    want = [ward._first_best(cost, ids_a, ids_b)] + ([] if same else [ward._first_best(cost.T, ids_b, ids_a)])
    want = pd.concat(want).sort_values("key").reset_index(drop=True)
    got = ward._nearest(a, b, same).sort_values("key").reset_index(drop=True)
    assert (got[["key", "other", "cost"]] == want[["key", "other", "cost"]]).all().all()


def test_all_points_meet_where_bounds_rule_out_little(spark, monkeypatch):
    x = grouped(400, 20, 5)
    rows = [(i, [float(v) for v in p]) for i, p in enumerate(x)]
    df = spark.createDataFrame(rows, "review_id bigint, features array<double>")
    want = neighbours.neighbour_search(df, 5, tile_rows=20)[0].collect()
    labels = dbscan.dbscan(df, 5.0, 5, tile_rows=20).orderBy("review_id").collect()
    monkeypatch.setattr(balls, "SEARCHED_TILES", 2)
    monkeypatch.setattr(balls, "JUDGES", 32)
    monkeypatch.setattr(neighbours, "SLAB_ROWS", 150)
    monkeypatch.setattr(neighbours, "TILE_ROWS", 90)
    used = []
    run = neighbours._search_all
    monkeypatch.setattr(neighbours, "_search_all", lambda *a: used.append(1) or run(*a))
    found, visits = neighbours.neighbour_search(df, 5, tile_rows=20)
    assert used and sorted(found.collect()) == sorted(want)
    assert neighbours.visited_share(visits).first()["share"] == 1
    monkeypatch.setattr(dbscan, "reached_pairs", None)
    assert dbscan.dbscan(df, 5.0, 5, tile_rows=20).orderBy("review_id").collect() == labels
    assert len({r["label"] for r in labels}) > 1
