"""Exact density clustering over tiles of near points."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxloom.functions.ranking import id_bucket, number_rows
from voxloom.operators.balls import Balls, ball_tiles, mostly_reached, reached_pairs
from voxloom.operators.components import connected_components
from voxloom.operators.tiles import (
    BLOCK_COLUMNS,
    BLOCK_ROWS,
    TILE_ROWS,
    Kernel,
    estimated_squares,
    large_tile_rows,
    matrix,
    over_all_pairs,
    over_pairs,
    squared_pairs,
)
from voxloom.session import cut_lineage


def _near_blocks(a: pd.DataFrame, b: pd.DataFrame, radii: list[float]) -> Iterator[tuple]:
    """``rows, columns, near``: which points of two tiles are near, for every radius, by blocks.

    A matrix product decides what it can for sure, plain differences the rest.
    """
    x, y = matrix(a["features"]), matrix(b["features"])
    for top in range(0, len(x), BLOCK_ROWS):
        for left in range(0, len(y), BLOCK_COLUMNS):
            rows, columns = slice(top, top + BLOCK_ROWS), slice(left, left + BLOCK_COLUMNS)
            square, error = estimated_squares(x[rows], y[columns])
            near = []
            for eps in radii:
                away = square - eps * eps
                inside = away <= 0
                if error.any():
                    i, j = np.nonzero(np.abs(away) <= error[:, None] + 1e-12 * eps * eps)
                    inside[i, j] = squared_pairs(x[rows], y[columns], i, j) <= eps * eps
                else:
                    inside = square <= eps * eps
                near.append(inside)
            yield rows, columns, near


def _neighbour_weights(radii: list[float]):
    names = [f"w{i}" for i in range(len(radii))]

    def kernel(a: pd.DataFrame, b: pd.DataFrame, same: bool) -> pd.DataFrame:
        weight_a, weight_b = a["weight"].to_numpy(), b["weight"].to_numpy()
        of_a, of_b = np.zeros((len(radii), len(a))), np.zeros((len(radii), len(b)))
        for rows, columns, near in _near_blocks(a, b, radii):
            for i, inside in enumerate(near):
                of_a[i, rows] += inside @ weight_b[columns]
                of_b[i, columns] += weight_a[rows] @ inside
        parts = [pd.DataFrame({"key": a["key"]} | dict(zip(names, of_a)))]
        if not same:
            parts.append(pd.DataFrame({"key": b["key"]} | dict(zip(names, of_b))))
        out = pd.concat(parts)
        return out[out[names].max(axis=1) > 0]

    return kernel


def _hook(parent: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Join the trees of linked nodes, the larger root below the smaller, until none differ."""
    while len(i):
        while (parent != parent[parent]).any():
            parent[:] = parent[parent]
        low, high = np.minimum(parent[i], parent[j]), np.maximum(parent[i], parent[j])
        apart = low != high
        i, j = i[apart], j[apart]
        np.minimum.at(parent, high[apart], low[apart])


def _links(radii: list[float], settings: list[tuple[float, int]]):
    """Links between core points, as a forest, and the core points next to border points."""

    def kernel(a: pd.DataFrame, b: pd.DataFrame, same: bool) -> pd.DataFrame:
        ids_a, ids_b = a["key"].to_numpy(), b["key"].to_numpy()
        cores_a, cores_b = np.stack(a["core"].to_list()), np.stack(b["core"].to_list())
        ids, place = np.unique(np.concatenate((ids_a, ids_b)), return_inverse=True)
        place_a, place_b = place[: len(ids_a)], place[len(ids_a) :]
        # Nodes are in the order of their ids, so a root is the smallest id of its tree.
        parents = [np.arange(len(ids)) for _ in settings]
        parts = []

        def add(setting: int, kind: str, src: np.ndarray, dst: np.ndarray) -> None:
            if len(src):
                parts.append(pd.DataFrame({"setting": setting, "kind": kind, "src": src, "dst": dst}))

        for rows, columns, nears in _near_blocks(a, b, radii):
            for setting, (eps, _) in enumerate(settings):
                near = nears[radii.index(eps)]
                core_a, core_b = cores_a[rows, setting], cores_b[columns, setting]
                i, j = np.nonzero(near & core_a[:, None] & core_b[None, :])
                _hook(parents[setting], place_a[rows][i], place_b[columns][j])
                i, j = np.nonzero(near & ~core_a[:, None] & core_b[None, :])
                add(setting, "border", ids_a[rows][i], ids_b[columns][j])
                if not same:
                    i, j = np.nonzero(near & core_a[:, None] & ~core_b[None, :])
                    add(setting, "border", ids_b[columns][j], ids_a[rows][i])
        for setting, parent in enumerate(parents):
            below = parent != np.arange(len(ids))
            add(setting, "core", ids[below], ids[parent[below]])
        return pd.concat(parts) if parts else pd.DataFrame(columns=["setting", "kind", "src", "dst"])

    return kernel


@dataclass
class DensityPoints:
    """``rows`` (``row_key, features``) and tiles of their distinct vectors, for many settings."""

    rows: DataFrame
    balls: Balls | None


def density_points(
    df: DataFrame, features: str = "features", key: str = "review_id", tile_rows: int = TILE_ROWS
) -> DensityPoints:
    """Equal points merged into weighted ones and dealt to tiles: all that no setting changes."""
    rows = df.select(
        F.col(key).cast("bigint").alias("row_key"),
        F.col(features).cast("array<double>").alias("features"),
    )
    points = cut_lineage(
        rows.groupBy("features").agg(
            F.min("row_key").alias("key"), F.count(F.lit(1)).cast("double").alias("weight")
        )
    )
    return DensityPoints(rows, ball_tiles(points, tile_rows))


def dbscan(
    df: DataFrame,
    eps: float = 0.5,
    min_samples: int = 5,
    features: str = "features",
    key: str = "review_id",
    tile_rows: int = TILE_ROWS,
    points: DensityPoints | None = None,
) -> DataFrame:
    """``key, label, is_core``: clusters 0.. in order of their smallest core key, noise -1.

    ``points``, the ``density_points`` of the same table, saves their work where it was done.
    """
    points = points or density_points(df, features, key, tile_rows)
    found = dbscan_settings(points, [(eps, min_samples)], key)
    return found.select(key, F.col("labels")[0].alias("label"), F.col("cores")[0].alias("is_core"))


def dbscan_settings(
    points: DensityPoints, settings: list[tuple[float, int]], key: str = "review_id"
) -> DataFrame:
    """``key, labels, cores``: the label and core flag of a row under every (eps, min_samples).

    Equal points are merged into one weighted point first, so copies cost one
    row. Neighbours are counted over the tiles that the largest ``eps`` reaches by the bounds
    of ``ball_tiles``, or over all pairs of larger tiles where the bounds rule out little; one look at the distances of two tiles
    serves all settings. Core points are linked by a forest per tile pair and setting, and
    the graphs of all settings are joined by the same rounds of connected components. A
    border point has fewer than ``min_samples`` neighbours, so listing its core neighbours
    is bounded; it joins the cluster with the smallest number.
    """
    rows, balls = points.rows, points.balls
    if balls is None or not settings:
        n = len(settings)
        return rows.select(
            F.col("row_key").alias(key),
            F.array_repeat(F.lit(-1), n).alias("labels"),
            F.array_repeat(F.lit(False), n).alias("cores"),
        )
    radii = sorted({eps for eps, _ in settings})
    tiled = balls.points.select("key", "features", "weight", "_tile")
    if mostly_reached(balls, balls.points, F.lit(radii[-1])):
        count = tiled.count()

        def visit(points: DataFrame, kernel: Kernel, schema: str) -> DataFrame:
            return over_all_pairs(points.drop("_tile"), count, kernel, schema, tile_rows=large_tile_rows(count))

    else:
        pairs = cut_lineage(reached_pairs(balls, radii[-1]))

        def visit(points: DataFrame, kernel: Kernel, schema: str) -> DataFrame:
            return over_pairs(points, pairs, kernel, schema)

    schema = ", ".join(["key bigint", *[f"w{i} double" for i in range(len(radii))]])
    weights = visit(tiled, _neighbour_weights(radii), schema)
    counted = weights.groupBy("key").agg(
        F.array(*[F.sum(f"w{radii.index(e)}") >= least for e, least in settings]).alias("core")
    )
    marked = cut_lineage(tiled.join(counted, "key"))
    schema = "setting int, kind string, src bigint, dst bigint"
    links = cut_lineage(visit(marked, _links(radii, settings), schema))
    components = connected_components(links.where("kind = 'core'"), within=["setting"])
    core = (
        marked.select("key", F.posexplode("core").alias("setting", "is_core"))
        .where("is_core")
        .select("setting", "key")
        .join(components.withColumnRenamed("node", "key"), ["setting", "key"], "left")
        .select("setting", "key", F.coalesce("component", "key").alias("root"))
    )
    border = (
        links.where("kind = 'border'")
        .join(core.withColumnRenamed("key", "dst"), ["setting", "dst"])
        .groupBy("setting", F.col("src").alias("key"))
        .agg(F.min("root").alias("root"))
    )
    roots = core.select("setting", "root").distinct()
    numbers = number_rows(roots, ["root"], {"slice": id_bucket("root")}, within=["setting"], out="_no")
    # One entry a setting.
    numbered = F.collect_list(F.struct("setting", (F.col("_no") - 1).cast("int")))
    placed = (
        core.union(border)
        .join(numbers, ["setting", "root"])
        .groupBy("key")
        .agg(F.map_from_entries(numbered).alias("placed"))
    )
    label_of = lambda i: F.coalesce(F.try_element_at("placed", i), F.lit(-1))
    labels = (
        marked.select("key", "features", "core")
        .join(placed, "key", "left")
        .select("features", "core", F.array(*[label_of(F.lit(i)) for i in range(len(settings))]).alias("labels"))
    )
    return rows.join(labels, "features").select(
        F.col("row_key").alias(key), "labels", F.col("core").alias("cores")
    )


def dbscan_summary(labels: DataFrame) -> DataFrame:
    """One row: clusters found, noise points, core points."""
    return labels.agg(
        F.count_distinct(F.when(F.col("label") >= 0, F.col("label"))).alias("n_clusters_found"),
        F.count_if(F.col("label") == -1).alias("n_noise_points"),
        F.count_if("is_core").alias("n_core_points"),
    )
