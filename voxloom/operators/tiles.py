"""Pairwise work over bounded tiles.

Points are spread over tiles of a bounded size. Every pair of tiles is one task
group: it holds two tiles, computes with numpy, and returns per-point results
(sums, minima, a few neighbours, links), never the pairs themselves.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxloom.session import spread

TILE_ROWS = 2_048
# Where all pairs of points are looked at, larger tiles mean fewer copies of each point. They
# grow with the table up to this many rows; a task works on blocks of two tiles at a time.
LARGE_TILE_ROWS, WANTED_TILES = 16_384, 24
BLOCK_ROWS, BLOCK_COLUMNS = 256, 1_024
# Up to so many dimensions plain differences cost less than a matrix product.
FEW_DIMENSIONS = 4
# A squared distance below so many times its possible error is taken from plain differences.
SURE = 1e9

Kernel = Callable[[pd.DataFrame, pd.DataFrame, bool], pd.DataFrame]


def matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype("float64")


def squared_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact differences, one dimension at a time: symmetric and free of cancellation."""
    out = np.zeros((len(a), len(b)))
    for j in range(a.shape[1]):
        diff = a[:, j][:, None] - b[:, j][None, :]
        out += diff * diff
    return out


def squared_pairs(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The entries (i, j) of ``squared_distances(a, b)``, to the last bit."""
    out = np.zeros(len(i))
    for c in range(a.shape[1]):
        diff = a[i, c] - b[j, c]
        out += diff * diff
    return out


def estimated_squares(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Squared distances from one matrix product, and how far a row of them may be off.

    The error is 0 where plain differences were taken: in few dimensions, and if a value
    is not finite.
    """
    if a.shape[1] <= FEW_DIMENSIONS or not (np.isfinite(a).all() and np.isfinite(b).all()):
        return squared_distances(a, b), np.zeros(len(a))
    middle = b.mean(axis=0) if len(b) else 0.0
    a, b = a - middle, b - middle
    square_a, square_b = (a * a).sum(axis=1), (b * b).sum(axis=1)
    out = a @ (-2.0 * b.T)
    out += square_a[:, None]
    out += square_b
    rounding = 8 * (a.shape[1] + 8) * np.finfo("float64").eps
    return out, rounding * (square_a + square_b.max(initial=0.0))


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All distances by a matrix product; those it leaves unsure by plain differences."""
    out, error = estimated_squares(a, b)
    if error.any():
        i, j = np.nonzero(~(out >= SURE * error[:, None]))
        if len(i) > out.size // 16:
            out = squared_distances(a, b)
        else:
            out[i, j] = squared_pairs(a, b, i, j)
    return np.sqrt(out, out=out)


def _group_order(groups: np.ndarray, step: int) -> tuple[np.ndarray, list[tuple]]:
    """Rows by group, and of each ``step`` of them where its groups start and which they are."""
    order = np.argsort(groups, kind="stable")
    parts = []
    for at in range(0, len(order), step):
        held, starts = np.unique(groups[order[at : at + step]], return_index=True)
        parts.append((at, starts, held))
    return order, parts


def distance_sums(
    a: np.ndarray, b: np.ndarray, groups_a: np.ndarray, groups_b: np.ndarray, count: int, same: bool
) -> tuple[np.ndarray, np.ndarray | None]:
    """Distances of each row of one tile to the other's rows, added up by the other's groups.

    Groups count from 0 to ``count - 1``. One look at the distances gives both ways.
    """
    rows, row_parts = _group_order(groups_a, BLOCK_ROWS)
    columns, column_parts = _group_order(groups_b, BLOCK_COLUMNS)
    a, b = a[rows], b[columns]
    of_a, of_b = np.zeros((len(a), count)), None if same else np.zeros((len(b), count))
    for top, starts, held in row_parts:
        for left, first, groups in column_parts:
            d = distances(a[top : top + BLOCK_ROWS], b[left : left + BLOCK_COLUMNS])
            of_a[top : top + BLOCK_ROWS, groups] += np.add.reduceat(d, first, axis=1)
            if not same:
                of_b[left : left + BLOCK_COLUMNS, held] += np.add.reduceat(d, starts, axis=0).T
    back_a = np.empty_like(of_a)
    back_a[rows] = of_a
    if same:
        return back_a, None
    back_b = np.empty_like(of_b)
    back_b[columns] = of_b
    return back_a, back_b


def large_tile_rows(rows: int, width: int = 1) -> int:
    """Rows of a tile for work on all pairs that returns ``width`` numbers a point and tile."""
    return max(TILE_ROWS, min(LARGE_TILE_ROWS, (1 << 22) // max(1, width), math.ceil(rows / WANTED_TILES)))


def tile_count(rows: int, tile_rows: int = TILE_ROWS, at_least: int = 4) -> int:
    return max(math.ceil(rows / tile_rows), min(at_least, max(1, rows // 64)))


def _run(left: DataFrame, right: DataFrame, keys: list[str], kernel: Kernel, schema: str) -> DataFrame:
    def task(key, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        return kernel(a, b, key[0] == key[1])

    # Both sides come from one table: fresh column identities keep them apart.
    right = right.select(*[F.col(c).alias(c) for c in right.columns])
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(task, schema)


def over_all_pairs(
    points: DataFrame, rows: int, kernel: Kernel, schema: str, key: str = "key",
    tile_rows: int = TILE_ROWS,
) -> DataFrame:
    """Run the kernel on every unordered pair of tiles (a tile meets itself too).

    The cost is quadratic in the rows, as the exact definition asks. Memory per
    task is two tiles whatever the table size.
    """
    points = spread(points, key)
    tiles = tile_count(rows, tile_rows)
    tile = F.pmod(F.xxhash64(key), F.lit(tiles)).cast("int")
    tiled = points.withColumn("_tile", tile)
    left = tiled.withColumnRenamed("_tile", "_ta").withColumn(
        "_tb", F.explode(F.sequence(F.col("_ta"), F.lit(tiles - 1)))
    )
    right = tiled.withColumnRenamed("_tile", "_tb").withColumn(
        "_ta", F.explode(F.sequence(F.lit(0), F.col("_tb")))
    )
    return _run(left, right, ["_ta", "_tb"], kernel, schema)


def over_pairs(tiled: DataFrame, pairs: DataFrame, kernel: Kernel, schema: str) -> DataFrame:
    """Run the kernel on the listed tile pairs."""
    left = tiled.join(pairs, tiled["_tile"] == pairs["_ta"]).drop("_tile")
    right = tiled.join(pairs, tiled["_tile"] == pairs["_tb"]).drop("_tile")
    return _run(left, right, ["_ta", "_tb"], kernel, schema)
