"""Tiles of near points, and which of them a point can reach within a radius.

A bounded number of pivots is drawn by hash. A point belongs to the cell of its nearest
pivot, and a cell is cut into shells by the distance to it: a shell is one tile of a bounded
size. What a cell can hold is known from a table of distance intervals, so the triangle
inequality and the plane between two pivots give a lower bound on the distance from a point
to every tile. Pairwise work then visits only the tiles within a point's radius. Without
any structure in the points nothing can be ruled out, and every tile is visited.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxloom.functions.ranking import number_rows
from voxloom.operators.tiles import TILE_ROWS, matrix, squared_distances, tile_count
from voxloom.session import stored

MAX_PIVOTS = 512
REFERENCES = 16
SHELL_SLICES = 64
SLACK = 1e-9
# With more tiles than this, some points judge whether the distance bounds rule out enough.
SEARCHED_TILES, JUDGES = 16, 256


@dataclass
class Balls:
    """``points``: ``key, features, ..., _cell, _d, _tile``; ``shells``: one row a tile."""

    points: DataFrame
    shells: DataFrame
    pivots: np.ndarray
    low: np.ndarray
    high: np.ndarray
    own: np.ndarray

    def tiles(self) -> int:
        return self.shells.count()


def _drawn(points: DataFrame, rows: int, tile_rows: int) -> np.ndarray:
    """Pivots: the points with the smallest hashes, ``MAX_PIVOTS`` at most."""
    wanted = min(MAX_PIVOTS, tile_count(rows, max(1, tile_rows // 2)))
    found = points.orderBy(F.xxhash64("key"), "key").limit(wanted).select("features").collect()
    return np.array([r["features"] for r in found], dtype="float64")


def ball_tiles(points: DataFrame, tile_rows: int = TILE_ROWS) -> Balls | None:
    """Deal ``key, features`` (further columns are kept) to tiles; None for an empty table.

    The driver holds the pivots and an interval for each cell and reference, both bounded by
    ``MAX_PIVOTS``. A crowded cell, equal points too, becomes many tiles.
    """
    rows = points.count()
    if rows == 0:
        return None
    pivots = _drawn(points, rows, tile_rows)
    references = pivots[:REFERENCES]
    kept = list(points.columns)
    schema = f"{_ddl(points)}, _cell int, _d double, _r array<double>"

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch) == 0:
                continue
            away = np.sqrt(squared_distances(matrix(batch["features"]), pivots))
            cell = away.argmin(axis=1)
            yield batch[kept].assign(
                _cell=cell.astype("int32"),
                _d=away[np.arange(len(batch)), cell],
                _r=list(away[:, : len(references)]),
            )

    placed = stored(points.mapInPandas(assign, schema))
    held = (
        placed.select("_cell", "_d", F.posexplode("_r").alias("_i", "_v"))
        .groupBy("_cell", "_i")
        .agg(F.min("_v").alias("lo"), F.max("_v").alias("hi"), F.max("_d").alias("d"))
        .collect()
    )
    shape = (len(pivots), len(references))
    low, high, own = np.full(shape, np.inf), np.full(shape, -np.inf), np.full(len(pivots), -np.inf)
    for r in held:
        low[r["_cell"], r["_i"]], high[r["_cell"], r["_i"]] = r["lo"], r["hi"]
        own[r["_cell"]] = r["d"]
    width = F.element_at(F.lit([float(max(v, 0.0)) for v in own]), F.col("_cell") + 1)
    slice_ = F.when(width > 0, F.floor(F.col("_d") / width * SHELL_SLICES)).otherwise(F.lit(0))
    sliced = placed.drop("_r").withColumn("_slice", slice_).withColumn("_h", F.xxhash64("key"))
    numbered = number_rows(
        sliced, ["_h", "key"], {"slice": F.col("_slice"), "h": F.shiftright("_h", 60)},
        within=["_cell"], out="_rank",
    )
    shell = F.floor((F.col("_rank") - 1) / tile_rows)
    tile = F.shiftleft(F.col("_cell").cast("bigint"), 40) + shell
    dealt = stored(numbered.withColumn("_tile", tile).drop("_slice", "_h", "_rank"))
    shells = dealt.groupBy("_cell", "_tile").agg(F.min("_d").alias("_lo"), F.max("_d").alias("_hi"))
    return Balls(dealt, shells, pivots, low, high, own)


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)


def reach(balls: Balls, points: DataFrame, radius: Column) -> DataFrame:
    """``key, _tile, _to, bound``: the tiles that may hold a point within ``radius`` of a point.

    ``points`` are rows of ``balls.points``; a null radius reaches every tile. ``bound`` is the
    least distance that a point of the tile ``_to`` can have. A point always reaches its own tile.
    """
    pivots, low, high, own = balls.pivots, balls.low, balls.high, balls.own
    between = np.sqrt(squared_distances(pivots, pivots))

    def cells(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in batches:
            for start in range(0, len(whole), 1_024):
                batch = whole.iloc[start : start + 1_024]
                away = np.sqrt(squared_distances(matrix(batch["features"]), pivots))
                cell = batch["_cell"].to_numpy()
                nearest = away[np.arange(len(batch)), cell]
                bound = np.maximum(away - own, 0.0)
                for i in range(low.shape[1]):
                    to = away[:, i][:, None]
                    bound = np.maximum(bound, np.maximum(to - high[:, i], low[:, i] - to))
                # A point of cell q lies on q's side of the plane between q and another pivot.
                gap = between[cell]
                with np.errstate(divide="ignore", invalid="ignore"):
                    plane = (away**2 * (1 - SLACK) - nearest[:, None] ** 2) / (2 * gap)
                bound = np.maximum(bound, np.where(gap > 0, plane, 0.0))
                bound = np.maximum(bound - SLACK * (1 + away), 0.0)
                bound[np.arange(len(batch)), cell] = 0.0
                limit = batch["_u"].fillna(np.inf).to_numpy()
                row, to = np.nonzero((bound <= limit[:, None]) & np.isfinite(bound))
                yield pd.DataFrame(
                    {
                        "key": batch["key"].to_numpy()[row],
                        "_tile": batch["_tile"].to_numpy()[row],
                        "_u": limit[row],
                        "_cell": to.astype("int32"),
                        "_away": away[row, to],
                        "_least": bound[row, to],
                    }
                )

    narrow = points.select("key", "_tile", "_cell", "features", radius.cast("double").alias("_u"))
    reached = narrow.mapInPandas(
        cells, "key bigint, _tile bigint, _u double, _cell int, _away double, _least double"
    )
    shells = balls.shells.select("_cell", F.col("_tile").alias("_to"), "_lo", "_hi")
    slack = SLACK * (1 + F.col("_away"))
    shell = F.greatest(F.col("_away") - F.col("_hi"), F.col("_lo") - F.col("_away")) - slack
    bound = F.when(F.col("_tile") == F.col("_to"), F.lit(0.0)).otherwise(
        F.greatest(F.col("_least"), shell, F.lit(0.0))
    )
    return (
        reached.join(shells, "_cell")
        .withColumn("bound", bound)
        .where("bound <= _u")
        .select("key", "_tile", "_to", "bound")
    )


def mostly_reached(balls: Balls, points: DataFrame, radius: Column) -> bool:
    """Whether the bounds leave a point most of many tiles to visit, judged by a few points.

    It only decides how the same result is found.
    """
    tiles = balls.tiles()
    if tiles <= SEARCHED_TILES:
        return False
    few = points.orderBy(F.xxhash64("key"), "key").limit(JUDGES)
    return reach(balls, few, radius).count() > JUDGES * tiles / 4


def reached_pairs(balls: Balls, radius: float) -> DataFrame:
    """``_ta, _tb`` with ``_ta <= _tb``: tile pairs that can hold points within ``radius``."""
    found = reach(balls, balls.points, F.lit(radius))
    return found.select(
        F.least("_tile", "_to").alias("_ta"), F.greatest("_tile", "_to").alias("_tb")
    ).distinct()
