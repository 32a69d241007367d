"""Fuzzy c-means and the rules that turn memberships into assignments."""

from __future__ import annotations

import logging
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from voxloom.functions.vectors import argmax
from voxloom.operators.many import add_up, draws, hashed, slot_columns, squared_to
from voxloom.operators.tiles import matrix

log = logging.getLogger(__name__)

_FLOOR = np.finfo("float64").eps


def memberships_of(x: np.ndarray, centres: np.ndarray, m: float) -> tuple[np.ndarray, np.ndarray]:
    """Membership matrix (rows sum to 1) and squared distances to the centres."""
    d2 = squared_to(x, centres)
    d = np.maximum(np.sqrt(d2), _FLOOR)
    scaled = d / d.min(axis=1, keepdims=True)
    scaled = 1.0 / (scaled * scaled) if m == 2 else scaled ** (-2.0 / (m - 1.0))
    return scaled / scaled.sum(axis=1, keepdims=True), d * d


@dataclass
class FuzzyFit:
    centres: np.ndarray
    m: float
    iterations: int
    fpc: float
    objective: float
    converged: bool = True

    def memberships(self, df: DataFrame, features: str = "features", out: str = "membership") -> DataFrame:
        """Add the membership array of every row."""
        centres, m = self.centres, self.m

        @pandas_udf("array<double>")
        def member(column: pd.Series) -> pd.Series:
            if len(column) == 0:
                return pd.Series([], dtype="object")
            return pd.Series(list(memberships_of(matrix(column), centres, m)[0]))

        return df.withColumn(out, member(F.col(features).cast("array<double>")))


def _start_kernel(hashes: np.ndarray, x: np.ndarray, model: tuple[int, float, int]) -> np.ndarray:
    """Weighted sums under random memberships that depend on the row and the seed only."""
    k, m, seed = model
    u = np.stack([draws(hashes, seed, j) for j in range(k)], axis=1)
    um = (u / u.sum(axis=1, keepdims=True)) ** m
    return np.concatenate(((um.T @ x).ravel(), um.sum(axis=0)))


def _step_kernel(hashes: np.ndarray, x: np.ndarray, model: tuple) -> np.ndarray:
    """Sums for new centres, objective, squared memberships, membership change, rows."""
    centres, before, m = model
    u, d2 = memberships_of(x, centres, m)
    um = u**m
    change = 0.0 if before is None else float(((u - memberships_of(x, before, m)[0]) ** 2).sum())
    return np.concatenate(
        [(um.T @ x).ravel(), um.sum(axis=0), [(um * d2).sum(), (u * u).sum(), change, len(x)]]
    )


def _stepped(total: np.ndarray, k: int, d: int) -> tuple[np.ndarray, dict[str, float]]:
    moved = total[: k * d].reshape(k, d) / np.maximum(total[k * d : k * d + k], _FLOOR)[:, None]
    objective, squares, change, n = total[-4:]
    return moved, {"objective": objective, "fpc": squares / n, "change": float(np.sqrt(change)), "n": n}


def one_step(
    df: DataFrame, centres: np.ndarray, before: np.ndarray | None, m: float
) -> tuple[np.ndarray, dict[str, float]]:
    """One pass: new centres, objective, partition coefficient, membership change.

    Every task adds up its rows; Spark adds up the tasks before the driver reads one row.
    """
    points = hashed(df.select("features"), ["features"])
    total = add_up(points, [("features", (centres, before, m))], _step_kernel)[0]
    return _stepped(total, *centres.shape)


def fit_many_fuzzy(
    df: DataFrame,
    wanted: list[tuple[str, int]],
    m: float = 2.0,
    error: float = 0.005,
    max_iterations: int = 1000,
    seed: int = 42,
    key: str = "review_id",
) -> dict[tuple[str, int], FuzzyFit]:
    """A fit of every (features column, k), all of them in one pass a round.

    Each alternates memberships and centres until its memberships change by less than
    ``error``, the Euclidean norm over its whole membership matrix, and then drops out.
    """
    if m <= 1:
        raise ValueError("m must be above 1")
    slots = list(dict.fromkeys(s for s, _ in wanted))
    points = df.select(F.xxhash64(F.col(key).cast("bigint")).alias("hash"), *slot_columns(slots)).persist()
    starts = add_up(points, [(s, (k, m, seed)) for s, k in wanted], _start_kernel)
    walks = {}
    for (slot, k), total in zip(wanted, starts):
        d = len(total) // k - 1
        walks[slot, k] = (total[: k * d].reshape(k, d) / total[k * d :][:, None], None)
    fits: dict[tuple[str, int], FuzzyFit] = {}
    for round_no in range(1, max_iterations + 1):
        active = [w for w in walks if w not in fits]
        if not active:
            break
        totals = add_up(points, [(w[0], (*walks[w], m)) for w in active], _step_kernel)
        for walk, total in zip(active, totals):
            centres, before = walks[walk]
            moved, state = _stepped(total, *centres.shape)
            converged = before is not None and state["change"] < error
            walks[walk] = (moved, centres)
            if converged or round_no == max_iterations:
                fits[walk] = FuzzyFit(
                    centres, m, round_no, float(state["fpc"]), float(state["objective"]), converged
                )
    points.unpersist()
    for (slot, k), fit in fits.items():
        if not fit.converged:
            log.warning("k=%s: not converged after %s rounds", k, max_iterations)
        if fit.fpc - 1 / k < 1e-3:
            log.warning("k=%s: the centres have collapsed, every membership is near 1/k", k)
    return fits


def fit_fuzzy(
    df: DataFrame,
    k: int,
    m: float = 2.0,
    error: float = 0.005,
    max_iterations: int = 1000,
    seed: int = 42,
    features: str = "features",
    key: str = "review_id",
) -> FuzzyFit:
    """Alternate memberships and centres until the memberships change by less than ``error``.

    The input is read once per round; only k x d centres pass through the driver.
    """
    wanted = [(features, k)]
    return fit_many_fuzzy(df, wanted, m, error, max_iterations, seed, key)[features, k]


def assigned_clusters(membership: Column, threshold: float = 0.3) -> Column:
    """Clusters with membership at or above the threshold, else the largest one."""
    indices = F.sequence(F.lit(0), F.size(membership) - 1)
    above = F.filter(indices, lambda i: membership[i] >= threshold)
    return F.when(F.size(above) > 0, above).otherwise(F.array(argmax(membership)))


def with_assignments(df: DataFrame, membership: str = "membership", threshold: float = 0.3) -> DataFrame:
    return df.withColumn("assignments", assigned_clusters(F.col(membership), threshold))


def expand_assignments(df: DataFrame, out: str = "label") -> DataFrame:
    """One row per point and assigned cluster, all other columns kept."""
    return df.withColumn(out, F.explode("assignments"))


def hard_labels(df: DataFrame, membership: str = "membership") -> DataFrame:
    """``argmax_label`` (for choosing k) and ``first_label`` (for grid scores)."""
    return df.withColumn("argmax_label", argmax(F.col(membership))).withColumn(
        "first_label", F.col("assignments")[0]
    )


def multiple_memberships(df: DataFrame) -> DataFrame:
    """One row: points with more than one cluster."""
    return df.agg(F.count_if(F.size("assignments") > 1).alias("multiple_membership_count"))


def detailed_rows(
    df: DataFrame, text: str = "Review", key: str = "review_id", membership: str = "membership"
) -> DataFrame:
    """Detailed fuzzy result: one row per review and assigned cluster with its scores."""
    rows = df.withColumn("assigned_cluster", F.explode("assignments"))
    return rows.select(
        F.col(key).alias("original_index"),
        F.col(text).alias("review"),
        "assigned_cluster",
        F.col(membership)[F.col("assigned_cluster")].alias("membership_score"),
        F.array_max(membership).alias("max_membership"),
        F.size("assignments").alias("n_clusters_assigned"),
    )
