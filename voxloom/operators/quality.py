"""Cluster quality: silhouette, Calinski-Harabasz, Davies-Bouldin."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxloom.checks import require_choice
from voxloom.functions.vectors import squared_distance
from voxloom.operators.cleaning import drop_noise
from voxloom.operators.plane import sums_in_plane
from voxloom.operators.tiles import (
    distance_sums,
    large_tile_rows,
    matrix,
    over_all_pairs,
    squared_distances,
)
from voxloom.session import cut_lineage, stored

# The scores of a run that cannot be judged.
SENTINEL = (-1.0, 0.0, float("inf"))
# Sets of clusters in a tile that are reckoned with when its size is chosen.
GROUPS = 512


def _distance_sums(a: pd.DataFrame, b: pd.DataFrame, same: bool) -> pd.DataFrame:
    """Per point, the sum of its distances to each cluster of the other tile."""
    names, codes = np.unique(np.concatenate((a["label"], b["label"])), return_inverse=True)
    codes_a, codes_b = codes[: len(a)], codes[len(a) :]
    sums = distance_sums(
        matrix(a["features"]), matrix(b["features"]), codes_a, codes_b, len(names), same
    )
    parts = []
    for rows, others, held in ((a, codes_b, sums[0]), (b, codes_a, sums[1])):
        if held is None:
            continue
        there = np.unique(others)
        parts.append(
            pd.DataFrame(
                {
                    "key": np.repeat(rows["key"].to_numpy(), len(there)),
                    "own": np.repeat(rows["label"].to_numpy(), len(there)),
                    "label": np.tile(names[there], len(rows)),
                    "total": held[:, there].ravel(),
                }
            )
        )
    return pd.concat(parts)


def silhouette_samples(
    df: DataFrame, features: str = "features", label: str = "label", key: str = "review_id"
) -> DataFrame:
    """Exact Euclidean silhouette of every point: ``key, silhouette``."""
    points = df.select(
        F.col(key).cast("bigint").alias("key"),
        F.col(label).cast("int").alias("label"),
        F.col(features).cast("array<double>").alias("features"),
    )
    rows, clusters = points.agg(F.count(F.lit(1)), F.count_distinct("label")).first()
    sums = over_all_pairs(
        points, rows, _distance_sums, "key bigint, own int, label int, total double",
        tile_rows=large_tile_rows(rows, clusters),
    )
    sizes = points.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    per_cluster = sums.groupBy("key", "own", "label").agg(F.sum("total").alias("total"))
    own = F.col("label") == F.col("own")
    scored = (
        per_cluster.join(sizes, "label")
        .groupBy("key")
        .agg(
            F.max(F.when(own, F.col("n"))).alias("n"),
            F.max(F.when(own & (F.col("n") > 1), F.col("total") / (F.col("n") - 1))).alias("a"),
            F.min(F.when(~own, F.col("total") / F.col("n"))).alias("b"),
        )
    )
    spread = F.greatest("a", "b")
    value = F.when((F.col("n") == 1) | (spread == 0), 0.0).otherwise(
        (F.col("b") - F.col("a")) / spread
    )
    return scored.select(F.col("key").alias(key), value.alias("silhouette"))


def silhouette(
    df: DataFrame, features: str = "features", label: str = "label", key: str = "review_id"
) -> DataFrame:
    """One row: the mean exact Euclidean silhouette."""
    return silhouette_samples(df, features, label, key).agg(
        F.avg("silhouette").alias("silhouette_score")
    )


def silhouette_squared(df: DataFrame, features: str = "features", label: str = "label") -> float:
    """Silhouette on squared distances: linear time, and a different number."""
    vectors = df.select(
        array_to_vector(F.col(features).cast("array<double>")).alias("f"),
        F.col(label).cast("int").alias("l"),
    )
    return ClusteringEvaluator(
        featuresCol="f", predictionCol="l", distanceMeasure="squaredEuclidean"
    ).evaluate(vectors)


def _moments(df: DataFrame, features: str, label: str) -> DataFrame:
    """Per cluster: size, centroid and the sum of squared distances to it."""
    vector = array_to_vector(F.col(features).cast("array<double>"))
    stats = Summarizer.metrics("mean", "variance", "count").summary(vector)
    return (
        df.groupBy(F.col(label).alias("label"))
        .agg(stats.alias("_s"))
        .select(
            "label",
            F.col("_s.count").alias("n"),
            vector_to_array("_s.mean").alias("centroid"),
            F.aggregate(
                vector_to_array("_s.variance"), F.lit(0.0), lambda s, v: s + v * (F.col("_s.count") - 1)
            ).alias("within"),
        )
    )


def calinski_harabasz(df: DataFrame, features: str = "features", label: str = "label") -> DataFrame:
    """One row: between-cluster over within-cluster spread, by degrees of freedom."""
    moments = _moments(df, features, label)
    weighted = moments.withColumn("_v", array_to_vector("centroid"))
    centre = weighted.agg(
        vector_to_array(Summarizer.mean(F.col("_v"), F.col("n").cast("double")))
    ).scalar()
    total = (
        moments.withColumn("_centre", centre)
        .withColumn("_b", F.col("n") * squared_distance(F.col("centroid"), F.col("_centre")))
        .agg(
            F.sum("_b").alias("b"), F.sum("within").alias("w"), F.sum("n").alias("n"),
            F.count(F.lit(1)).alias("k"),
        )
    )
    n, k = F.col("n"), F.col("k")
    score = F.when(F.col("w") == 0, 1.0).otherwise((F.col("b") / (k - 1)) / (F.col("w") / (n - k)))
    return total.select(score.alias("calinski_harabasz_score"))


def _worst_ratio(a: pd.DataFrame, b: pd.DataFrame, same: bool) -> pd.DataFrame:
    d = np.sqrt(squared_distances(matrix(a["features"]), matrix(b["features"])))
    scatter = a["scatter"].to_numpy()[:, None] + b["scatter"].to_numpy()[None, :]
    other = a["key"].to_numpy()[:, None] != b["key"].to_numpy()[None, :]
    with np.errstate(divide="ignore", invalid="ignore"):
        ratio = np.where(other & (d > 0), scatter / d, np.where(other & (scatter > 0), np.inf, 0.0))
    parts = [pd.DataFrame({"key": a["key"], "ratio": ratio.max(axis=1)})]
    if not same:
        parts.append(pd.DataFrame({"key": b["key"], "ratio": ratio.max(axis=0)}))
    return pd.concat(parts)


def davies_bouldin(df: DataFrame, features: str = "features", label: str = "label") -> DataFrame:
    """One row: mean over clusters of the worst (spread + spread) / centroid distance."""
    centres = _moments(df, features, label).select("label", "centroid")
    vector = F.col(features).cast("array<double>")
    scatter = (
        df.select(F.col(label).alias("label"), vector.alias("_x"))
        .join(centres, "label")
        .groupBy("label")
        .agg(F.avg(F.sqrt(squared_distance(F.col("_x"), F.col("centroid")))).alias("scatter"))
    )
    clusters = centres.join(scatter, "label").select(
        F.col("label").cast("bigint").alias("key"), F.col("centroid").alias("features"), "scatter"
    )
    k = df.agg(F.count_distinct(label)).first()[0]
    ratios = over_all_pairs(clusters, k, _worst_ratio, "key bigint, ratio double")
    return (
        ratios.groupBy("key")
        .agg(F.max("ratio").alias("worst"))
        .agg(F.avg("worst").alias("davies_bouldin_score"))
    )


def clustering_metrics(
    df: DataFrame,
    features: str = "features",
    label: str = "label",
    key: str = "review_id",
    mode: str = "exact",
) -> DataFrame:
    """One row: the three scores without noise points, or the sentinel.

    ``mode`` names the silhouette: ``exact`` compares all points, ``squared`` is
    another score that is linear in them. The number of rows never changes which;
    ``silhouette_mode`` in the result repeats it.
    """
    require_choice("mode", mode, ("exact", "squared"))
    clean = drop_noise(df.select(key, features, label), label).persist()
    n, k = clean.agg(F.count(F.lit(1)), F.count_distinct(label)).first()
    if n < 2 or k < 2 or k >= n:
        scores = SENTINEL
        mode = "none"
    else:
        if mode == "exact":
            first = silhouette(clean, features, label, key).first()[0]
        else:
            first = silhouette_squared(clean, features, label)
        scores = (
            first,
            calinski_harabasz(clean, features, label).first()[0],
            davies_bouldin(clean, features, label).first()[0],
        )
    clean.unpersist()
    out: list[Column] = [
        F.lit(float(scores[0])).alias("silhouette_score"),
        F.lit(float(scores[1])).alias("calinski_harabasz_score"),
        F.lit(float(scores[2])).alias("davies_bouldin_score"),
        F.lit(int(k)).alias("n_clusters_found"),
        F.lit(mode).alias("silhouette_mode"),
    ]
    return df.sparkSession.range(1).select(*out)


def _membership(columns: pd.Series, width: int) -> np.ndarray:
    """The 0/1 matrix of rows and (labelling, cluster) columns."""
    out = np.zeros((len(columns), width))
    sizes = [len(c) for c in columns]
    if sum(sizes):
        out[np.repeat(np.arange(len(columns)), sizes), np.concatenate(columns.to_numpy())] = 1.0
    return out


def many_metrics(
    df: DataFrame,
    assignments: str,
    widths: list[int],
    features: str = "features",
    key: str = "review_id",
    mode: str = "exact",
) -> list[dict]:
    """The scores of many labellings of the same points, from one look at the distances.

    ``assignments`` holds, for each labelling, the clusters of the point: none for noise,
    several if the point counts once in each, as expanded fuzzy rows do. ``widths`` are the
    numbers of clusters, which bound what a task returns for a point. The result is that of
    ``clustering_metrics`` of every labelling, in order.
    """
    require_choice("mode", mode, ("exact", "squared"))
    starts = np.concatenate(([0], np.cumsum(widths))).astype(int)
    total = int(starts[-1])
    offsets = F.array(*[F.lit(int(o)) for o in starts[:-1]])
    columns = F.flatten(
        F.transform(
            F.arrays_zip(F.col(assignments).alias("a"), offsets.alias("o")),
            lambda z: F.transform(z["a"], lambda c: (c + z["o"]).cast("int")),
        )
    )
    points = cut_lineage(
        df.select(
            F.col(key).cast("bigint").alias("key"),
            F.col(features).cast("array<double>").alias("features"),
            columns.alias("columns"),
        )
    )
    names = points.select("features", "columns")

    def moments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = 0.0
        for batch in batches:
            if len(batch):
                x, one = matrix(batch["features"]), _membership(batch["columns"], total)
                held = held + np.concatenate((one.sum(axis=0), (one.T @ x).ravel()))
        if not np.isscalar(held):
            yield pd.DataFrame({"part": [held.tolist()]})

    first = _added(names.mapInPandas(moments, "part array<double>"))
    if first is None:
        return [_record(SENTINEL, 0, "none") for _ in widths]
    n, sums = first[:total], first[total:].reshape(total, -1)
    centres = sums / np.maximum(n, 1)[:, None]

    def spreads(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = np.zeros(2 * total)
        for batch in batches:
            if len(batch):
                x, one = matrix(batch["features"]), _membership(batch["columns"], total)
                for c in np.flatnonzero(n):
                    d2 = ((x[one[:, c] > 0] - centres[c]) ** 2).sum(axis=1)
                    held[c] += d2.sum()
                    held[total + c] += np.sqrt(d2).sum()
        yield pd.DataFrame({"part": [held.tolist()]})

    second = _added(names.mapInPandas(spreads, "part array<double>"))
    within, scatter = second[:total], second[total:] / np.maximum(n, 1)
    judged = [
        2 <= (n[a:b] > 0).sum() < n[a:b].sum() and n[a:b].sum() >= 2
        for a, b in zip(starts[:-1], starts[1:])
    ]
    widths_found = [int((n[a:b] > 0).sum()) for a, b in zip(starts[:-1], starts[1:])]
    silhouettes = [-1.0] * len(widths)
    if any(judged):
        silhouettes = (_exact_means if mode == "exact" else _squared_means)(points, starts, n, centres, within)
    out = []
    for i, (a, b) in enumerate(zip(starts[:-1], starts[1:])):
        if not judged[i]:
            out.append(_record(SENTINEL, widths_found[i], "none"))
            continue
        used = np.arange(a, b)[n[a:b] > 0]
        size, mean = n[used], centres[used]
        middle = (mean * size[:, None]).sum(axis=0) / size.sum()
        between = (size * ((mean - middle) ** 2).sum(axis=1)).sum()
        k, w = len(used), within[used].sum()
        ch = 1.0 if w == 0 else (between / (k - 1)) / (w / (size.sum() - k))
        d = np.sqrt(((mean[:, None] - mean[None]) ** 2).sum(axis=2))
        both = scatter[used][:, None] + scatter[used][None]
        np.fill_diagonal(both, 0.0)
        with np.errstate(divide="ignore", invalid="ignore"):
            ratio = np.where(d > 0, both / d, np.where(both > 0, np.inf, 0.0))
        out.append(_record((silhouettes[i], ch, ratio.max(axis=1).mean()), k, mode))
    return out


def _record(scores: tuple, k: int, mode: str) -> dict:
    names = ("silhouette_score", "calinski_harabasz_score", "davies_bouldin_score")
    found = {name: float(v) for name, v in zip(names, scores)}
    return found | {"n_clusters_found": int(k), "silhouette_mode": mode}


def _added(parts: DataFrame) -> np.ndarray | None:
    total = vector_to_array(Summarizer.sum(array_to_vector("part"))).alias("total")
    row = parts.groupBy(F.lit(0).alias("all")).agg(total).first()
    return None if row is None else np.array(row["total"])


def _silhouette_sums(one: np.ndarray, away: np.ndarray, n: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sum of the silhouettes of each labelling, from the rows' distance sums to all clusters."""
    mean = np.where(n > 0, away / np.maximum(n, 1), np.inf)
    held = np.zeros(len(starts) - 1)
    for i, (a, b) in enumerate(zip(starts[:-1], starts[1:])):
        for c in range(a, b):
            mine = one[:, c] > 0
            if n[c] < 2 or not mine.any():  # a lone point scores 0
                continue
            own = away[mine, c] / (n[c] - 1)
            other = np.delete(mean[mine, a:b], c - a, axis=1).min(axis=1, initial=np.inf)
            most = np.maximum(own, other)
            with np.errstate(divide="ignore", invalid="ignore"):
                held[i] += np.where((most > 0) & np.isfinite(most), (other - own) / most, 0.0).sum()
    return held


def _away(points: DataFrame, total: int) -> DataFrame:
    """``key, away``: distances of a point to all points, summed by cluster of every labelling."""

    def sums(a: pd.DataFrame, b: pd.DataFrame, same: bool) -> pd.DataFrame:
        # Points in the same clusters under every labelling are one group.
        listed = pd.concat([a["columns"], b["columns"]], ignore_index=True)
        codes, groups = pd.factorize(listed.map(tuple))
        held = distance_sums(
            matrix(a["features"]), matrix(b["features"]), codes[: len(a)], codes[len(a) :],
            len(groups), same,
        )
        clusters = _membership(pd.Series([list(g) for g in groups]), total)
        parts = [
            pd.DataFrame({"key": rows["key"], "away": list(away @ clusters)})
            for rows, away in zip((a, b), held)
            if away is not None
        ]
        return pd.concat(parts)

    found = sums_in_plane(points, total)
    if found is None:
        rows = points.count()
        # A tile with many groups holds a number for each of them and every point.
        found = over_all_pairs(
            points, rows, sums, "key bigint, away array<double>",
            tile_rows=large_tile_rows(rows, max(total, GROUPS)),
        )
    return found.groupBy("key").agg(vector_to_array(Summarizer.sum(array_to_vector("away"))).alias("away"))


def _exact_means(points: DataFrame, starts: np.ndarray, n: np.ndarray, *_: np.ndarray) -> list[float]:
    """Mean silhouettes from the distances of all points, summed by cluster of every labelling."""
    total = int(starts[-1])

    def means(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = np.zeros(len(starts) - 1)
        for batch in batches:
            if not len(batch):
                continue
            one, away = _membership(batch["columns"], total), matrix(batch["away"])
            held += _silhouette_sums(one, away, n, starts)
        yield pd.DataFrame({"part": [held.tolist()]})

    scored = points.select("key", "columns").join(_away(points, total), "key").select("columns", "away")
    total_of = _added(scored.mapInPandas(means, "part array<double>"))
    return [float(t / max(1, n[a:b].sum())) for t, a, b in zip(total_of, starts[:-1], starts[1:])]


def silhouettes(
    df: DataFrame, labels: str, features: str = "features", key: str = "review_id"
) -> list[float]:
    """The mean exact silhouette of many labellings, from one look at the distances.

    ``labels`` has one cluster, from 0 on, for each labelling. A result is that of
    ``silhouette`` on its labels: a key that comes with equal rows counts once.
    """
    most = Summarizer.max(array_to_vector(F.col(labels).cast("array<double>")))
    widths = [int(v) + 1 for v in df.agg(vector_to_array(most)).first()[0]]
    starts = np.concatenate(([0], np.cumsum(widths))).astype(int)
    offsets = F.array(*[F.lit(int(o)) for o in starts[:-1]])
    points = stored(
        df.select(
            F.monotonically_increasing_id().alias("key"),
            F.col(key).alias("row"),
            F.col(features).cast("array<double>").alias("features"),
            F.zip_with(labels, offsets, lambda c, o: c + o).cast("array<int>").alias("columns"),
        )
    )
    total = int(starts[-1])
    n = np.zeros(total)
    for r in points.select(F.explode("columns").alias("c")).groupBy("c").count().collect():
        n[r["c"]] = r["count"]

    def means(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = np.zeros(len(starts))
        for batch in batches:
            if not len(batch):
                continue
            one, away = _membership(batch["columns"], total), matrix(batch["away"])
            held[:-1] += _silhouette_sums(one, away, n, starts)
            held[-1] += len(batch)
        yield pd.DataFrame({"part": [held.tolist()]})

    scored = points.select("key", "row", "columns").join(_away(points, total), "key")
    scored = scored.groupBy("row", "columns").agg(F.first("away").alias("away"))
    sums = _added(scored.select("columns", "away").mapInPandas(means, "part array<double>"))
    return (sums[:-1] / max(1.0, sums[-1])).tolist()


def _squared_means(
    points: DataFrame, starts: np.ndarray, n: np.ndarray, centres: np.ndarray, within: np.ndarray
) -> list[float]:
    """Mean silhouettes on squared distances, which moments alone give: one linear pass."""
    total = int(starts[-1])

    def means(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = np.zeros(len(starts) - 1)
        for batch in batches:
            if not len(batch):
                continue
            one, x = _membership(batch["columns"], total), matrix(batch["features"])
            d2 = np.stack([((x - c) ** 2).sum(axis=1) for c in centres], axis=1)
            away = n * d2 + within
            held += _silhouette_sums(one, away, n, starts)
        yield pd.DataFrame({"part": [held.tolist()]})

    total_of = _added(points.select("columns", "features").mapInPandas(means, "part array<double>"))
    return [float(t / max(1, n[a:b].sum())) for t, a, b in zip(total_of, starts[:-1], starts[1:])]
