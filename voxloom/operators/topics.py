"""Topic clustering: vectors as counts, LDA, strongest topic as label."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.clustering import LDA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxloom.functions.vectors import argmax
from voxloom.operators.many import add_up, slot_columns

# Steps for the topics of one row (fewer while the topics themselves still move), and the
# share of the row that may still move when it ends.
ROW_ROUNDS = 100
FIT_ROUNDS = 20
ROW_TOLERANCE = 1e-5
# A round moves the topics by (offset + round) to this power downwards.
OFFSET, DECAY = 10.0, 0.7
# Rows that a task of a fit has at least when a scan is dealt to more tasks.
ROWS_A_TASK = 1_024
# A row's topics are settled when their Dirichlet moves by this much on average, as in Spark.
SETTLED = 1e-3
# Plain steps before the first Newton step, and Newton steps before a row goes on with plain ones.
FIRST_STEPS, NEWTON_STEPS = 20, 500
# Numbers that the rows of a batch of Newton steps hold at most.
BATCH_NUMBERS = 1 << 20


def as_counts(df: DataFrame, features: str = "features", out: str = "counts") -> DataFrame:
    """Vectors as positive whole numbers: shifted by the global minimum, times 1000."""
    vector = F.col(features).cast("array<double>")
    low = df.agg(F.min(F.array_min(vector))).scalar()
    shift = F.least(F.col("_low"), F.lit(0.0))
    counts = F.transform(
        vector,
        lambda v: F.greatest(((v - shift + 1e-10) * 1000.0).cast("int"), F.lit(1)),
    )
    return df.withColumn("_low", low).withColumn(out, counts).drop("_low")


def _counted(df: DataFrame, features: str) -> DataFrame:
    return as_counts(df, features).withColumn(
        "_counts", array_to_vector(F.col("counts").cast("array<double>"))
    )


def _lda(k: int, seed: int, passes: int, share: float) -> LDA:
    rounds = max(1, round(passes / share))
    return LDA(
        k=k, seed=seed, maxIter=rounds, optimizer="online", learningOffset=OFFSET,
        learningDecay=DECAY, subsamplingRate=share, featuresCol="_counts",
        topicDistributionCol="_topics",
    )


def digamma(x: np.ndarray) -> np.ndarray:
    """Derivative of log gamma for positive numbers: six steps up, then the asymptotic series."""
    y = x + 6.0
    z = 1.0 / (y * y)
    series = z * (1 / 12 - z * (1 / 120 - z * (1 / 252 - z * (1 / 240 - z * (5 / 660)))))
    return np.log(y) - 0.5 / y - series - sum(1.0 / (x + i) for i in range(6))


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Log gamma for positive numbers, in the same way."""
    y = x + 6.0
    z = 1.0 / (y * y)
    series = (1 / 12 - z * (1 / 360 - z * (1 / 1260 - z / 1680))) / y
    steps = sum(np.log(x + i) for i in range(6))
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + series - steps


def trigamma(x: np.ndarray) -> np.ndarray:
    """Derivative of digamma for positive numbers, in the same way."""
    y = x + 6.0
    z = 1.0 / (y * y)
    series = 1.0 / y + z / 2 + z / y * (1 / 6 - z * (1 / 30 - z * (1 / 42 - z / 30)))
    return series + sum(1.0 / (x + i) ** 2 for i in range(6))


def _expected_log(concentration: np.ndarray) -> np.ndarray:
    """Expected logarithms of Dirichlet shares, one distribution a row."""
    return digamma(concentration) - digamma(concentration.sum(axis=1, keepdims=True))


@dataclass
class TopicModel:
    """Topics of one (slot, k): ``words`` is the k x d Dirichlet, ``low`` the slot's minimum."""

    words: np.ndarray
    low: float
    log_likelihood: float = float("nan")

    def counts(self, x: np.ndarray) -> np.ndarray:
        whole = np.trunc((x - min(self.low, 0.0) + 1e-10) * 1000.0)
        return np.clip(whole, 1.0, 2**31 - 1)

    def strengths(self, counts: np.ndarray, rounds: int = ROW_ROUNDS) -> np.ndarray:
        """Dirichlet of the topics of each row; a row ends by itself, whatever its batch."""
        k = len(self.words)
        beta = np.exp(_expected_log(self.words))
        found = np.ones((len(counts), k))
        active = np.arange(len(counts))
        for _ in range(rounds):
            if not len(active):
                break
            mine, c = found[active], counts[active]
            theta = np.exp(_expected_log(mine))
            moved = theta * ((c / (theta @ beta + 1e-100)) @ beta.T) + 1.0 / k
            found[active] = moved
            step = np.abs(moved - mine).sum(axis=1)
            active = active[step > ROW_TOLERANCE * moved.sum(axis=1)]
        return found

    def labels(self, x: np.ndarray) -> np.ndarray:
        return self.strengths(self.counts(x)).argmax(axis=1)


def _topic_kernel(hashes: np.ndarray, x: np.ndarray, model: TopicModel) -> np.ndarray:
    """Expected counts of every topic and word over the rows."""
    counts = model.counts(x)
    theta = np.exp(_expected_log(model.strengths(counts, FIT_ROUNDS)))
    beta = np.exp(_expected_log(model.words))
    return (theta.T @ (counts / (theta @ beta + 1e-100)) * beta).ravel()


def _bound_kernel(hashes: np.ndarray, x: np.ndarray, model: TopicModel) -> np.ndarray:
    """What the rows add to the lower bound of the log-likelihood."""
    k, counts = len(model.words), model.counts(x)
    gamma = model.strengths(counts)
    share = _expected_log(gamma)
    likely = np.log(np.exp(share) @ np.exp(_expected_log(model.words)) + 1e-100)
    alpha = np.full(k, 1.0 / k)
    rows = (counts * likely).sum(axis=1) + ((alpha - gamma) * share).sum(axis=1)
    rows += (log_gamma(gamma) - log_gamma(alpha)).sum(axis=1)
    rows += log_gamma(np.array([1.0]))[0] - log_gamma(gamma.sum(axis=1))
    return np.array([rows.sum()])


def _word_bound(words: np.ndarray) -> float:
    """The part of the bound that the topics themselves add."""
    k, d = words.shape
    eta = np.array([1.0 / k])
    total = ((eta - words) * _expected_log(words) + log_gamma(words) - log_gamma(eta)).sum()
    return float(total + (log_gamma(eta * d) - log_gamma(words.sum(axis=1))).sum())


def fit_many_topics(
    df: DataFrame,
    wanted: list[tuple[str, int]],
    passes: int = 50,
    seed: int = 42,
    offset: float = OFFSET,
    decay: float = DECAY,
) -> dict[tuple[str, int], TopicModel]:
    """Topic models of every (features column, k), all of them in one pass a round.

    Variational inference as in ``fit_topics`` with whole passes as batches and 1/k as weight of
    a topic in a row: a round moves
    the topics towards the expected counts of all rows by ``(offset + round) ** -decay``.
    Tasks return k x d numbers a model, whatever the rows.
    """
    slots = list(dict.fromkeys(s for s, _ in wanted))
    points = df.select(F.lit(0).cast("bigint").alias("hash"), *slot_columns(slots)).persist()
    shape = points.agg(
        *[F.min(F.array_min(s)).alias(f"low{i}") for i, s in enumerate(slots)],
        *[F.max(F.size(s)).alias(f"size{i}") for i, s in enumerate(slots)],
    ).first()
    if shape["low0"] is None:
        points.unpersist()
        raise ValueError("no points to cluster")
    models = {}
    for slot, k in wanted:
        i = slots.index(slot)
        start = np.random.default_rng([seed, k]).gamma(100.0, 0.01, (k, shape[f"size{i}"]))
        models[slot, k] = TopicModel(start, shape[f"low{i}"])
    for round_no in range(1, passes + 1):
        totals = add_up(points, [(slot, m) for (slot, _), m in models.items()], _topic_kernel)
        weight = (offset + round_no) ** -decay
        for model, total in zip(models.values(), totals):
            new = total.reshape(model.words.shape) + 1.0 / len(model.words)
            model.words = (1 - weight) * model.words + weight * new
    bounds = add_up(points, [(slot, m) for (slot, _), m in models.items()], _bound_kernel)
    for model, bound in zip(models.values(), bounds):
        model.log_likelihood = float(bound[0]) + _word_bound(model.words)
    points.unpersist()
    return models


def _row_bound(counts, gamma, share, mix, alpha) -> np.ndarray:
    """A row's part of the lower bound, up to what only ``alpha`` adds."""
    own = ((alpha - gamma) * share + log_gamma(gamma)).sum(axis=1) - log_gamma(gamma.sum(axis=1))
    return (counts * np.log(mix)).sum(axis=1) + own


def _settle(counts: np.ndarray, gamma: np.ndarray, beta: np.ndarray, alpha: np.ndarray) -> np.ndarray:
    """Plain steps until a row is settled."""
    active = np.arange(len(counts))
    while len(active):
        theta = np.exp(_expected_log(gamma[active]))
        moved = theta * ((counts[active] / (theta @ beta + 1e-100)) @ beta.T) + alpha
        step = np.abs(moved - gamma[active]).mean(axis=1)
        gamma[active] = moved
        active = active[step > SETTLED]
    return gamma


def _newton_batch(counts: np.ndarray, beta: np.ndarray, alpha: np.ndarray) -> np.ndarray:
    k, width = beta.shape
    at = np.arange(k)
    pairs = (beta[:, None] * beta[None]).reshape(k * k, width).T
    gamma = np.ones((len(counts), k))
    for _ in range(FIRST_STEPS):
        theta = np.exp(_expected_log(gamma))
        gamma = theta * ((counts / (theta @ beta + 1e-100)) @ beta.T) + alpha
    found, active = gamma.copy(), np.arange(len(counts))
    damp, before = np.zeros(len(counts)), None
    for _ in range(NEWTON_STEPS):
        share = _expected_log(gamma)
        theta = np.exp(share)
        mix = theta @ beta + 1e-100
        ratio = counts / mix
        mass = theta * (ratio @ beta.T)
        value = _row_bound(counts, gamma, share, mix, alpha)
        curve = ((ratio / mix) @ pairs).reshape(-1, k, k) * theta[:, :, None] * theta[:, None, :]
        if before is not None:
            # A step that lowered the bound is taken again, shorter.
            worse = ~(value >= before[0] - 1e-10 * np.abs(before[0]))
            damp = np.where(worse, np.maximum(damp * 4, 0.25), np.where(damp < 0.05, 0.0, damp / 4))
            value, gamma = np.where(worse, before[0], value), np.where(worse[:, None], before[1], gamma)
            mass = np.where(worse[:, None], before[2], mass)
            curve = np.where(worse[:, None, None], before[3], curve)
        root = np.sqrt(trigamma(gamma))
        slope = curve * root[:, :, None] * root[:, None, :]
        slope[:, at, at] += 1 - mass * root * root
        values, vectors = np.linalg.eigh(slope)
        convex = (values > 0).all(axis=1)
        values = np.maximum(np.abs(values), 1e-7) + damp[:, None]
        pull = (mass + alpha - gamma) * root
        step = np.einsum("nij,nj->ni", vectors, np.einsum("nij,ni->nj", vectors, pull) / values) / root
        # A topic goes down to a tenth of its mass in a step; the others move knowing that.
        low = np.minimum(alpha + 0.1 * mass, gamma)
        held = gamma + step < low
        if (rows := np.flatnonzero(held.any(axis=1))).size:
            full = np.einsum("nij,nj,nkj->nik", vectors[rows], values[rows], vectors[rows])
            fixed = np.where(held[rows], (low[rows] - gamma[rows]) * root[rows], 0.0)
            rest = np.where(held[rows], fixed, pull[rows] - np.einsum("nij,nj->ni", full, fixed))
            free = 1.0 - held[rows]
            full *= free[:, :, None] * free[:, None, :]
            full[:, at, at] += held[rows]
            step[rows] = np.linalg.solve(full, rest[:, :, None])[:, :, 0] / root[rows]
        moved = np.maximum(gamma + step, low)
        done = (np.abs(moved - gamma).mean(axis=1) <= SETTLED) & convex & (damp == 0)
        found[active] = moved
        go = ~done
        before = [value[go], gamma[go], mass[go], curve[go]]
        active, counts, gamma, damp = active[go], counts[go], moved[go], damp[go]
        if not len(active):
            break
    else:
        found[active] = _settle(counts, before[1], beta, alpha)
    return found


def settled_strengths(counts: np.ndarray, words: np.ndarray, alpha: np.ndarray) -> np.ndarray:
    """Dirichlet of the topics of each row where its steps end, by damped Newton steps.

    Counts of some hundreds make the plain steps of the inference move by a ten-thousandth of
    the way, so a row would need thousands of them. A row without counts has zeros.
    """
    found = np.zeros((len(counts), len(words)))
    some = np.flatnonzero(counts.any(axis=1))
    beta = np.exp(_expected_log(words))
    size = max(1, BATCH_NUMBERS // max(len(words) ** 2, counts.shape[1], 1))
    for top in range(0, len(some), size):
        rows = some[top : top + size]
        found[rows] = _newton_batch(counts[rows], beta, alpha)
    return found


def _learning_kernel(hashes: np.ndarray, counts: np.ndarray, model: LearnedTopics) -> np.ndarray:
    """Expected counts of topics and words, the logarithms of the shares, and the rows."""
    counts = counts[counts.any(axis=1)]
    # Copies that a sample drew of a row stand together.
    new = np.ones(len(counts), bool)
    new[1:] = (counts[1:] != counts[:-1]).any(axis=1)
    times = np.diff(np.append(np.flatnonzero(new), len(counts)))[:, None].astype("float64")
    rows = counts[new]
    share = _expected_log(settled_strengths(rows, model.words, model.alpha))
    theta, beta = np.exp(share), np.exp(_expected_log(model.words))
    total = (theta.T @ (times * rows / (theta @ beta + 1e-100))) * beta
    return np.concatenate((total.ravel(), (times * share).sum(axis=0), [times.sum()]))


def _learned_bound_kernel(hashes: np.ndarray, counts: np.ndarray, model: LearnedTopics) -> np.ndarray:
    counts = counts[counts.any(axis=1)]
    gamma = settled_strengths(counts, model.words, model.alpha)
    share = _expected_log(gamma)
    mix = np.exp(share) @ np.exp(_expected_log(model.words)) + 1e-100
    alone = log_gamma(model.alpha.sum(keepdims=True))[0] - log_gamma(model.alpha).sum()
    return np.array([_row_bound(counts, gamma, share, mix, model.alpha).sum() + alone * len(counts)])


@dataclass
class LearnedTopics:
    """Topics and their weights in a row: ``words`` is the k x d Dirichlet, ``alpha`` has k."""

    words: np.ndarray
    alpha: np.ndarray

    def transform(self, counted: DataFrame) -> DataFrame:
        """``_topics``: the shares of the topics in the vector ``_counts``."""
        words, alpha = self.words, self.alpha

        @F.pandas_udf("array<double>")
        def shares(column: pd.Series) -> pd.Series:
            counts = np.zeros((len(column), words.shape[1]))
            for row, held in zip(counts, column):
                row[: len(held)] = held
            found = settled_strengths(counts, words, alpha)
            return pd.Series(list(found / np.maximum(found.sum(axis=1, keepdims=True), 1e-300)))

        return counted.withColumn("_topics", array_to_vector(shares(vector_to_array("_counts"))))

    def log_likelihood(self, points: DataFrame) -> float:
        """The lower bound over the rows of ``points``, with ``hash`` and ``counts``."""
        total = add_up(points, [("counts", self)], _learned_bound_kernel)
        return float(total[0][0]) + _word_bound(self.words)


@dataclass
class TopicFit:
    model: LearnedTopics
    perplexity: float
    log_likelihood: float
    labels: DataFrame


class _Seeds:
    """The 64-bit numbers of ``java.util.Random``, from which Spark's fit takes its seeds."""

    def __init__(self, seed: int) -> None:
        self.state = (seed ^ 0x5DEECE66D) & (2**48 - 1)

    def _bits(self) -> int:
        self.state = (self.state * 0x5DEECE66D + 0xB) & (2**48 - 1)
        return (self.state >> 16) - ((self.state >> 47) << 32)

    def next(self) -> int:
        number = ((self._bits() << 32) + self._bits()) & (2**64 - 1)
        return number - ((number >> 63) << 64)


def _learn_weights(alpha: np.ndarray, logs: np.ndarray, rows: float, weight: float) -> np.ndarray:
    """A step of Newton's method for the weights of the topics, if it keeps them above 0."""
    slope = rows * (logs - _expected_log(alpha[None])[0])
    c, q = rows * trigamma(alpha.sum(keepdims=True))[0], -rows * trigamma(alpha)
    b = (slope / q).sum() / (1.0 / c + (1.0 / q).sum())
    moved = alpha - weight * (slope - b) / q
    return moved if (moved > 0).all() else alpha


def fit_topics(
    df: DataFrame, k: int, features: str = "features", seed: int = 42, passes: int = 50,
    share: float = 1.0,
) -> TopicFit:
    """Online LDA over the scaled vectors; the label is the strongest topic.

    The fit sees every row about ``passes`` times, in batches that hold ``share``
    of them, whatever their number. It is Spark's: the same first topics, samples and steps,
    but the topics of a row are found by ``settled_strengths``.
    """
    counted = _counted(df, features)
    # A small file is one task, whatever the passes over it cost.
    n = df.count()
    tasks = min(df.sparkSession.sparkContext.defaultParallelism, n // ROWS_A_TASK)
    if tasks > counted.rdd.getNumPartitions():
        counted = counted.repartition(tasks, features)
    counted = counted.persist()
    longest, tokens = counted.agg(
        F.max(F.size("counts")), F.sum(F.aggregate("counts", F.lit(0.0), lambda s, v: s + v))
    ).first()
    first = counted.select("counts").first()
    if first is None or longest > len(first[0]):
        counted.unpersist()
        raise ValueError("topics need rows, none of them longer than the first")
    fresh = _lda(k, seed, passes, share)
    # Without a round Spark returns the topics it would begin with.
    start = fresh.copy({fresh.maxIter: 0}).fit(counted.limit(1)).topicsMatrix().toArray().T
    model = LearnedTopics(start, np.full(k, 1.0 / k))
    width = start.shape[1]
    filled = F.concat("counts", F.array_repeat(F.lit(0), F.lit(width) - F.size("counts")))
    points = counted.select(F.lit(0).cast("bigint").alias("hash"), filled.alias("counts"))
    batch, round_no = math.ceil(share * n), 0
    seeds = _Seeds(seed)
    seeds.next()
    for _ in range(fresh.getMaxIter()):
        drawn = points.sample(True, share, seeds.next())
        totals = add_up(drawn, [("counts", model)], _learning_kernel)
        if not totals:
            continue
        # Spark draws a seed for the rows' first topics here.
        seeds.next()
        round_no += 1
        found, logs, rows = totals[0][: k * width], totals[0][k * width : -1], totals[0][-1]
        if not rows:
            continue
        weight = (OFFSET + round_no) ** -DECAY
        new = found.reshape(k, width) * (n / batch) + 1.0 / k
        model = LearnedTopics(
            (1 - weight) * model.words + weight * new, _learn_weights(model.alpha, logs / rows, rows, weight)
        )
    labelled = model.transform(counted).withColumn("label", argmax(vector_to_array("_topics")))
    likely = model.log_likelihood(points)
    counted.unpersist()
    return TopicFit(model, -likely / tokens, likely, labelled.drop("_counts", "_topics", "counts"))
