"""The topics of a row by Newton steps, against Spark's fit and against plain steps."""

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array

from voxloom.operators import topics as T


@pytest.fixture(scope="module")
def x():
    """Rows that mix four directions at all shares, with counts of some hundreds."""
    draw = np.random.default_rng(4)
    directions = draw.uniform(0.0, 1.0, (4, 10))
    return draw.dirichlet(np.full(4, 0.5), 60) @ directions + draw.uniform(0, 0.05, (60, 10))


@pytest.fixture(scope="module")
def df(spark, x):
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    return spark.createDataFrame(rows, "review_id long, features array<double>").coalesce(2)


def plain(counts, words, alpha):
    beta, gamma, steps = np.exp(T._expected_log(words)), np.ones((len(counts), len(words))), 0
    active = np.arange(len(counts))
    while len(active):
        theta = np.exp(T._expected_log(gamma[active]))
        moved = theta * ((counts[active] / (theta @ beta)) @ beta.T) + alpha
        far = np.abs(moved - gamma[active]).mean(axis=1) > 1e-6
        gamma[active] = moved
        active, steps = active[far], steps + len(active)
    return gamma, steps


def test_newton_steps_end_where_plain_steps_do(x, monkeypatch):
    counts = np.trunc(x * 1000)
    words = np.random.default_rng(2).gamma(100.0, 0.01, (4, 10)) * 50
    alpha = np.array([0.25, 0.1, 0.4, 0.25])
    looks, product = [], T._row_bound
    monkeypatch.setattr(T, "_row_bound", lambda c, *a: looks.append(len(c)) or product(c, *a))
    found = T.settled_strengths(counts, words, alpha)
    expected, steps = plain(counts, words, alpha)
    shares = [g / g.sum(axis=1, keepdims=True) for g in (found, expected)]
    assert np.median(np.abs(shares[0] - shares[1]).max(axis=1)) < 1e-6
    assert sum(looks) < steps / 20
    beta = np.exp(T._expected_log(words))

    def bound(gamma):
        share = T._expected_log(gamma)
        return product(counts, gamma, share, np.exp(share) @ beta, alpha)

    # Where a row has more than one end, it is no worse one.
    assert (bound(found) >= bound(expected) - 1e-6).all()
    # Rows that Newton's steps don't settle go on with plain ones.
    monkeypatch.setattr(T, "NEWTON_STEPS", 1)
    slow = T.settled_strengths(counts[:5], words, alpha)
    assert (bound_of(slow, counts[:5], beta, alpha, product) >= bound(expected)[:5] - 1).all()
    assert (T.settled_strengths(np.zeros((2, 10)), words, alpha) == 0).all()


def bound_of(gamma, counts, beta, alpha, product):
    share = T._expected_log(gamma)
    return product(counts, gamma, share, np.exp(share) @ beta, alpha)


def test_the_fit_equals_sparks(df):
    counted = T._counted(df, "features").persist()
    spark_fit = T._lda(3, 7, 4, 1.0).fit(counted)
    fit = T.fit_topics(df, 3, seed=7, passes=4)
    words = spark_fit.topicsMatrix().toArray().T
    assert np.allclose(fit.model.words, words, rtol=1e-2)
    assert np.allclose(fit.model.alpha, spark_fit.estimatedDocConcentration().toArray(), rtol=1e-2)
    assert np.isclose(fit.log_likelihood, spark_fit.logLikelihood(counted), rtol=1e-3)
    assert np.isclose(fit.perplexity, spark_fit.logPerplexity(counted), rtol=1e-3)
    theirs = spark_fit.transform(counted).select("review_id", vector_to_array("_topics").alias("s"))
    best = {r["review_id"]: int(np.argmax(r["s"])) for r in theirs.collect()}
    ours = {r["review_id"]: r["label"] for r in fit.labels.collect()}
    assert np.mean([best[i] == ours[i] for i in best]) > 0.95
    counted.unpersist()


def test_short_rows_count_as_before_and_long_ones_fail(spark, df):
    short = df.unionByName(spark.createDataFrame([(99, [0.3, 0.2])], df.schema))
    assert T.fit_topics(short, 2, passes=2).labels.count() == 61
    long = df.unionByName(spark.createDataFrame([(99, [0.3] * 11)], df.schema))
    with pytest.raises(ValueError, match="longer"):
        T.fit_topics(long, 2, passes=2)


def test_special_function():
    x = np.array([1e-3, 0.1, 1.0, 7.9, 123.0, 1e6])
    step = 1e-5 * x
    slope = (T.digamma(x + step) - T.digamma(x - step)) / (2 * step)
    assert np.allclose(T.trigamma(x), slope, rtol=1e-4)
