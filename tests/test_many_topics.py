"""Topic models that move together, against Spark's inference and against plain loops."""

import math

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from voxloom.operators import topics
from voxloom.operators.topics import TopicModel, fit_many_topics, fit_topics


@pytest.fixture(scope="module")
def rows(spark):
    """Three planted topics of four words each, weak noise everywhere."""
    draw = np.random.default_rng(8)
    kind = draw.integers(0, 3, 240)
    x = draw.uniform(0.0, 0.01, (240, 12))
    for i, c in enumerate(kind):
        x[i, 4 * c : 4 * c + 4] += draw.uniform(0.2, 0.4, 4)
    table = [(i, v.tolist(), v[:8].tolist()) for i, v in enumerate(x)]
    schema = "review_id long, features array<double>, part array<double>"
    return kind, x, spark.createDataFrame(table, schema).repartition(4)


def test_special_functions():
    x = np.array([1e-3, 0.1, 0.5, 1.0, 2.5, 7.9, 8.0, 123.0, 1e6])
    assert np.allclose(topics.log_gamma(x), [math.lgamma(v) for v in x], rtol=1e-10, atol=1e-10)
    step = 1e-5 * x
    slope = [(math.lgamma(v + h) - math.lgamma(v - h)) / (2 * h) for v, h in zip(x, step)]
    assert np.allclose(topics.digamma(x), slope, rtol=1e-4, atol=1e-4)
    assert np.isclose(topics.digamma(np.array([1.0]))[0], -0.5772156649015329)


def test_inference_and_bound_equal_spark(rows):
    """With the topics of Spark's model: the same shares of every row and the same bound."""
    _, x, df = rows
    counted = topics._counted(df, "features").persist()
    fitted = topics._lda(3, 42, 10, 1.0).setOptimizeDocConcentration(False).fit(counted)
    model = TopicModel(fitted.topicsMatrix().toArray().T, float(x.min()))
    shares = fitted.transform(counted).select("review_id", vector_to_array("_topics").alias("s"))
    expected = np.array([r["s"] for r in sorted(shares.collect(), key=lambda r: r["review_id"])])
    strengths = model.strengths(model.counts(x))
    assert np.allclose(strengths / strengths.sum(axis=1, keepdims=True), expected, atol=2e-3)
    bound = topics._bound_kernel(None, x, model)[0] + topics._word_bound(model.words)
    assert np.isclose(bound, fitted.logLikelihood(counted), rtol=1e-5)
    counts = {r["review_id"]: r["counts"] for r in counted.collect()}
    assert all(model.counts(x[i : i + 1])[0].astype(int).tolist() == c for i, c in counts.items())
    counted.unpersist()


def test_together_as_alone_and_planted_topics(rows):
    kind, x, df = rows
    wanted = [("features", 2), ("part", 3), ("features", 3)]
    together = fit_many_topics(df, wanted, passes=15)
    for slot, k in wanted:
        alone = fit_many_topics(df, [(slot, k)], passes=15)[slot, k]
        assert np.allclose(alone.words, together[slot, k].words)
        assert np.isclose(alone.log_likelihood, together[slot, k].log_likelihood)
    label = together["features", 3].labels(x)
    assert len({(a, b) for a, b in zip(kind, label)}) == 3
    # As good a bound as Spark's own fit on the same counts.
    spark_fit = fit_topics(df, 3, passes=15)
    assert together["features", 3].log_likelihood > spark_fit.log_likelihood * 1.02  # both negative


def test_a_pass_equals_a_loop_over_rows(rows):
    _, x, _ = rows
    model = TopicModel(np.random.default_rng(1).gamma(100.0, 0.01, (3, 12)), float(x.min()))
    total = np.zeros((3, 12))
    for row in x:
        total += topics._topic_kernel(None, row[None, :], model).reshape(3, 12)
    assert np.allclose(total, topics._topic_kernel(None, x, model).reshape(3, 12))
    # Every counted word belongs to some topic.
    assert np.allclose(total.sum(axis=0), model.counts(x).sum(axis=0))


def test_no_points_to_model(rows):
    with pytest.raises(ValueError):
        fit_many_topics(rows[2].limit(0), [("features", 2)])
