"""The checks of a study's rows: they hold for a right record and fail for a wrong one."""

import pytest

from voxloom.catalog.learning import study_holds
from voxloom.schemas import STUDY

POINTS = 100
# W (1 + C (k - 1) / (n - k)) is 300 for both.
KMEANS = [(2, 150.0, 98.0), (3, 100.0, 97.0)]


def record(name, algorithm, k, found, scores=(0.4, 10.0, 0.8), **params):
    return (name, algorithm, "pca", 2, k, found, *scores, 1.0, {a: float(v) for a, v in params.items()})


def kmeans(k, inertia, ch, **other):
    given = {"inertia": inertia, "iterations": 4} | other
    return record(f"k{k}", "kmeans", k, k, (0.4, ch, 0.8), **given)


RIGHT = [
    *[kmeans(*row) for row in KMEANS],
    record("fuzzy", "fuzzy_cmeans", 4, 1, (-1.0, 0.0, float("inf")), fpc=0.25, objective=3, iterations=9, multiple_membership=0),
    record("lda", "lda", 4, 3, log_likelihood=-50),
    record("ward", "agglomerative", 4, 4),
    record("dense", "dbscan", None, 0, (-1.0, 0.0, float("inf")), noise=100),
]
WRONG = [
    ("clusters_hold", record("x", "agglomerative", 4, 3)),
    ("clusters_hold", record("x", "lda", 4, 5, log_likelihood=-50)),
    ("scores_hold", record("x", "agglomerative", 4, 4, (1.4, 10.0, 0.8))),
    ("scores_hold", record("x", "agglomerative", 4, 4, (0.4, 10.0, None))),
    ("scores_hold", record("x", "dbscan", None, 1, noise=5)),
    ("params_hold", record("x", "dbscan", None, 3, noise=101)),
    ("params_hold", record("x", "dbscan", None, 3)),
    ("params_hold", record("x", "fuzzy_cmeans", 4, 4, fpc=0.2, objective=3, iterations=9, multiple_membership=0)),
    ("params_hold", record("x", "lda", 4, 4, log_likelihood=50)),
    ("total_holds", kmeans(4, 150.0, 97.0)),
]
HELD = ["clusters_hold", "scores_hold", "params_hold", "total_holds"]


def held(spark, rows):
    return study_holds(spark.createDataFrame(rows, STUDY), POINTS).collect()


def test_right_records_hold(spark):
    rows = held(spark, RIGHT)
    assert len(rows) == len(RIGHT)
    assert all(r[name] for r in rows for name in HELD)


@pytest.mark.parametrize("name, row", WRONG)
def test_a_wrong_record_does_not(spark, name, row):
    rows = held(spark, [*RIGHT, row])
    assert not all(r[name] for r in rows)
