"""The registered learning queries run with the operators' own ranges, grid and restarts."""

import inspect

import pytest
from voxloom.catalog import learning as L
from voxloom.operators import experiments as X

FOLDER = "/root/testdata/sf0.001"


class Seen(Exception):
    pass


def _values(monkeypatch, name, run, spark):
    """The arguments, defaults included, that a query gives an operator."""
    signature = inspect.signature(getattr(L, name))

    def catch(*args, **named):
        bound = signature.bind(*args, **named)
        bound.apply_defaults()
        raise Seen(bound.arguments)

    catch.__signature__ = signature
    monkeypatch.setattr(L, name, catch)
    with pytest.raises(Seen) as caught:
        run(spark, FOLDER)
    return caught.value.args[0]


@pytest.mark.parametrize(
    "operator, query, k_min",
    [
        ("choose_k", "m24_choose_k", 3),
        ("cluster_reviews", "m25_cluster_reviews", 3),
        ("cluster_reviews", "m25_cluster_reviews_fuzzy", 3),
        ("fuzzy_study", "m28_fuzzy_study", 2),
        ("mine_requirements", "m31_mine_requirements", 3),
    ],
)
def test_every_k_is_tried(spark, monkeypatch, operator, query, k_min):
    got = _values(monkeypatch, operator, L.QUERIES[query], spark)
    assert (got["k_min"], got["k_max"]) == (k_min, 10)
    if operator == "fuzzy_study":
        assert got["reductions"] is None and got["components"] is None


@pytest.mark.parametrize(
    "operator, query",
    [
        ("fit_kmeans", "m11_kmeans"),
        ("run_combination", "m26_one_combination"),
        ("run_study", "m27_study"),
    ],
)
def test_ten_restarts(spark, monkeypatch, operator, query):
    assert _values(monkeypatch, operator, L.QUERIES[query], spark)["restarts"] == 10


def test_the_study_runs_the_whole_grid(spark, monkeypatch):
    got = _values(monkeypatch, "run_study", L.QUERIES["m27_study"], spark)
    size = len(got["df"].first()["features"])
    planned = {r["combination_id"] for r in got["combinations"].collect()}
    rows = got["df"].count()
    whole = X.grid(spark, size, rows_for_umap=rows)
    assert planned == {r["combination_id"] for r in whole.collect()}
    assert len(planned) >= 287, len(planned)
