"""A large glossary held by the tasks: every term a text holds is counted, once for each row of it."""

import pytest
from pyspark.sql import functions as F
from voxloom.operators import glossary as G

TERMS = ["of", "of", "cost", "co", "sting", "a b", " ", "  ", "", "%%", "]", "^-", "é", "日本", "x y z", "b c\n", "of a", None]
TEXTS = [
    "the cost of accosting", "a b c", "a  b", "", " ", None, "日本語のテキスト", "50%% é", "x y z of a", "x yz",
    "b c\nof", "sof tco" + "st" * 40 + "ing", "no", "of a of a", "co[s]t^-]",
]


def _expected(text):
    return 0 if text is None else sum(t in text for t in TERMS if t is not None)


def _rows(spark):
    texts = spark.createDataFrame(list(enumerate(TEXTS)), "review_id long, Review string")
    return texts, spark.createDataFrame([(t,) for t in TERMS], "Term string")


@pytest.mark.parametrize("cached", [2, 1 << 18])
def test_terms_are_counted_without_a_row_for_each_pair(spark, monkeypatch, cached):
    monkeypatch.setattr(G, "CACHED_RUNS", cached)
    texts, terms = _rows(spark)
    counted = G.relevant_count(texts, terms, method="join")
    assert "Join" not in counted._jdf.queryExecution().executedPlan().toString()
    got = {r["review_id"]: r["rc"] for r in counted.collect()}
    assert got == {i: _expected(t) for i, t in enumerate(TEXTS)}
    assert dict(counted.dtypes)["rc"] == "int"


def test_a_larger_glossary_is_joined(spark, monkeypatch):
    monkeypatch.setattr(G, "MAX_HELD_TERMS", 3)
    texts, terms = _rows(spark)
    counted = G.relevant_count(texts, terms, method="join").where(F.col("Review").isNotNull())
    assert {r["review_id"]: r["rc"] for r in counted.collect()} == {
        i: _expected(t) for i, t in enumerate(TEXTS) if t is not None
    }


def test_rows_that_share_a_key_count_as_in_the_join(spark, monkeypatch):
    _, terms = _rows(spark)
    rows = [(1, "cost of"), (1, "cost of"), (2, "sting a b"), (2, "of a"), (2, "sting a b"), (3, "no"), (None, "of cost")]
    texts = spark.createDataFrame([*rows, (4, "of cost"), (5, None), (5, "co")], "review_id long, Review string")
    got = sorted(map(tuple, G.relevant_count(texts, terms, method="join").collect()), key=str)
    monkeypatch.setattr(G, "MAX_HELD_TERMS", 0)
    assert got == sorted(map(tuple, G.relevant_count(texts, terms, method="join").collect()), key=str)
