"""Clustering reads the vectors of the reviews again and again, but not their texts."""

import numpy as np
from voxloom.catalog.learning import _embedded_reviews
from voxloom.operators import many
from voxloom.operators.fuzzy import memberships_of


def test_vectors_are_read_without_the_texts(spark, tmp_path):
    rows = [(i, f"a text {i} of letters", "s") for i in range(40)] + [(None, None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(
        str(tmp_path / "documents.parquet")
    )
    df = _embedded_reviews(spark, str(tmp_path))
    assert df.count() == 40 and df.columns == ["review_id", "Review", "features"]
    plan = df.select("review_id", "features")._jdf.queryExecution().executedPlan().toString()
    assert "Scan parquet" in plan and "Review" not in plan


def test_few_columns_add_up_to_the_same_distances(monkeypatch):
    draw = np.random.default_rng(5)
    for d in (1, 2, 5, 7, 8, 30):
        x, centres = draw.normal(size=(200, d)), draw.normal(size=(6, d))
        want = np.stack([((x - c) ** 2).sum(axis=1) for c in centres], axis=1)
        assert (many.squared_to(x, centres) == want).all()
        u, _ = memberships_of(x, centres, 2.0)
        assert np.allclose(u, (1 / want) / (1 / want).sum(axis=1, keepdims=True))
