"""Glossary vectors of a training table are made once."""

from voxloom.operators import relevance


def test_training_rows_are_written_once(spark, monkeypatch):
    rows = [(i, "uno dos" if i % 2 else "tres", i % 2) for i in range(20)]
    df = spark.createDataFrame(rows, "review_id long, Review string, Relevant int")
    terms = spark.createDataFrame([("dos",)], "Term string")
    kept, stored = [], relevance.stored
    monkeypatch.setattr(relevance, "stored", lambda t: kept.append(t.columns) or stored(t))
    model = relevance.train(df, terms, "RP")
    scores = relevance.predict(model, df, terms, "RP").collect()
    assert all(r["binary_prediction"] == r["Relevant"] for r in scores)
    assert len(kept) == 1 and "knowledge" in kept[0]
