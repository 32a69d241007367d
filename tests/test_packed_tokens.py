"""Tokens travel packed, and term counts are not stored."""

from voxloom.operators import profile as P


def test_ranked_tokens_are_packed(spark):
    rows = [(3, 1, ["c d", "c d"]), (1, 1, ["a", "b"]), (2, 1, []), (4, 2, [""])]
    df = spark.createDataFrame(rows, "review_id long, Cluster int, tokens array<string>")
    ranked = P.ranked_tokens(df)
    assert "_text" in ranked.columns
    assert {r["review_id"]: r["tokens"] for r in ranked.collect()} == {i: t for i, _, t in rows}
    got = {(r["Cluster"], r["ngram"]): r["n"] for r in P.ngrams(df, 2).collect()}
    assert got == {(1, "a b"): 1, (1, "b c d"): 1, (1, "c d c d"): 1}


def test_term_counts_need_no_stored_table(spark, monkeypatch):
    rows = [(1, 1, ["aa", "bb", "aa"]), (2, 1, ["bb"]), (3, 2, []), (3, 2, ["aa"])]
    df = spark.createDataFrame(rows, "review_id long, Cluster int, tokens array<string>")
    got = sorted((r["review_id"], r["term"], r["_tf"]) for r in P.term_counts(df).collect())
    assert got == [(1, "aa", 2), (1, "bb", 1), (2, "bb", 1), (3, "aa", 1)]
    kept, stored = [], P.stored
    monkeypatch.setattr(P, "stored", lambda t: kept.append(t.columns) or stored(t))
    P.tfidf_terms(df).collect()
    assert not any("_tf" in columns for columns in kept)
