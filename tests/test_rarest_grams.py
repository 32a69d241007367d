"""Large glossaries: keys by the rarest sequence, counts as a plain look at every pair."""

import random

import pytest

from voxloom.operators import glossary as G

TERMS = [
    "", "a", "ab", "abc", "the", "the the", "login", "log in", "log", "gin", "ñandú", "日本", "日本語で",
    "🙂", "🙂🙂", "never here", "xyzzy", "login", ".*", "a|b", "\n", None,
]


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(5)
    bits = ["the ", "login", "log in ", "abc", "ñandú", "日本", "語で", "🙂", ".*", "\n", "x", " "]
    texts = ["".join(rng.choices(bits, k=rng.randrange(0, 12))) for _ in range(300)]
    texts += [None, "", "a", "the the " * 5_000]
    df = spark.createDataFrame(list(enumerate(texts)), "review_id long, Review string")
    return df, spark.createDataFrame([(t,) for t in TERMS], "Term string"), texts


def test_counts_equal_a_look_at_every_pair(tables):
    df, terms, texts = tables
    got = {r.review_id: r.rc for r in G.relevant_count(df, terms, method="join").collect()}
    known = [t for t in TERMS if t is not None]
    assert got == {i: sum(t in (x if x is not None else "") for t in known) if x is not None else 0 for i, x in enumerate(texts)}
    array = {r.review_id: r.rc for r in G.relevant_count(df, terms, method="array").collect()}
    assert got == array


def test_keys_are_the_rarest_sequences(tables):
    df, terms, texts = tables
    known = [x for x in texts if x is not None]
    rows = {r.Term: r for r in G.rarest_grams(df, terms.where("Term IS NOT NULL"), "Review").collect()}
    assert "never here" not in rows and "xyzzy" not in rows
    for term, row in rows.items():
        n = min(len(term), G.GRAM)
        grams = {term[i : i + n] for i in range(len(term) - n + 1)}
        held = {g: sum(g in x for x in known) for g in grams}
        assert row["_k"] in grams and row["_n"] == held[row["_k"]] == min(held.values())
    assert rows["login"]["_w"] == 2


def test_no_terms_and_no_texts(tables):
    df, terms, _ = tables
    assert {r.rc for r in G.relevant_count(df, terms.limit(0), method="join").collect()} == {0}
    assert G.relevant_count(df.limit(0), terms, method="join").count() == 0


def test_a_full_filter_changes_nothing(tables, monkeypatch):
    df, terms, _ = tables
    want = {r.review_id: r.rc for r in G.relevant_count(df, terms, method="join").collect()}
    monkeypatch.setattr(G, "BLOOM_BITS", 64)
    assert {r.review_id: r.rc for r in G.relevant_count(df, terms, method="join").collect()} == want
