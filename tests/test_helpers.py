"""Numbering, quantiles, components, n-grams and similar pairs against brute force."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxloom import checks
from voxloom.functions.ranking import exact_quantiles, id_bucket, number_rows
from voxloom.functions.text import content_tokens, default_stop_words
from voxloom.operators import consolidate as C
from voxloom.plans.end_to_end import keyed_requirements
from voxloom.operators import profile as P
from voxloom.operators.components import connected_components
from voxloom.operators.scoring import knowledge_kind


def test_number_rows_over_small_buckets(spark):
    rows = [(i * 3, i % 2) for i in range(200)]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "id long, g int")
    out = number_rows(df, ["id"], {"s": id_bucket("id", 7)}, within=["g"]).collect()
    for g in (0, 1):
        ranks = [r["rank"] for r in sorted(out, key=lambda r: r["id"]) if r["g"] == g]
        assert ranks == list(range(1, 101))


def test_quantiles_with_a_hot_value(spark):
    values = [0.5] * 500 + [random.Random(2).random() for _ in range(333)]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    got = exact_quantiles(df, "x", [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]).first()[0]
    assert np.allclose(got, np.quantile(values, [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]))


def test_quantiles_by_group(spark):
    rng = random.Random(3)
    rows = [(g, rng.gauss(g, 1)) for g in range(3) for _ in range(50 + g)]
    df = spark.createDataFrame(rows, "g int, x double")
    for r in exact_quantiles(df, "x", [0.25, 0.75], by=["g"]).collect():
        want = np.quantile([x for g, x in rows if g == r["g"]], [0.25, 0.75])
        assert np.allclose(r["quantiles"], want)


def test_components_of_chain_star_and_pair(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, j) for j in range(101, 130)] + [(7, 7), (300, 200)]
    df = spark.createDataFrame(edges, "src long, dst long")
    got = {r["node"]: r["component"] for r in connected_components(df).collect()}
    assert all(got[i] == 0 for i in range(41))
    assert all(got[j] == 100 for j in range(100, 130))
    assert got[300] == got[200] == 200
    assert len(got) == 41 + 30 + 2


def test_components_without_edges(spark):
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


@pytest.mark.parametrize("n", [2, 3])
def test_ngrams_cross_slices(spark, monkeypatch, n):
    monkeypatch.setattr(P, "SLICE_ROWS", 4)
    rng = random.Random(4)
    texts = [" ".join(rng.choice("ab cd ef".split()) for _ in range(rng.randint(0, 3))) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "review_id long, Review string")
    df = df.withColumn("Cluster", F.lit(1))
    got = {r["ngram"]: r["n"] for r in P.ngrams(P.with_tokens(df), n).collect()}
    words = " ".join(texts).split()
    want = Counter(" ".join(words[i : i + n]) for i in range(len(words) - n + 1))
    assert got == dict(want)


def test_ngrams_within_a_review(spark):
    df = spark.createDataFrame([(1, "aa bb"), (2, "cc dd")], "review_id long, Review string")
    df = P.with_tokens(df.withColumn("Cluster", F.lit(1)))
    got = {r["ngram"] for r in P.ngrams(df, 2, within_review=True).collect()}
    assert got == {"aa bb", "cc dd"}


def test_contractions_and_stop_words(spark):
    df = spark.createDataFrame([("I cannot, gonna! lemme cannotx el perro 3",)], "t string")
    words = df.select(content_tokens(df.t, default_stop_words())).first()[0]
    assert words == ["i", "can", "not", "gon", "na", "lem", "cannotx", "perro"]


@pytest.mark.parametrize("threshold", [0.5, 0.8])
def test_similar_pairs_equal_brute_force(spark, monkeypatch, threshold):
    monkeypatch.setattr(C, "GROUP_ROWS", 5)
    rng = random.Random(5)
    vocabulary = [f"w{chr(97 + i)}" for i in range(12)]
    texts = [" ".join(rng.sample(vocabulary, rng.randint(2, 6))) for _ in range(120)]
    df = spark.createDataFrame(list(enumerate(texts)), "requirement_no long, description string")
    first = {}
    for i, t in enumerate(texts):
        first.setdefault(frozenset(t.split()), i)
    want = set()
    for x, i in first.items():
        for y, j in first.items():
            if i < j and len(x & y) / len(x | y) >= threshold:
                want.add((i, j))
    pairs = [(r["a"], r["b"]) for r in C.similar_pairs(df, threshold=threshold).collect()]
    assert len(pairs) == len(set(pairs))
    assert set(pairs) == want


REQUIREMENT = (
    "requirement_no long, type string, nfr_type string, description string, based_on_comments string"
)


def test_consolidation_merges_within_a_kind(spark):
    rows = [
        (1, "FUNCTIONAL", None, "The player shall keep all playlists offline", "88, 21, 5"),
        (2, "FUNCTIONAL", None, "The player shall keep playlists offline", "40, 21"),
        (3, "NON_FUNCTIONAL", "Usability", "The player shall keep playlists offline", "63"),
        (4, "FUNCTIONAL", None, "Something else entirely", "all comments"),
    ]
    df = spark.createDataFrame(rows, REQUIREMENT)
    got = {r["requirement_id"]: r for r in C.consolidate(df, threshold=0.8).collect()}
    assert set(got) == {"FR001", "FR002", "NFR001"}
    assert got["FR001"]["based_on_comments"] == "5, 21, 40, 88"
    assert got["FR001"]["description"] == "The player shall keep all playlists offline"
    assert got["FR001"]["n_merged"] == 2
    # A group without a number keeps what it says.
    assert got["FR002"]["based_on_comments"] == "all comments"


def test_numbers_and_scripts_are_never_merged_away(spark):
    rows = [
        (1, "FUNCTIONAL", None, "The player shall answer in 2 seconds", "1"),
        (2, "FUNCTIONAL", None, "The player shall answer in 30 seconds", "2"),
        (3, "FUNCTIONAL", None, "Экспорт заметок в файл", "3"),
        (4, "FUNCTIONAL", None, "Экспорт заметок в файл!", "4"),
        (5, "FUNCTIONAL", None, "Поиск по заметкам", "5"),
    ]
    out = C.consolidate(spark.createDataFrame(rows, REQUIREMENT), threshold=0.5).collect()
    assert sorted(r["based_on_comments"] for r in out) == ["1", "2", "3, 4", "5"]


def test_long_citations_stay_one_row_and_a_child_table(spark):
    ids = ", ".join(str(i) for i in range(1, 26))
    df = spark.createDataFrame([(1, "FUNCTIONAL", "", "The player shall do it", ids)], REQUIREMENT)
    unified, citations = C.consolidate_tables(df, listed_ids=10)
    (row,) = unified.collect()
    assert row["based_on_comments"] == "1, 2, 3, 4, 5, 6, 7, 8, 9, 10"
    assert row["n_comments"] == 25
    assert sorted(r["ID"] for r in citations.collect()) == list(range(1, 26))


def test_a_shared_key_is_refused(spark):
    row = (1, "FUNCTIONAL", "", "The player shall do it", "1")
    with pytest.raises(ValueError, match="2 rows"):
        C.consolidate(spark.createDataFrame([row, row], REQUIREMENT))


def test_repeated_ids_and_failed_documents_lose_nothing(spark):
    initial = spark.createDataFrame(
        [(1, "FR001", "FUNCTIONAL", "Keep a queue", "1", None)]
        + [(2, "FR002", "FUNCTIONAL", "Show the lyrics", "2", None)],
        "cluster int, requirement_id string, type string, description string, "
        "based_on_comments string, nfr_type string",
    )
    answer = (
        "**FR001:** The player shall export notes. (Based on comments: 1)\n"
        "**FR001:** The player shall sync calendars nightly. (Based on comments: 2)\n"
    )
    answers = spark.createDataFrame(
        [(0, answer, None), (1, None, "timeout")], "document int, response string, error string"
    )
    keyed = keyed_requirements(initial, answers, max_sections=1)
    out = C.consolidate(keyed).collect()
    assert sorted(r["description"] for r in out) == [
        "Show the lyrics",
        "The player shall export notes.",
        "The player shall sync calendars nightly.",
    ]
    assert all(r["n_merged"] == 1 for r in out)


def test_validators(spark):
    df = spark.createDataFrame([(1, None)], "a int, b string")
    with pytest.raises(ValueError, match="missing"):
        checks.require_columns(df, ["c"])
    with pytest.raises(ValueError, match="null"):
        checks.require_complete(df, ["a", "b"])
    with pytest.raises(ValueError, match="empty"):
        checks.require_complete(df.where("a > 5"), ["a"])
    with pytest.raises(ValueError):
        checks.require_unit_range(0.6, 0.4)
    with pytest.raises(ValueError):
        checks.require_unit_range(-0.1, None)
    with pytest.raises(ValueError):
        checks.require_k_range(1, 5)
    assert knowledge_kind("Relevant Count (RC)") == "RC"
    with pytest.raises(ValueError):
        knowledge_kind("other")
