"""Bounds are read from requirements, and a merged one states the strictest."""

import pytest
from pyspark.sql import functions as F

from voxloom.operators.bounds import bounds_of, with_phrases, without_bounds
from voxloom.operators.consolidate import consolidate


@pytest.mark.parametrize(
    "text, want",
    [
        ("Load within 2 s.", [("within 2 s", True, "time", 2000.0)]),
        ("Load in UNDER 1,500 ms", [("UNDER 1,500 ms", True, "time", 1500.0)]),
        ("load in <2,5s", [("<2,5s", True, "time", 2500.0)]),
        ("keep at least 30 days of no more than 5 MB each",
         [("at least 30 days", False, "time", 30 * 86_400_000.0), ("no more than 5 MB", True, "size", 5000.0)]),
        ("up ≥ 99.9 % of the time", [("≥ 99.9 %", False, "share", 99.9)]),
        ("serve more than 500 users", [("more than 500", False, "", 500.0)]),
        ("answer in 2 seconds", []),
        ("not under 5 s", []),
        ("thunder 5 s", []),
        ("under 5x", []),
        ("", []),
        (None, []),
    ],
)
def test_bounds_of(spark, text, want):
    row = spark.createDataFrame([(text,)], "t string").select(bounds_of(F.col("t"))).first()
    assert [tuple(b) for b in row[0]] == want


def test_phrases_go_back_to_their_places(spark):
    rows = [("Open within 3 s and save within 9 s.",), ("Plain.",), (None,)]
    df = spark.createDataFrame(rows, "t string")
    phrases = F.array(F.lit("under 1 s"), F.lit("within 2 s"))
    shown = with_phrases(F.col("t"), F.when(F.size(bounds_of(F.col("t"))) > 0, phrases).otherwise(F.array()))
    assert [r[0] for r in df.select(shown).collect()] == [
        "Open under 1 s and save within 2 s.", "Plain.", None,
    ]
    assert df.select(without_bounds(F.col("t"))).first()[0] == "Open   and save  ."


def merged(spark, descriptions, **options):
    rows = [
        (i, "NON-FUNCTIONAL", d, str(i), "Performance") for i, d in enumerate(descriptions, start=1)
    ]
    columns = (
        "requirement_no bigint, type string, description string, based_on_comments string, nfr_type string"
    )
    out = consolidate(spark.createDataFrame(rows, columns), **options).orderBy("requirement_id").collect()
    return [(r["description"], r["based_on_comments"]) for r in out]


def test_the_stricter_metric_stays_in_both_directions(spark):
    got = merged(
        spark,
        [
            "The page loads within 3 seconds.",
            "The page loads under 1500 ms.",
            "The page loads within 2 s",
            "The log is kept for at least 20 days.",
            "The log is kept for more than 1000 hours",
            "The log is kept for at most 10 days.",
        ],
    )
    assert got == [
        ("The page loads under 1500 ms.", "1, 2, 3"),
        ("The log is kept for more than 1000 hours", "4, 5"),
        ("The log is kept for at most 10 days.", "6"),
    ]


def test_other_numbers_and_kinds_stay_apart(spark):
    texts = [
        "Export version 2 files within 3 s.",
        "Export version 3 files within 2 s.",
        "Export version 2 files within 3 MB.",
        "Export version 2 files within 3 tries.",
    ]
    assert len(merged(spark, texts)) == 4


def test_a_hot_group_of_bounds_is_one_row(spark):
    texts = [f"Search answers within {i % 90 + 10} seconds." for i in range(600)]
    got = merged(spark, texts)
    assert got[0][0] == "Search answers within 10 seconds." and len(got) == 1
