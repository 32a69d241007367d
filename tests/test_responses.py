"""Answers to requirements: formats, order, ids, quality types, validation."""

import pytest

from voxloom.operators import responses as R
from voxloom.operators.requirements import initial_requirements

BOLD = """
Functional Requirements (FR)
**FR021:** The player shall keep the queue after a restart. (Based on comments: 31)
**FR022:** The player shall show lyrics next to a song. (Based on comments: 44, 8,8 , 120)
**FR030:** The player shall cast to a speaker. (Based on comments: 2)

Non-Functional Requirements (NFR)
**NFR007 (Portability):** The player shall run on tablets and watches. (Based on comments: 77, 13)
**NFR009 (Performance):** The player shall start a song within 400 ms. (Based on comments: 90, 16, 41, 3)
"""
PLAIN = """
FR5: The player shall sort albums by year. (Based on comments: 60, 61, 62)
NFR0040 (Security): The player shall lock a child profile. (Based on comments: 19)
"""
FREE = """
What listeners ask of the player system:
- FR: The system shall remember the volume of a headset (Based on comments: 52, 14, 33)
- FR: The system shall skip silence (Based on comments: 70)
- NFR Security: listening history stays hidden (Based on comments: 28)
- Reliability of the offline system downloads must grow
tiny
"""


def parsed(spark, text):
    df = spark.createDataFrame([(1, text)], "id int, response string")
    return [r.asDict() for r in R.parse_responses(df, ["id"]).orderBy("position").collect()]


def test_bold_answer(spark):
    rows = parsed(spark, BOLD)
    assert [r["requirement_id"] for r in rows] == ["FR021", "FR022", "FR030", "NFR007", "NFR009"]
    assert [r["nfr_type"] for r in rows] == [None, None, None, "Portability", "Performance"]
    assert rows[1]["based_on_comments"] == "8, 8, 44, 120"
    assert rows[4]["description"] == "The player shall start a song within 400 ms."


def test_plain_answer(spark):
    rows = parsed(spark, PLAIN)
    assert [r["requirement_id"] for r in rows] == ["FR005", "NFR0040"]
    assert rows[1]["nfr_type"] == "Security"


def test_bold_marks_win_over_plain_ones(spark):
    rows = parsed(spark, PLAIN + "**FR9:** The system shall win. (Based on comments: 1)")
    assert [r["requirement_id"] for r in rows] == ["FR009", "NFR0040"]


def test_untyped_quality_line_is_not_functional(spark):
    rows = parsed(spark, "NFR001: The system shall load fast (Based on comments: 3)")
    assert [(r["type"], r["nfr_type"]) for r in rows] == [("NON_FUNCTIONAL", "Performance")]


def test_line_without_clause_does_not_swallow_the_next(spark):
    rows = parsed(spark, "FR1: nothing cited here FR2: The system shall sort (Based on comments: 8)")
    assert [r["requirement_id"] for r in rows] == ["FR002"]
    assert rows[0]["description"] == "The system shall sort"


def test_free_form_answer_is_read_line_by_line(spark):
    rows = parsed(spark, FREE)
    assert [(r["requirement_id"], r["position"], r["form"]) for r in rows] == [
        ("FR001", 2, "line"),
        ("FR002", 3, "line"),
        ("NFR001", 5, "line"),
    ]
    assert [r["based_on_comments"] for r in rows] == ["14, 33, 52", "70", "Unknown"]
    assert rows[2]["nfr_type"] == "Performance"


def test_empty_answer_gives_a_typed_empty_table(spark):
    df = spark.createDataFrame([(1, 0, "")], "cluster int, part int, response string")
    out = initial_requirements(df.selectExpr("*", "CAST(NULL AS STRING) AS error"))
    assert out.count() == 0
    assert "description" in out.columns


def test_failed_answer_is_not_parsed(spark):
    df = spark.createDataFrame(
        [(1, 0, BOLD, "timeout"), (2, 0, BOLD, None)],
        "cluster int, part int, response string, error string",
    )
    assert {r["cluster"] for r in initial_requirements(df).collect()} == {2}


@pytest.mark.parametrize(
    ("raw", "clean"),
    [
        ("3, 1,2", "1, 2, 3"),
        (" 007  5 ", "5, 7"),
        ("all comments", "all, comments"),
        ("4, x", "4"),
        (",9,", "9"),
        ("1" * 40, "1" * 40),
        ("2, 2", "2, 2"),
    ],
)
def test_comment_lists(spark, raw, clean):
    df = spark.createDataFrame([(raw,)], "c string")
    assert df.select(R.clean_comment_list(df.c)).first()[0] == clean


@pytest.mark.parametrize(
    ("line", "kind"),
    [
        ("NFR (Security): keep it", "Security"),
        ("uptime of the backend", "Performance"),
        ("concurrent users", "Usability"),
        ("more capacity", "Scalability"),
        ("nothing known", "Quality"),
    ],
)
def test_quality_types(spark, line, kind):
    df = spark.createDataFrame([(line,)], "c string")
    assert df.select(R.type_of_line(df.c)).first()[0] == kind
