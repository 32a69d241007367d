"""Requirement tables: numbering, unification and traceability."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxloom.functions.ranking import number_rows
from voxloom.operators.respond import answered
from voxloom.operators.responses import comment_ids, parse_responses

PARTS_PER_BUCKET = 64


def number_requirements(parsed: DataFrame) -> DataFrame:
    """Ids FR001.. and NFR001.. running over all clusters, parts and positions."""
    kind = F.when(F.upper("type") == "FUNCTIONAL", "FR").otherwise("NFR")
    numbered = number_rows(
        parsed.withColumn("_kind", kind),
        ["cluster", "part", "position"],
        {"cluster": F.col("cluster"), "parts": F.floor(F.col("part") / PARTS_PER_BUCKET)},
        within=["_kind"],
        out="_no",
    )
    return numbered.withColumn(
        "requirement_id", F.format_string("%s%03d", "_kind", "_no")
    ).drop("_kind", "_no")


def initial_requirements(responses: DataFrame) -> DataFrame:
    """Requirements of all clusters from the answers ``cluster, part, response``."""
    parsed = parse_responses(answered(responses), ["cluster", "part"])
    return number_requirements(parsed).select(
        "cluster", "requirement_id", "type", "description", "based_on_comments", "nfr_type"
    )


def unified_requirements(responses: DataFrame) -> DataFrame:
    """Requirements from the unification answers ``document, response``.

    ``position`` tells the lines of an answer apart; the ids it prints may repeat.
    """
    parsed = parse_responses(answered(responses), ["document"])
    return parsed.select(
        "document", "position", "requirement_id", "type", "description", "based_on_comments",
        "nfr_type",
    )


def requirement_comments(requirements: DataFrame) -> DataFrame:
    """One row per requirement and comment number it cites."""
    return requirements.select(
        "requirement_id", F.explode(F.array_distinct(comment_ids(F.col("based_on_comments")))).alias("ID")
    )


def _cited(requirements: DataFrame, citations: DataFrame | None) -> DataFrame:
    if citations is None:
        return requirement_comments(requirements)
    return citations.select("requirement_id", "ID").join(
        requirements.select("requirement_id").distinct(), "requirement_id", "left_semi"
    )


def traceability(
    requirements: DataFrame, clustered: DataFrame, citations: DataFrame | None = None
) -> DataFrame:
    """Cited comments with their text and cluster; an unknown number has nulls.

    The column of a unified requirement lists its first comments only; ``citations`` of
    ``consolidate_tables`` has all of them and is read in its place.
    """
    return _cited(requirements, citations).join(
        clustered.select("ID", "Review", "Cluster"), "ID", "left"
    )


def dangling_citations(
    requirements: DataFrame, clustered: DataFrame, citations: DataFrame | None = None
) -> DataFrame:
    """Cited numbers that no clustered review has; ``citations`` as in ``traceability``."""
    return _cited(requirements, citations).join(clustered.select("ID"), "ID", "left_anti")
