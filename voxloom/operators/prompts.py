"""Prompt tables: comment blocks per cluster, requirement documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from voxloom.functions.ranking import id_bucket, number_rows
from voxloom.operators.responses import type_of_description

GENERATION_HEAD = """You turn user feedback into software requirements.

Application:
"""
GENERATION_MIDDLE = """

Numbered user comments:
"""
GENERATION_TAIL = """

Write one requirement for each shared problem or wish and name every comment it
rests on. Use a single comment only if it reports a crash, a security flaw or a
broken main function. State one capability or constraint per line, with a number
that can be tested where it is about quality. Answer with these lines only:
**FR001:** The system shall <action>. (Based on comments: <numbers>)
**NFR001 (<Type>):** The system shall <quality>. (Based on comments: <numbers>)
"""
UNIFICATION_HEAD = """You merge requirement lists into one list without repeats.

Application:
"""
UNIFICATION_MIDDLE = """

Requirements by cluster:
"""
UNIFICATION_TAIL = """

Merge requirements of the same kind that ask for the same thing. Keep the
stricter number, unite the comment numbers, keep what has no match as it is, and
number each kind from 001. Answer with these lines only:
**FR001:** <description>. (Based on comments: <numbers>)
**NFR001 (<Type>):** <description>. (Based on comments: <numbers>)
"""


def comment_parts(clustered: DataFrame, max_comments: int = 200) -> DataFrame:
    """``Cluster, ID, Review, part``: the prompt each comment is in."""
    ranked = number_rows(
        clustered.select("Cluster", "ID", "Review"),
        ["ID"],
        {"slice": id_bucket("ID")},
        within=["Cluster"],
        out="_rank",
    )
    part = F.floor((F.col("_rank") - 1) / max_comments).cast("int")
    return ranked.withColumn("part", part).drop("_rank")


def comment_blocks(clustered: DataFrame, max_comments: int = 200) -> DataFrame:
    """One block of lines ``ID. text`` per cluster and part, in ID order.

    A part holds at most ``max_comments`` comments, so a cluster with a third
    of all reviews becomes many prompts and every comment is in one of them.
    """
    line = F.concat(F.col("ID").cast("string"), F.lit(". "), F.col("Review"))
    lines = F.sort_array(F.collect_list(F.struct("ID", line.alias("line"))))
    return (
        comment_parts(clustered, max_comments)
        .groupBy(F.col("Cluster").alias("cluster"), "part")
        .agg(F.array_join(F.transform(lines, lambda x: x["line"]), "\n").alias("comments"))
    )


def generation_prompts(
    clustered: DataFrame, application: str, max_comments: int = 200
) -> DataFrame:
    blocks = comment_blocks(clustered, max_comments)
    prompt = F.concat(
        F.lit(GENERATION_HEAD + application + GENERATION_MIDDLE),
        F.col("comments"),
        F.lit(GENERATION_TAIL),
    )
    return blocks.select("cluster", "part", prompt.alias("prompt"))


def requirement_number(col: str = "requirement_id") -> Column:
    return F.regexp_extract(F.col(col), r"([0-9]+)", 1).cast("bigint")


def _section_lines(requirements: DataFrame, max_lines: int) -> DataFrame:
    """``cluster, part, _rank, _line, _row``: every requirement in its section."""
    quality = F.upper("type") != "FUNCTIONAL"
    known = F.col("nfr_type") if "nfr_type" in requirements.columns else F.lit(None).cast("string")
    nfr_type = F.coalesce(known, type_of_description(F.col("description")))
    label = F.when(quality, F.concat(F.lit(" ("), nfr_type, F.lit(")"))).otherwise("")
    line = F.concat(
        F.lit("**"), F.col("requirement_id"), label, F.lit(":** "), F.col("description"),
        F.lit(" (Based on comments: "), F.col("based_on_comments"), F.lit(")\n"),
    )
    rows = requirements.select(
        "cluster", quality.cast("int").alias("_kind"), requirement_number().alias("_no"),
        line.alias("_line"), F.struct(*requirements.columns).alias("_row"),
    )
    ranked = number_rows(
        rows,
        ["_kind", "_no"],
        {"kind": F.col("_kind"), "slice": id_bucket("_no")},
        within=["cluster"],
        out="_rank",
    )
    return ranked.withColumn("part", F.floor((F.col("_rank") - 1) / max_lines).cast("int"))


def requirement_sections(requirements: DataFrame, max_lines: int = 500) -> DataFrame:
    """One section per cluster and part: a heading, FR lines, then NFR lines."""
    lines = F.transform(
        F.sort_array(F.collect_list(F.struct("_rank", "_line"))), lambda x: x["_line"]
    )
    heading = F.concat(F.lit("## CLUSTER "), F.col("cluster").cast("string"), F.lit(" ##\n"))
    return (
        _section_lines(requirements, max_lines)
        .groupBy("cluster", "part")
        .agg(F.array_join(lines, "").alias("_body"))
        .select("cluster", "part", F.concat(heading, "_body").alias("section"))
    )


def _in_documents(sections: DataFrame, max_sections: int) -> DataFrame:
    """``sections`` in cluster order with their ``document``."""
    ranked = number_rows(
        sections,
        ["cluster", "part"],
        {"cluster": F.col("cluster"), "parts": F.floor(F.col("part") / 4096)},
        out="_rank",
    )
    return ranked.withColumn("document", F.floor((F.col("_rank") - 1) / max_sections).cast("int"))


def requirements_by_document(
    requirements: DataFrame, max_lines: int = 500, max_sections: int = 50
) -> DataFrame:
    """The requirements with the ``document`` of ``unification_documents`` they are in.

    ``place`` numbers the rows of a document, of which there are at most
    ``max_lines * max_sections``.
    """
    lines = _section_lines(requirements, max_lines).select("cluster", "part", "_rank", "_row")
    sections = _in_documents(lines.select("cluster", "part").distinct(), max_sections)
    order = W.partitionBy("document").orderBy("cluster", "part", "_rank")
    return (
        lines.join(sections.select("cluster", "part", "document"), ["cluster", "part"])
        .withColumn("place", F.row_number().over(order))
        .select("_row.*", "document", "place")
    )


def unification_documents(
    requirements: DataFrame, max_lines: int = 500, max_sections: int = 50
) -> DataFrame:
    """Sections in cluster order, joined to documents of bounded length.

    A run with few clusters gives one document. A large one gives several; the
    answers are then merged across documents by ``consolidate``.
    """
    ranked = _in_documents(requirement_sections(requirements, max_lines), max_sections)
    texts = F.transform(
        F.sort_array(F.collect_list(F.struct("_rank", "section"))), lambda x: x["section"]
    )
    return (
        ranked.groupBy("document")
        .agg(F.array_join(texts, "\n").alias("requirements"))
    )


def unification_prompts(requirements: DataFrame, application: str, **limits: int) -> DataFrame:
    prompt = F.concat(
        F.lit(UNIFICATION_HEAD + application + UNIFICATION_MIDDLE),
        F.col("requirements"),
        F.lit(UNIFICATION_TAIL),
    )
    documents = unification_documents(requirements, **limits)
    return documents.select("document", prompt.alias("prompt"))
