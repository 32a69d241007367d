"""From reviews to a unified requirement list."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxloom.checks import require_complete
from voxloom.operators import cleaning, prompts, relevance, reports, requirements, respond
from voxloom.operators.consolidate import consolidate_tables
from voxloom.operators.embed import embed_with, fit_shared_word2vec
from voxloom.operators.scoring import keep_relevant, score_with
from voxloom.plans.choose_k import cluster_reviews
from voxloom.session import stored
from voxloom.sources.writers import run_folder, write_run_tables


def keyed_requirements(initial: DataFrame, answers: DataFrame, **limits: int) -> DataFrame:
    """The rows to merge, each with a ``requirement_no`` of its own.

    Those of an answered document come from its answer, and their number from the
    document and the position in it, as the printed ids may repeat. A document
    whose prompt failed keeps its initial requirements as they are.
    """
    columns = ["type", "description", "based_on_comments", "nfr_type"]
    first = F.shiftleft(F.col("document").cast("bigint"), 32)
    merged = requirements.unified_requirements(answers)
    merged = merged.select((first + F.col("position")).alias("requirement_no"), *columns)
    failed = answers.join(respond.answered(answers).select("document"), "document", "left_anti")
    kept = prompts.requirements_by_document(initial, **limits).join(
        failed.select("document"), "document", "left_semi"
    )
    kept = kept.select((first + F.col("place")).alias("requirement_no"), *columns)
    return merged.unionByName(kept)


def failure_report(
    clustered: DataFrame, answers: DataFrame, unified_answers: DataFrame, initial: DataFrame,
    max_comments: int = 200,
) -> DataFrame:
    """``what, n``: failed prompts, and the comments and requirements they hold."""
    lost = answers.join(respond.answered(answers), ["cluster", "part"], "left_anti")
    uncovered = prompts.comment_parts(clustered, max_comments).join(
        lost.select(F.col("cluster").alias("Cluster"), "part"), ["Cluster", "part"], "left_semi"
    )
    broken = unified_answers.join(respond.answered(unified_answers), "document", "left_anti")
    kept = prompts.requirements_by_document(initial).join(broken, "document", "left_semi")
    counts = {
        "failed_generation_prompts": lost,
        "uncovered_comments": uncovered,
        "failed_unification_prompts": broken,
        "requirements_kept_as_they_were": kept,
    }
    rows = [
        table.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("what"), "n")
        for name, table in counts.items()
    ]
    return reduce(DataFrame.unionByName, rows)


def mine_requirements(
    reviews: DataFrame,
    application: str,
    make_responder: Callable[[], Callable[[str], str]],
    classifier: PipelineModel | Callable[[], Callable[[list[str]], list[float]]],
    make_encoder: Callable[[], Callable[[list[str]], np.ndarray]] | None = None,
    glossary: DataFrame | None = None,
    knowledge: str = "None",
    algorithm: str = "k-means",
    reduction: str = "none",
    k_min: int = 3,
    k_max: int = 10,
    max_comments: int = 200,
    merge_threshold: float = 0.6,
    output: str | None = None,
    **clustering,
) -> dict[str, DataFrame]:
    """Run all stages and return their tables.

    ``classifier`` is a fitted Spark ML model or a caller's scoring function.
    Answers are written to the checkpoint folder before they are parsed, so a
    lost executor never asks the responder again for a parsed answer. The
    unification answers of all documents are merged by ``consolidate_tables``; a
    document without an answer keeps its initial requirements, and
    ``failure_report`` counts what failed.
    """
    clean = cleaning.drop_unusable(reviews)
    if isinstance(classifier, PipelineModel):
        scored = relevance.predict(classifier, clean, glossary, knowledge)
    else:
        scored = score_with(clean, classifier)
    scored = stored(scored)
    relevant = keep_relevant(scored).select("review_id", "Review")
    require_complete(relevant, ["Review"])
    if make_encoder is None:
        embedded = fit_shared_word2vec(relevant).embed(relevant)
    else:
        embedded = embed_with(relevant, make_encoder)
    clustered = stored(
        cluster_reviews(stored(embedded), algorithm, reduction, k_min, k_max, **clustering)
    )
    generation = prompts.generation_prompts(clustered, application, max_comments)
    answers = stored(respond.respond(generation, make_responder))
    initial = stored(requirements.initial_requirements(answers))
    documents = prompts.unification_prompts(initial, application)
    unified_answers = stored(respond.respond(documents, make_responder))
    keyed = stored(keyed_requirements(initial, unified_answers))
    unified, citations = consolidate_tables(keyed, threshold=merge_threshold)
    unified, citations = stored(unified), stored(citations)
    tables = {
        "scored_reviews": scored,
        "clustered_reviews": clustered,
        "answers": answers.unionByName(
            unified_answers.withColumn("cluster", F.lit(None).cast("int")).withColumnRenamed(
                "document", "part"
            )
        ),
        "initial_requirements": initial,
        "unified_requirements": unified,
        "requirement_citations": citations,
        "failure_report": failure_report(
            clustered, answers, unified_answers, initial, max_comments
        ),
        "filtering_report": reports.filtering_report(clean, relevant, "classifier", knowledge),
        "clustering_report": reports.clustering_report(clustered, algorithm, reduction),
        "generation_report": reports.generation_report(initial, unified, "responder", "caller"),
        "summary": reports.run_summary(
            clean, relevant, clustered, initial, unified, application=application,
            algorithm=algorithm, reduction=reduction, knowledge=knowledge,
        ),
    }
    if output:
        names = (
            "clustered_reviews", "initial_requirements", "unified_requirements",
            "requirement_citations",
        )
        write_run_tables(run_folder(output), **{n: tables[n] for n in names})
    return tables
