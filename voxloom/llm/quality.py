"""Quality classifier: text evidence combined with site posteriors by empirical Bayes.

A logistic model of the text, fitted on a bounded sample of the labelled documents, gives
each document a log likelihood ratio. Labelled documents counted by host, and by path
inside a host, give beta posteriors: a path is shrunk towards its host, a host towards the
global rate, with strengths estimated from how much paths and hosts really differ. The log
odds of a document are those of its path plus its own ratio.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import CountVectorizerModel, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxloom.llm.labelled import SAMPLE_ROWS, labelled_sample
from voxloom.llm.rules import features, text_statistics
from voxloom.session import cut_lineage

WORDS = 400
MIN_DOCS = 5
MIN_Z = 4.0
CUTS = 16
STRONGEST = 1e6


def site_columns(docs: DataFrame) -> tuple[Column, Column]:
    """Host and path of a row: from ``url`` if there is one, else source and its language."""
    if "url" in docs.columns:
        path = F.regexp_extract("url", r"^[a-z]+://[^/]+(/[^/?#]*)?", 1)
        return F.parse_url("url", F.lit("HOST")), path
    return F.col("source"), F.col("lang")


def _strength(spread: Column, mean: Column) -> Column:
    """Prior counts of a beta whose mean and variance are these; no variance: many."""
    limit = F.lit(STRONGEST)
    counts = mean * (1 - mean) / spread - 1
    return F.when(spread <= 0, limit).otherwise(F.greatest(F.lit(1.0), F.least(limit, counts)))


def site_posteriors(rows: DataFrame) -> tuple[DataFrame, DataFrame, float]:
    """Posterior rates from ``host, path, y`` (0 or 1): by path, by host, and of all.

    The strength of a prior comes from the spread between groups beyond what chance gives
    groups of their size (moments). Only the strengths and the global rate reach the driver.
    """
    paths = cut_lineage(
        rows.groupBy("host", "path").agg(
            F.sum("y").cast("double").alias("p_good"), F.count(F.lit(1)).alias("p_n")
        )
    )
    hosts = cut_lineage(
        paths.groupBy("host").agg(
            F.sum("p_good").alias("h_good"),
            F.sum("p_n").alias("h_n"),
            F.count(F.lit(1)).alias("h_paths"),
            F.sum(F.pow("p_n", F.lit(2))).alias("h_squares"),
        )
    )
    total = hosts.agg(F.sum("h_good"), F.sum("h_n")).first()
    n = float(total[1] or 0)
    # Half a row of each kind, so no rate is 0 or 1.
    rate = (float(total[0] or 0) + 0.5) / (n + 1)
    mean = F.lit(rate)
    noise = mean * (1 - mean)
    between = hosts.agg(
        (
            (
                F.sum(F.col("h_n") * F.pow(F.col("h_good") / F.col("h_n") - mean, F.lit(2)))
                - (F.count(F.lit(1)) - 1) * noise
            )
            / F.greatest(F.lit(1.0), n - F.sum(F.pow("h_n", F.lit(2))) / max(n, 1.0))
        ).alias("spread")
    ).select(_strength(F.coalesce("spread", F.lit(0.0)), mean))
    host_prior = float(between.first()[0] or STRONGEST)
    host_rate = (F.col("h_good") + rate * host_prior) / (F.col("h_n") + host_prior)
    host_table = hosts.withColumn("host_rate", host_rate)
    same_host = F.col("host").eqNullSafe(F.col("_host"))
    joined = paths.join(host_table.withColumnRenamed("host", "_host"), same_host)
    inside = joined.agg(
        (
            (
                F.sum(
                    F.col("p_n")
                    * F.pow(F.col("p_good") / F.col("p_n") - F.col("h_good") / F.col("h_n"), F.lit(2))
                )
                - (F.count(F.lit(1)) - F.sum(1 / F.col("h_paths"))) * noise
            )
            / F.greatest(
                F.lit(1.0), n - F.sum(F.pow("p_n", F.lit(2)) / F.col("h_n"))
            )
        ).alias("spread")
    ).select(_strength(F.coalesce("spread", F.lit(0.0)), mean))
    path_prior = float(inside.first()[0] or STRONGEST)
    path_rate = (F.col("p_good") + F.col("host_rate") * path_prior) / (F.col("p_n") + path_prior)
    return (
        joined.select("host", "path", path_rate.alias("path_rate")),
        host_table.select("host", "host_rate"),
        rate,
    )


@dataclass
class TextModel:
    """What a fitted text model needs: telling words, cuts of the ratios, one fit a target."""

    words: list[str]
    cuts: dict[str, list[float]]
    fits: dict[str, tuple[LogisticRegressionModel, float]]


def _statistics(docs: DataFrame) -> DataFrame:
    """Counts and ratios of the text, and its distinct lower-cased words as ``_terms``."""
    counted = text_statistics(docs)
    lower = F.lower(F.coalesce(F.col("text"), F.lit("")))
    terms = F.array_distinct(F.array_remove(F.split(lower, r"[^\p{L}\p{N}]+"), ""))
    return counted.withColumns({f"_f_{k}": v for k, v in features().items()}).withColumn(
        "_terms", terms
    )


def telling_words(rows: DataFrame, targets: list[str]) -> list[str]:
    """Words whose share of the documents differs most between the labels, by z-score.

    ``rows`` have ``_terms`` and the targets as 0 or 1. At most ``WORDS`` for each target,
    of those that are in ``MIN_DOCS`` documents and at least ``MIN_Z`` apart.
    """
    found: set[str] = set()
    for target in targets:
        known = rows.where(F.col(target).isNotNull())
        n, good = known.agg(F.count(F.lit(1)), F.coalesce(F.sum(target), F.lit(0.0))).first()
        if not 0 < good < n:
            continue
        counts = (
            known.select(target, F.explode("_terms").alias("word"))
            .groupBy("word")
            .agg(F.count(F.lit(1)).alias("n"), F.sum(target).alias("good"))
            .where(F.col("n") >= MIN_DOCS)
        )
        rate = F.col("n") / float(n)
        gap = F.col("good") / float(good) - (F.col("n") - F.col("good")) / float(n - good)
        spread = F.sqrt(rate * (1 - rate) * (1.0 / good + 1.0 / (n - good)))
        z = F.abs(gap) / F.greatest(spread, F.lit(1e-12))
        best = counts.withColumn("z", z).where(F.col("z") >= MIN_Z)
        found |= {r[0] for r in best.orderBy(F.desc("z"), "word").limit(WORDS).collect()}
    return sorted(found)


def text_vectors(rows: DataFrame, words: list[str], cuts: dict[str, list[float]]) -> DataFrame:
    """``rows`` of ``_statistics`` with ``_vector``: one place for each word and each cut."""
    steps = [
        F.when(F.col(f"_f_{name}") >= F.lit(cut), 1.0).otherwise(0.0)
        for name, some in cuts.items()
        for cut in some
    ]
    rows = rows.withColumn("_steps", array_to_vector(F.array(*steps, F.lit(0.0))))
    if not words:
        return rows.withColumnRenamed("_steps", "_vector")
    counter = CountVectorizerModel.from_vocabulary(
        words, inputCol="_terms", outputCol="_words", minTF=1
    )
    together = VectorAssembler(inputCols=["_steps", "_words"], outputCol="_vector")
    return together.transform(counter.transform(rows))


def fit_text(sample: DataFrame, targets: dict[str, Column]) -> TextModel:
    """A logistic model for each target over telling words and cuts of the ratios.

    A target of which the sample has only one kind gets none.
    """
    rows = _statistics(sample).select(
        "_terms",
        *[f"_f_{k}" for k in features()],
        *[t.cast("double").alias(k) for k, t in targets.items()],
    )
    rows = cut_lineage(rows)
    shares = [i / CUTS for i in range(1, CUTS)]
    found = rows.select(*[F.percentile_approx(f"_f_{k}", shares).alias(k) for k in features()])
    first = found.first()
    cuts = {k: sorted({float(v) for v in first[k] or []}) for k in features()}
    words = telling_words(rows, list(targets))
    vectors = cut_lineage(text_vectors(rows, words, cuts).select("_vector", *targets))
    fits = {}
    for name in targets:
        known = vectors.where(F.col(name).isNotNull())
        n, good = known.agg(F.count(F.lit(1)), F.coalesce(F.sum(name), F.lit(0.0))).first()
        if 0 < good < n:
            fit = LogisticRegression(
                featuresCol="_vector", labelCol=name, regParam=0.002, maxIter=40
            ).fit(known)
            fits[name] = (fit, math.log(good / (n - good)))
    return TextModel(words, cuts, fits)


def score_quality(
    docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS
) -> DataFrame:
    """``doc_id, p_quality, p_toxic, site_quality, site_toxic, kept`` of every row.

    ``p_quality`` is the probability of the label ``quality`` 1, ``p_toxic`` of ``toxic``
    1, and ``kept`` asks for the first and not the second, at a half. The site columns are
    the posteriors of the path alone: the host's if no labelled row has the path, the
    global one if none has the host (a null host or path is a site like others). A null
    text or one without words has no evidence of its own. Without labels all is a half, or
    the global rate. The text models see about ``sample_rows`` labelled documents at
    most, the site rates all of them; a label row without a match counts nowhere.
    """
    host, path = site_columns(docs)
    names = {"quality": "p_quality", "toxic": "p_toxic"}
    sample = labelled_sample(docs.select("doc_id", "text"), labels, sample_rows)
    model = fit_text(sample, {k: F.col(k) == 1 for k in names})
    rows = docs.select("doc_id", "text", host.alias("host"), path.alias("path"))
    vectors = text_vectors(_statistics(rows), model.words, model.cuts)
    for name in names:
        if name in model.fits:
            fit, prior = model.fits[name]
            fit.setRawPredictionCol("_raw").setProbabilityCol("").setPredictionCol("")
            vectors = fit.transform(vectors)
            ratio = vector_to_array("_raw")[1] - F.lit(prior)
            vectors = vectors.withColumn(f"_llr_{name}", ratio).drop("_raw")
        else:
            vectors = vectors.withColumn(f"_llr_{name}", F.lit(0.0))
    evidence = [
        F.when(F.col("n_words") > 0, F.col(f"_llr_{k}")).otherwise(0.0).alias(f"_llr_{k}")
        for k in names
    ]
    scored = cut_lineage(vectors.select("doc_id", "host", "path", *evidence))
    known = labels.select(F.col("doc_id").alias("_id"), *[F.col(k).alias(f"_{k}") for k in names])
    labelled = cut_lineage(
        docs.select("doc_id", host.alias("host"), path.alias("path"))
        .join(known, F.col("doc_id") == F.col("_id"))
        .select("host", "path", *[f"_{k}" for k in names])
    )
    out = scored
    for name, column in names.items():
        rows = labelled.where(F.col(f"_{name}").isNotNull())
        rows = rows.select("host", "path", (F.col(f"_{name}") == 1).cast("int").alias("y"))
        paths, hosts, rate = site_posteriors(rows)
        paths = paths.select(F.col("host").alias("_h"), F.col("path").alias("_p"), "path_rate")
        hosts = hosts.select(F.col("host").alias("_g"), "host_rate")
        out = (
            out.join(
                paths,
                F.col("host").eqNullSafe(F.col("_h")) & F.col("path").eqNullSafe(F.col("_p")),
                "left",
            )
            .join(hosts, F.col("host").eqNullSafe(F.col("_g")), "left")
            .withColumn(f"site_{name}", F.coalesce("path_rate", "host_rate", F.lit(rate)))
            .drop("_h", "_p", "_g", "path_rate", "host_rate")
        )
        site = F.col(f"site_{name}")
        odds = F.ln(site / (1 - site)) + F.col(f"_llr_{name}")
        out = out.withColumn(column, 1 / (1 + F.exp(-odds)))
    kept = (F.col("p_quality") >= 0.5) & (F.col("p_toxic") < 0.5)
    return out.select(
        "doc_id", "p_quality", "p_toxic", "site_quality", "site_toxic", kept.alias("kept")
    )
