"""Scoring models, embeddings, reduction, clustering, quality, studies."""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from voxloom.catalog import inputs as I
from voxloom.catalog.experiments import grid_sql
from voxloom.catalog.texts import STOP_WORDS, tokens_sql
from voxloom.functions.vectors import l2_norm, mean_by
from voxloom.operators import experiments as X
from voxloom.operators import fuzzy, quality, relevance
from voxloom.operators.cleaning import numbered_clusters
from voxloom.operators.dbscan import dbscan, dbscan_summary
from voxloom.operators.embed import embed_with, fit_shared_word2vec
from voxloom.operators.kmeans import fit_kmeans
from voxloom.operators.neighbours import (
    directed_weights,
    fuzzy_graph,
    nearest_neighbours,
    neighbour_search,
    visited_share,
)
from voxloom.operators.prompts import (
    GENERATION_HEAD,
    GENERATION_MIDDLE,
    GENERATION_TAIL,
    UNIFICATION_HEAD,
    UNIFICATION_MIDDLE,
    UNIFICATION_TAIL,
    generation_prompts,
)
from voxloom.operators.reduce import pca, spectral_layout
from voxloom.operators.respond import respond
from voxloom.operators.scoring import score_with
from voxloom.operators.topics import as_counts, fit_topics
from voxloom.operators.ward import ward
from voxloom.operators.word_vectors import (
    cooccurrences,
    embed_with_word_vectors,
    fit_word_vectors,
)
from voxloom.plans.choose_k import choose_k, cluster_reviews
from voxloom.plans.end_to_end import mine_requirements
from voxloom.plans.study import fuzzy_study, run_combination, run_study
from voxloom.session import cut_lineage, spread, stored

QUERIES: dict = {}
SQL: dict = {}


def query(name: str, sql: str | None = None):
    def add(run):
        QUERIES[name] = run
        if sql is not None:
            SQL[name] = sql
        return run

    return add


def length_model():
    """A fixed scorer for exact checks: a function of the text length."""
    return lambda texts: [(len(t) % 101) / 100.0 for t in texts]


def letter_encoder():
    """A fixed encoder for exact checks: counts of six letters, plus one."""
    return lambda texts: np.array([[t.count(c) + 1.0 for c in "aeinrt"] for t in texts])


def echo_responder():
    """A fixed responder: one requirement per prompt, from its length."""

    def answer(prompt: str) -> str:
        n = len(prompt)
        if n % 7 == 0:
            raise RuntimeError("no answer")
        return (
            f"**FR001:** The system shall handle topic {n % 5} of the feedback. (Based on comments: 1, {n % 9 + 2})\n"
            f"**NFR001 (Performance):** The system shall answer in {n % 3 + 1} seconds. (Based on comments: {n % 4 + 1})"
        )

    return answer


# What the reading responder asks for, by the first letter of a comment.
WISHES = [
    "The notebook shall export every page as a file",
    "Calendars shall synchronise with other devices overnight",
    "Opening a notebook shall take at most {0} seconds",
    "Users shall restore deleted entries from a bin",
    "Reminders shall repeat until somebody dismisses them",
]


def reading_responder():
    """A fixed responder that answers from its prompt: each comment is behind one requirement.

    The first letter of a comment picks the wish and the seconds it asks for; a list of
    requirements comes back as it is, so merging is left to the consolidation.
    """
    mark = re.compile(r"(?m)^([0-9]+)\. ((?s:.))")

    def answer(prompt: str) -> str:
        if prompt.startswith(UNIFICATION_HEAD):
            listed = prompt.split(UNIFICATION_MIDDLE)[1].removesuffix(UNIFICATION_TAIL)
            return "\n".join(line for line in listed.split("\n") if line.startswith("**"))
        comments = prompt.split(GENERATION_MIDDLE)[1].removesuffix(GENERATION_TAIL)
        asked: dict[int, list[tuple[str, int]]] = {}
        for number, letter in mark.findall(comments):
            asked.setdefault(ord(letter) % len(WISHES), []).append((number, ord(letter) % 7 + 1))
        lines = []
        for i, (wish, said) in enumerate(sorted(asked.items()), start=1):
            kind = f"NFR{i:03d} (Performance)" if wish == 2 else f"FR{i:03d}"
            text = WISHES[wish].format(min(seconds for _, seconds in said))
            lines.append(f"**{kind}:** {text}. (Based on comments: {', '.join(n for n, _ in said)})")
        return "\n".join(lines)

    return answer


@query(
    "m1_score_with_model",
    f"WITH {I.REVIEWS} SELECT review_id, (length(Review) % 101) / 100.0::DOUBLE AS prediction_score,"
    " CAST((length(Review) % 101) / 100.0::DOUBLE > 0.5 AS INTEGER) AS binary_prediction FROM reviews",
)
def m1(spark, folder):
    return score_with(I.reviews(spark, folder), length_model).drop("Review")


def _fitted_scores(spark, folder, knowledge, mlp=False):
    labelled = I.labelled(spark, folder)
    glossary = I.glossary(spark, folder)
    model = relevance.train(labelled, glossary, knowledge, mlp)
    return I.rounded(
        relevance.predict(model, I.reviews(spark, folder), glossary, knowledge).drop("Review"),
        "prediction_score",
    )


@query("m2_classifier")
def m2(spark, folder):
    return _fitted_scores(spark, folder, "None")


@query("m2_classifier_with_counts")
def m2_rc(spark, folder):
    return _fitted_scores(spark, folder, "RC")


@query("m2_classifier_with_positions")
def m2_rp(spark, folder):
    return _fitted_scores(spark, folder, "RP")


@query("m3_mlp_classifier")
def m3(spark, folder):
    return _fitted_scores(spark, folder, "None", mlp=True)


@query(
    "m4_fold_sizes",
    f"WITH {I.LABELLED} SELECT CAST(f AS INTEGER) AS fold, (n - f + 4) // 5 AS n FROM"
    " (SELECT count(*) AS n FROM labelled), (SELECT unnest(range(5)) AS f)",
)
def m4(spark, folder):
    folds = relevance.with_folds(I.labelled(spark, folder), 5)
    return folds.groupBy("fold").agg(F.count(F.lit(1)).alias("n"))


@query("m5_cross_validation")
def m5(spark, folder):
    return relevance.cross_validate(I.labelled(spark, folder), 5)


_CONFUSION = """c AS (SELECT {by} count(*) FILTER (quality = 1 AND toxic = 1) AS tp,
  count(*) FILTER (quality = 0 AND toxic = 1) AS fp, count(*) FILTER (quality = 0 AND toxic = 0) AS tn,
  count(*) FILTER (quality = 1 AND toxic = 0) AS fn FROM labels {group})"""
_METRICS = """round((tp + tn)::DOUBLE / nullif(tp + fp + tn + fn, 0), 6) AS accuracy,
  round(tp::DOUBLE / nullif(tp + fp, 0), 6) AS precision,
  round(tp::DOUBLE / nullif(tp + fn, 0), 6) AS recall,
  round(2 * tp::DOUBLE / nullif(2 * tp + fp + fn, 0), 6) AS f1"""
_METRIC_NAMES = ("accuracy", "precision", "recall", "f1")


@query(
    "a15_classification_metrics",
    f"WITH {_CONFUSION.format(by='', group='')} SELECT tp, fp, tn, fn, {_METRICS} FROM c",
)
def a15(spark, folder):
    counts = relevance.confusion(I.table(spark, folder, "labels"), "quality", "toxic")
    return I.rounded(relevance.classification_metrics(counts), *_METRIC_NAMES)


@query(
    "a14_average_metrics",
    f"""WITH {_CONFUSION.format(by='doc_id % 5 AS fold,', group='GROUP BY doc_id % 5')},
  m AS (SELECT (tp + tn)::DOUBLE / (tp + fp + tn + fn) AS accuracy,
    tp::DOUBLE / nullif(tp + fp, 0) AS precision, tp::DOUBLE / nullif(tp + fn, 0) AS recall,
    2 * tp::DOUBLE / nullif(2 * tp + fp + fn, 0) AS f1 FROM c)
SELECT {', '.join(f'round(avg({n}), 6) AS {n}' for n in _METRIC_NAMES)} FROM m""",
)
def a14(spark, folder):
    labels = I.table(spark, folder, "labels").withColumn("fold", F.col("doc_id") % 5)
    counts = relevance.confusion(labels, "quality", "toxic", by=["fold"])
    metrics = relevance.average_metrics(relevance.classification_metrics(counts))
    return I.rounded(metrics, *_METRIC_NAMES)


@query(
    "d11_stratified_split",
    f"""WITH {I.LABELLED}, s AS (SELECT Relevant, count(*) AS n FROM labelled GROUP BY Relevant)
SELECT Relevant, true AS train, CAST(round(n * 0.7::DOUBLE) AS BIGINT) AS n FROM s
UNION ALL SELECT Relevant, false, n - CAST(round(n * 0.7::DOUBLE) AS BIGINT) FROM s""",
)
def d11(spark, folder):
    split = relevance.stratified_split(I.labelled(spark, folder))
    return split.groupBy("Relevant", "train").agg(F.count(F.lit(1)).alias("n"))


@query("d11_balanced_sample")
def d11_balanced(spark, folder):
    return relevance.balanced_sample(I.labelled(spark, folder)).select("review_id", "Relevant")


_LETTERS = ", ".join(
    f"length(Review) - length(replace(Review, '{c}', '')) + 1.0::DOUBLE" for c in "aeinrt"
)


@query(
    "m6_embed_with_encoder",
    f"""WITH {I.REVIEWS}, v AS (SELECT review_id, [{_LETTERS}] AS v FROM reviews),
  n AS (SELECT review_id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS n FROM v)
SELECT review_id, {', '.join(f'round(v[{i + 1}] / n, 6) AS e{i}' for i in range(6))} FROM n""",
)
def m6(spark, folder):
    df = embed_with(spread(I.reviews(spark, folder), "review_id"), letter_encoder)
    return df.select(
        "review_id", *[F.round(F.col("features")[i], 6).alias(f"e{i}") for i in range(6)]
    )


@query(
    "m6_word2vec_norms",
    f"WITH {I.REVIEWS} SELECT review_id, CAST(32 AS INTEGER) AS dimension, CASE WHEN regexp_matches("
    "lower(Review), '[a-záéíóúñü]') THEN 1.0::DOUBLE ELSE 0 END AS norm FROM reviews",
)
def m6_w2v(spark, folder):
    reviews = I.reviews(spark, folder)
    df = fit_shared_word2vec(reviews, size=32).embed(reviews)
    return df.select(
        "review_id",
        F.size("features").alias("dimension"),
        F.round(l2_norm(F.col("features")), 6).alias("norm"),
    )


_NEAR = ", ".join(f"lead(w, {i}) OVER (PARTITION BY review_id ORDER BY p)" for i in range(1, 6))


@query(
    "m6_cooccurrences",
    f"""WITH {I.REVIEWS}, {tokens_sql()},
  flat AS (SELECT review_id, unnest(tokens) AS w, generate_subscripts(tokens, 1) AS p FROM tok),
  near AS (SELECT w, unnest([{_NEAR}]) AS o FROM flat),
  both_ways AS (SELECT w AS word, o AS context FROM near UNION ALL SELECT o, w FROM near)
SELECT word, count(*) AS contexts, CAST(sum(n) AS BIGINT) AS near, CAST(sum(n * n) AS BIGINT) AS squares,
  min(context) AS first, max(context) AS last
FROM (SELECT word, context, count(*) AS n FROM both_ways
  WHERE word IS NOT NULL AND context IS NOT NULL GROUP BY ALL) GROUP BY word""",
)
def m6_counts(spark, folder):
    """The counts of all pairs, a row for each word."""
    pairs = cooccurrences(spread(I.reviews(spark, folder), "review_id"), stop_words=STOP_WORDS)
    n = F.col("n")
    return pairs.groupBy("word").agg(
        F.count(F.lit(1)).alias("contexts"), F.sum(n).alias("near"), F.sum(n * n).alias("squares"),
        F.min("context").alias("first"), F.max("context").alias("last"),
    )


@query(
    "m6_word_vectors",
    f"""WITH {I.REVIEWS}, {tokens_sql()}
SELECT review_id, CAST(64 AS INTEGER) AS dimension, true AS unit_or_zero FROM tok""",
)
def m6_vectors(spark, folder):
    reviews = spread(I.reviews(spark, folder), "review_id")
    vectors = fit_word_vectors(reviews, stop_words=STOP_WORDS)
    df = embed_with_word_vectors(reviews, vectors, stop_words=STOP_WORDS)
    norm = l2_norm(F.col("features"))
    return df.select(
        "review_id",
        F.size("features").alias("dimension"),
        ((norm == 0) | (F.abs(norm - 1) < 1e-9)).alias("unit_or_zero"),
    )


@query("m7_pca")
def m7(spark, folder):
    scores, share = pca(I.embeddings(spark, folder), 10)
    return scores.select(
        "review_id", F.round(F.lit(share), 6).alias("explained"), F.size("reduced").alias("dimension")
    )


@query(
    "m7_pca_variance",
    f"""WITH {I.EMBEDDINGS}, flat AS (SELECT unnest(features) AS x, generate_subscripts(features, 1) AS i
  FROM emb) SELECT round(sum(v), 6) AS total_variance, 1.0::DOUBLE AS explained FROM
  (SELECT var_samp(x) AS v FROM flat GROUP BY i)""",
)
def m7_variance(spark, folder):
    """All 64 components together keep the whole variance."""
    scores, share = pca(I.embeddings(spark, folder), 64)
    spread = scores.select(F.posexplode("reduced").alias("i", "x")).groupBy("i").agg(
        F.var_samp("x").alias("v")
    )
    return spread.agg(F.round(F.sum("v"), 6).alias("total_variance")).withColumn(
        "explained", F.round(F.lit(share), 6)
    )


_DIST = "sqrt(list_sum(list_transform(list_zip(x.features, y.features), lambda p: (p[1] - p[2]) * (p[1] - p[2]))))"
_PAIRWISE = f"d AS (SELECT x.review_id AS key, x.label AS own, y.review_id AS neighbour, y.label AS label, {_DIST} AS distance FROM emb x, emb y WHERE x.review_id <> y.review_id)"


@query(
    "m8_nearest_neighbours",
    f"""WITH {I.EMBEDDINGS}, {_PAIRWISE} SELECT key, neighbour, round(distance, 6) AS distance,
  CAST(place AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY key
  ORDER BY distance, neighbour) AS place FROM d) WHERE place <= 15""",
)
def m8(spark, folder):
    return I.rounded(nearest_neighbours(I.embeddings(spark, folder), 15), "distance")


@query("m8_visited_share")
def m8_share(spark, folder):
    return visited_share(neighbour_search(I.embeddings(spark, folder), 15)[1])


@query(
    "m9_neighbour_weights",
    f"WITH {I.EMBEDDINGS} SELECT review_id AS src, round(log2(15), 3) AS total, 14::BIGINT AS n FROM emb",
)
def m9(spark, folder):
    weights = directed_weights(nearest_neighbours(I.embeddings(spark, folder), 14), 15)
    return weights.groupBy("src").agg(
        F.round(F.sum("weight"), 3).alias("total"), F.count(F.lit(1)).alias("n")
    )


@query("m9_fuzzy_graph")
def m9_graph(spark, folder):
    return I.rounded(fuzzy_graph(nearest_neighbours(I.embeddings(spark, folder), 14), 15), "weight")


@query("m10_spectral_layout")
def m10(spark, folder):
    graph = fuzzy_graph(nearest_neighbours(I.embeddings(spark, folder), 14), 15)
    return spectral_layout(graph, 2)


@query("m11_kmeans")
def m11(spark, folder):
    points = I.embeddings(spark, folder)
    fit = fit_kmeans(points, 10, restarts=10)
    return fit.assign(points).select(
        "review_id", F.col("label").alias("cluster"), F.round(F.lit(fit.inertia), 4).alias("inertia")
    )


def _centres(spark, folder):
    rows = mean_by(I.embeddings(spark, folder), ["label"], "features").orderBy("label").collect()
    return np.array([r["centroid"] for r in rows])


_CENTRES = """flat AS (SELECT review_id, label, unnest(features) AS x, generate_subscripts(features, 1) AS i
    FROM emb),
  centres AS (SELECT label AS c, i, avg(x) AS m FROM flat GROUP BY ALL),
  cd AS (SELECT review_id, c, greatest(sum((x - m) * (x - m)), 1e-300) AS d2 FROM flat JOIN centres USING (i)
    GROUP BY ALL),
  u AS (SELECT review_id, c, (1 / d2) / sum(1 / d2) OVER (PARTITION BY review_id) AS u FROM cd)"""


@query(
    "m12_memberships",
    f"WITH {I.EMBEDDINGS}, {_CENTRES} SELECT review_id, CAST(c AS INTEGER) AS cluster, round(u, 6) AS u FROM u",
)
def m12_u(spark, folder):
    fit = fuzzy.FuzzyFit(_centres(spark, folder), 2.0, 0, 0.0, 0.0)
    df = fit.memberships(I.embeddings(spark, folder))
    return df.select("review_id", F.posexplode("membership").alias("cluster", "u")).withColumn(
        "u", F.round("u", 6)
    )


@query(
    "m12_one_step",
    f"""WITH {I.EMBEDDINGS}, {_CENTRES}, n AS (SELECT c, i, sum(u * u * x) / sum(u * u) AS m FROM u
  JOIN flat USING (review_id) GROUP BY ALL)
SELECT CAST(c AS INTEGER) AS cluster, round(max(m) FILTER (i = 1), 6) AS first,
  round(max(m) FILTER (i = 64), 6) AS last, round((SELECT sum(u * u) / count(DISTINCT review_id) FROM u), 6)
  AS fpc, round((SELECT sum(u * u * d2) FROM u JOIN cd USING (review_id, c)), 4) AS objective
FROM n GROUP BY c""",
)
def m12_step(spark, folder):
    points = I.embeddings(spark, folder)
    centres, state = fuzzy.one_step(points, _centres(spark, folder), None, 2.0)
    rows = [(i, float(c[0]), float(c[-1])) for i, c in enumerate(centres)]
    df = spark.createDataFrame(rows, "cluster int, first double, last double")
    df = df.withColumn("fpc", F.round(F.lit(float(state["fpc"])), 6))
    df = df.withColumn("objective", F.round(F.lit(float(state["objective"])), 4))
    return I.rounded(df, "first", "last")


@query("m12_fuzzy_cmeans")
def m12(spark, folder):
    scores = cut_lineage(pca(I.embeddings(spark, folder), 2)[0])
    fit = fuzzy.fit_fuzzy(scores, 5, features="reduced")
    df = fit.memberships(scores, "reduced")
    return df.select(
        "review_id",
        F.size("membership").alias("k"),
        F.round(F.aggregate("membership", F.lit(0.0), lambda s, v: s + v), 6).alias("total"),
        F.lit(fit.fpc >= 1 / 5).alias("fpc_in_range"),
    )


# Memberships spread wide enough for the threshold: powers of inverse distance.
_WIDE = f"""{I.EMBEDDINGS}, {_CENTRES},
  wide AS (SELECT review_id, c, pow(1 / d2, 12) / sum(pow(1 / d2, 12)) OVER (PARTITION BY review_id) AS u FROM cd),
  lists AS (SELECT review_id, list(u ORDER BY c) AS u FROM wide GROUP BY review_id),
  picked AS (SELECT review_id, u, CASE WHEN list_max(u) >= 0.3 THEN list_filter(range(0, len(u)),
    lambda i: u[i + 1] >= 0.3) ELSE [list_position(u, list_max(u)) - 1] END AS a FROM lists)"""


def _wide(spark, folder):
    fit = fuzzy.FuzzyFit(_centres(spark, folder), 1 + 1 / 12, 0, 0.0, 0.0)
    df = fit.memberships(I.embeddings(spark, folder))
    return fuzzy.with_assignments(df, threshold=0.3)


@query(
    "m13_threshold_assignments",
    f"WITH {_WIDE} SELECT review_id, array_to_string(a, ',') AS assignments FROM picked",
)
def m13(spark, folder):
    return _wide(spark, folder).select(
        "review_id", F.array_join(F.col("assignments").cast("array<string>"), ",").alias("assignments")
    )


@query(
    "m14_expanded_points",
    f"WITH {_WIDE} SELECT review_id, CAST(unnest(a) AS INTEGER) AS cluster FROM picked",
)
def m14(spark, folder):
    return fuzzy.expand_assignments(_wide(spark, folder), "cluster").select("review_id", "cluster")


@query(
    "m15_hard_labels",
    f"WITH {_WIDE} SELECT review_id, CAST(list_position(u, list_max(u)) - 1 AS INTEGER) AS argmax_label,"
    " CAST(a[1] AS INTEGER) AS first_label FROM picked",
)
def m15(spark, folder):
    return fuzzy.hard_labels(_wide(spark, folder)).select("review_id", "argmax_label", "first_label")


@query(
    "m16_multiple_memberships",
    f"WITH {_WIDE} SELECT count(*) FILTER (len(a) > 1) AS multiple_membership_count FROM picked",
)
def m16(spark, folder):
    return fuzzy.multiple_memberships(_wide(spark, folder))


@query(
    "s10_detailed_rows",
    f"""WITH {_WIDE}, {I.REVIEWS} SELECT p.review_id AS original_index, r.Review AS review,
  CAST(c AS INTEGER) AS assigned_cluster, round(u[c + 1], 6) AS membership_score,
  round(list_max(u), 6) AS max_membership, CAST(len(a) AS INTEGER) AS n_clusters_assigned
  FROM (SELECT *, unnest(a) AS c FROM picked) p JOIN reviews r USING (review_id)""",
)
def s10(spark, folder):
    member = _wide(spark, folder).join(I.reviews(spark, folder), "review_id")
    path = I.scratch(spark, "details")
    fuzzy.detailed_rows(member).write.parquet(path)
    return I.rounded(spark.read.parquet(path), "membership_score", "max_membership")


@query("m17_ward")
def m17(spark, folder):
    return ward(I.embeddings(spark, folder), 10)


_EPS = 1.17
_DENSITY = f"""{I.EMBEDDINGS}, {_PAIRWISE.replace(' WHERE x.review_id <> y.review_id', '')},
  core AS (SELECT key FROM d WHERE distance <= {_EPS} GROUP BY key HAVING count(*) >= 5),
  e AS (SELECT key AS a, neighbour AS b FROM d WHERE distance <= {_EPS} AND key IN (SELECT key FROM core)
    AND neighbour IN (SELECT key FROM core)),
  reach(node, root) AS (SELECT key, key FROM core UNION SELECT e.b, r.root FROM reach r JOIN e ON e.a = r.node
    WHERE e.b > r.root),
  comp AS (SELECT node, min(root) AS root FROM reach GROUP BY node),
  border AS (SELECT d.key AS node, min(c.root) AS root FROM d JOIN comp c ON c.node = d.neighbour
    WHERE distance <= {_EPS} AND d.key NOT IN (SELECT key FROM core) GROUP BY d.key),
  roots AS (SELECT root, row_number() OVER (ORDER BY root) - 1 AS no FROM (SELECT DISTINCT root FROM comp)),
  labels AS (SELECT emb.review_id, CAST(coalesce(no, -1) AS INTEGER) AS label,
    emb.review_id IN (SELECT key FROM core) AS is_core FROM emb LEFT JOIN
    (SELECT * FROM comp UNION ALL SELECT * FROM border) x ON x.node = emb.review_id
    LEFT JOIN roots USING (root))"""


@query("m18_dbscan", f"WITH RECURSIVE {_DENSITY} SELECT review_id, label, is_core FROM labels")
def m18(spark, folder):
    return dbscan(I.embeddings(spark, folder), _EPS, 5)


@query(
    "m18_dbscan_summary",
    f"WITH RECURSIVE {_DENSITY} SELECT count(DISTINCT label) FILTER (label >= 0) AS n_clusters_found,"
    " count(*) FILTER (label = -1) AS n_noise_points, count(*) FILTER (is_core) AS n_core_points FROM labels",
)
def m18_summary(spark, folder):
    return dbscan_summary(dbscan(I.embeddings(spark, folder), _EPS, 5))


@query(
    "t12_vectors_as_counts",
    f"""WITH {I.EMBEDDINGS}, low AS (SELECT least(min(list_min(features)), 0) AS m FROM emb)
SELECT review_id, list_sum(list_transform(features, lambda v: greatest(CAST(trunc((v - m + 1e-10::DOUBLE)
  * 1000.0::DOUBLE) AS BIGINT), 1)))::BIGINT AS total FROM emb, low""",
)
def t12(spark, folder):
    df = as_counts(I.embeddings(spark, folder))
    return df.select(
        "review_id", F.aggregate("counts", F.lit(0).cast("bigint"), lambda s, v: s + v).alias("total")
    )


@query("m19_topics")
def m19(spark, folder):
    fit = fit_topics(I.embeddings(spark, folder).drop("label"), 5)
    return fit.labels.select(
        "review_id", "label", F.lit(fit.perplexity > 0).alias("has_perplexity")
    )


_SILHOUETTE = f"""{_PAIRWISE}, m AS (SELECT key, own, label, avg(distance) AS v FROM d GROUP BY ALL),
  ab AS (SELECT key, max(v) FILTER (label = own) AS a, min(v) FILTER (label <> own) AS b FROM m GROUP BY key),
  s AS (SELECT key, CASE WHEN a IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END AS s FROM ab)"""


@query(
    "m20_silhouette_samples",
    f"WITH {I.EMBEDDINGS}, {_SILHOUETTE} SELECT key AS review_id, round(s, 6) AS silhouette FROM s",
)
def m20_samples(spark, folder):
    return I.rounded(quality.silhouette_samples(I.embeddings(spark, folder)), "silhouette")


@query(
    "m20_silhouette",
    f"WITH {I.EMBEDDINGS}, {_SILHOUETTE} SELECT round(avg(s), 6) AS silhouette_score FROM s",
)
def m20(spark, folder):
    return I.rounded(quality.silhouette(I.embeddings(spark, folder)), "silhouette_score")


@query(
    "m20_silhouette_squared",
    f"""WITH {I.EMBEDDINGS}, {_PAIRWISE.replace('AS distance', '^ 2 AS distance')}, m AS (SELECT key, own,
  label, sum(distance) AS t, count(*) AS n FROM d GROUP BY ALL),
  ab AS (SELECT key, max(t / n) FILTER (label = own) AS a, min(t / n) FILTER (label <> own) AS b FROM m GROUP BY key)
SELECT round(avg((b - a) / greatest(a, b)), 6) AS silhouette_score FROM ab""",
)
def m20_squared(spark, folder):
    score = quality.silhouette_squared(I.embeddings(spark, folder))
    return I.embeddings(spark, folder).agg(
        F.round(F.max(F.lit(score)), 6).alias("silhouette_score")
    )


_SPREAD = """flat AS (SELECT review_id, label, unnest(features) AS x, generate_subscripts(features, 1) AS i FROM {0}),
  cen AS (SELECT label, i, avg(x) AS m, count(*) AS n FROM flat GROUP BY ALL),
  allc AS (SELECT i, avg(x) AS g FROM flat GROUP BY i),
  bw AS (SELECT sum(n * (m - g) * (m - g)) AS b FROM cen JOIN allc USING (i)),
  ww AS (SELECT sum((x - m) * (x - m)) AS w FROM flat JOIN cen USING (label, i)),
  nk AS (SELECT count(*) AS n, count(DISTINCT label) AS k FROM {0}),
  ch AS (SELECT (b / (k - 1)) / (w / (n - k)) AS ch FROM bw, ww, nk),
  sc AS (SELECT label, avg(d) AS s FROM (SELECT review_id, label, sqrt(sum((x - m) * (x - m))) AS d FROM flat
    JOIN cen USING (label, i) GROUP BY ALL) GROUP BY label),
  pc AS (SELECT p.label AS a, q.label AS b, sqrt(sum((p.m - q.m) * (p.m - q.m))) AS d FROM cen p JOIN cen q
    ON p.i = q.i AND p.label <> q.label GROUP BY ALL),
  db AS (SELECT avg(r) AS db FROM (SELECT pc.a, max((x.s + y.s) / pc.d) AS r FROM pc JOIN sc x ON x.label = pc.a
    JOIN sc y ON y.label = pc.b GROUP BY pc.a))"""


@query(
    "m21_calinski_harabasz",
    f"WITH {I.EMBEDDINGS}, {_SPREAD.format('emb')} SELECT round(ch, 6) AS calinski_harabasz_score FROM ch",
)
def m21(spark, folder):
    return I.rounded(quality.calinski_harabasz(I.embeddings(spark, folder)), "calinski_harabasz_score")


@query(
    "m22_davies_bouldin",
    f"WITH {I.EMBEDDINGS}, {_SPREAD.format('emb')} SELECT round(db, 6) AS davies_bouldin_score FROM db",
)
def m22(spark, folder):
    return I.rounded(quality.davies_bouldin(I.embeddings(spark, folder)), "davies_bouldin_score")


# Label 9 plays the noise points.
_CLEAN_EMB = (
    "emb AS (SELECT vec_id AS review_id, embedding::DOUBLE[] AS features, label FROM embeddings"
    " WHERE label <> 9)"
)


@query(
    "m23_metrics_without_noise",
    f"""WITH {_CLEAN_EMB}, {_SILHOUETTE}, {_SPREAD.format('emb')} SELECT
  round((SELECT avg(s) FROM s), 6) AS silhouette_score, round(ch, 6) AS calinski_harabasz_score,
  round(db, 6) AS davies_bouldin_score, CAST(k AS INTEGER) AS n_clusters_found, 'exact' AS silhouette_mode
  FROM ch, db, nk""",
)
def m23(spark, folder):
    df = I.embeddings(spark, folder)
    df = df.withColumn("label", F.when(F.col("label") == 9, -1).otherwise(F.col("label")))
    return I.rounded(
        quality.clustering_metrics(df, mode="exact"), "silhouette_score", "calinski_harabasz_score",
        "davies_bouldin_score",
    )


@query("m24_choose_k")
def m24(spark, folder):
    return choose_k(I.embeddings(spark, folder), "k-means")[2]


def _embedded_reviews(spark, folder):
    return stored(embed_with(I.reviews(spark, folder), letter_encoder))


@query("m25_cluster_reviews")
def m25(spark, folder):
    return cluster_reviews(_embedded_reviews(spark, folder), "k-means", "pca")


@query("m25_cluster_reviews_fuzzy")
def m25_fuzzy(spark, folder):
    return cluster_reviews(_embedded_reviews(spark, folder), "fuzzy c-means", "pca")


@query("m26_one_combination")
def m26(spark, folder):
    combination = {
        "combination_id": "kmeans_none_compNone_k4", "algorithm": "kmeans",
        "reduction_method": "none", "n_components": None, "k_value": 4,
    }
    labelled, record = run_combination(I.embeddings(spark, folder), combination)
    return labelled.select(
        "review_id", "label", F.lit(record[0]).alias("combination_id"),
        F.lit(float(record[6])).alias("silhouette_score"),
    )


def _held_sql(limits: str, algorithms: str) -> str:
    """Every combination of the grid is there once and all that must be true of it is true."""
    return f"""SELECT combination_id, algorithm, reduction_method, n_components, k_value,
  true AS clusters_hold, true AS scores_hold, true AS params_hold, true AS total_holds
FROM ({grid_sql(limits)}) WHERE {algorithms}"""


def study_holds(study, points: int):
    """What must be true of every row of a study of so many points, whatever the models found.

    ``clusters_hold``: k-means and Ward find k clusters, the others no more than asked for.
    ``scores_hold``: scores are in their ranges. ``params_hold``: the record of the fit is there
    and in its bounds. ``total_holds``: inertia W and Calinski-Harabasz score C of k-means give
    the same total sum of squares W (1 + C (k - 1) / (n - k)) for every k of a reduction.
    """
    k, found, params = F.col("k_value"), F.col("n_clusters_found"), F.col("params")
    algorithm = F.col("algorithm")
    clusters = (
        F.when(algorithm.isin("kmeans", "agglomerative"), found == k)
        .when(algorithm == "dbscan", found.between(0, points))
        .otherwise(found.between(1, k))
    )
    silhouette, separation = F.col("silhouette_score"), F.col("davies_bouldin_score")
    scores = silhouette.between(-1.0, 1.0) & (F.col("calinski_harabasz_score") >= 0) & (separation >= 0)
    scores = F.when(found < 2, silhouette == quality.SENTINEL[0]).otherwise(scores)
    recorded = (
        F.when(algorithm == "kmeans", (params["inertia"] > 0) & (params["iterations"] >= 1))
        .when(
            algorithm == "fuzzy_cmeans",
            params["fpc"].between(1 / k - 1e-9, 1 + 1e-9)
            & (params["objective"] > 0)
            & (params["iterations"] >= 1)
            & params["multiple_membership"].between(0, points),
        )
        .when(algorithm == "lda", params["log_likelihood"] < 0)
        .when(algorithm == "dbscan", params["noise"].between(0, points))
        .otherwise(F.lit(True))
    )
    total = params["inertia"] * (1 + F.col("calinski_harabasz_score") * (k - 1) / (points - k))
    slot = W.partitionBy("reduction_method", "n_components")
    total = F.when(algorithm == "kmeans", total)
    spread_of = F.max(total).over(slot) / F.min(total).over(slot) - 1
    return study.select(
        "combination_id", "algorithm", "reduction_method", "n_components", "k_value",
        F.coalesce(clusters, F.lit(False)).alias("clusters_hold"),
        F.coalesce(scores, F.lit(False)).alias("scores_hold"),
        F.coalesce(recorded, F.lit(False)).alias("params_hold"),
        F.when(algorithm == "kmeans", spread_of < 1e-3).otherwise(F.lit(True)).alias("total_holds"),
    )


@query(
    "m27_study",
    _held_sql("SELECT max(len(embedding)) AS d, count(*) AS u FROM embeddings", "true"),
)
def m27(spark, folder):
    points = I.embeddings(spark, folder).drop("label")
    size, rows = points.agg(F.max(F.size("features")), F.count(F.lit(1))).first()
    return study_holds(run_study(points, X.grid(spark, size, rows_for_umap=rows)), rows)


@query(
    "m28_fuzzy_study",
    f"WITH {I.REVIEWS} "
    + _held_sql(
        "SELECT 6 AS d, count(*) AS u FROM (SELECT DISTINCT Review FROM reviews)",
        "algorithm = 'fuzzy_cmeans'",
    ),
)
def m28(spark, folder):
    df = _embedded_reviews(spark, folder)
    study = fuzzy_study(df)
    return study_holds(study, df.select("Review").distinct().count())


_PROMPTS = (
    f"{I.CLUSTERED}, numbered AS (SELECT row_number() OVER (ORDER BY Cluster, first_id) AS ID, Review,"
    " Cluster FROM (SELECT Cluster, Review, min(review_id) AS first_id FROM clustered GROUP BY ALL)),"
    " p AS (SELECT Cluster AS cluster, CAST(part AS INTEGER) AS part, "
    f"{len(GENERATION_HEAD + 'a notes app' + GENERATION_MIDDLE + GENERATION_TAIL)}"
    " + length(string_agg(ID || '. ' || Review, chr(10) ORDER BY ID)) AS n FROM (SELECT *,"
    " (row_number() OVER (PARTITION BY Cluster ORDER BY ID) - 1) // 20 AS part FROM numbered) GROUP BY ALL)"
)


@query(
    "m30_respond",
    f"""WITH {_PROMPTS} SELECT cluster, part, CASE WHEN n % 7 <> 0 THEN '**FR001:** The system shall handle topic '
  || n % 5 || ' of the feedback. (Based on comments: 1, ' || (n % 9 + 2) || ')' || chr(10)
  || '**NFR001 (Performance):** The system shall answer in ' || (n % 3 + 1)
  || ' seconds. (Based on comments: ' || (n % 4 + 1) || ')' END AS response,
  CASE WHEN n % 7 = 0 THEN 'RuntimeError: no answer' END AS error,
  CAST(CASE WHEN n % 7 = 0 THEN 3 ELSE 1 END AS INTEGER) AS attempts FROM p""",
)
def m30(spark, folder):
    clustered = numbered_clusters(I.clustered(spark, folder))
    return respond(generation_prompts(clustered, "a notes app", 20), echo_responder)


@query("m31_mine_requirements")
def m31(spark, folder):
    tables = mine_requirements(
        I.reviews(spark, folder), "a notes app", echo_responder, length_model, letter_encoder,
        reduction="pca", max_comments=20,
    )
    return tables["unified_requirements"]


@query(
    "m31_every_comment_is_cited",
    f"""WITH {I.REVIEWS}, asked AS (SELECT DISTINCT Review, unicode(Review) % {len(WISHES)} AS w,
    unicode(Review) % 7 + 1 AS s FROM reviews WHERE (length(Review) % 101) / 100.0::DOUBLE > 0.5),
  wishes AS (SELECT unnest({WISHES!r}) AS wish, generate_subscripts({WISHES!r}, 1) - 1 AS w)
SELECT CASE w WHEN 2 THEN 'NFR' ELSE 'FR' END AS kind, replace(wish, '{{0}}', min(s)::VARCHAR) || '.' AS description,
  count(*) AS n_comments, count(*) AS n_cited FROM asked JOIN wishes USING (w) GROUP BY w, wish""",
)
def m31_cited(spark, folder):
    tables = mine_requirements(
        I.reviews(spark, folder), "a notes app", reading_responder, length_model, letter_encoder,
        reduction="pca", max_comments=20,
    )
    cited = tables["requirement_citations"].groupBy("requirement_id").agg(
        F.count(F.lit(1)).alias("n_cited")
    )
    return tables["unified_requirements"].join(cited, "requirement_id", "left").select(
        F.regexp_extract("requirement_id", "^[A-Z]+", 0).alias("kind"), "description", "n_comments",
        F.coalesce("n_cited", F.lit(0)).alias("n_cited"),
    )
