"""Normalising, tokens, glossary features, n-grams, TF-IDF, profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxloom.catalog import inputs as I
from voxloom.functions.text import normalise
from voxloom.functions.vectors import (
    from_json_text,
    l2_norm,
    masked_mean,
    to_json_text,
)
from voxloom.operators import glossary as G
from voxloom.operators import profile as P
from voxloom.session import spread

QUERIES: dict = {}
SQL: dict = {}

# A short stop list shared by the queries and their SQL.
STOP_WORDS = [
    "a", "al", "como", "con", "de", "del", "der", "des", "die", "du", "el", "en", "es", "in",
    "is", "la", "las", "le", "les", "los", "no", "of", "on", "para", "por", "que", "se", "the",
    "to", "un", "una", "und", "y", "zu",
]


def query(name: str, sql: str | None = None):
    def add(run):
        QUERIES[name] = run
        if sql is not None:
            SQL[name] = sql
        return run

    return add


_NORMAL = "trim(regexp_replace(lower(Review), '[^a-záéíóúñü]+', ' ', 'g'))"
_STOPS = ", ".join(f"'{w}'" for w in STOP_WORDS)


def tokens_sql(source: str = "reviews") -> str:
    """Token lists; contractions are split by looking each word up."""
    return f"""tok AS (SELECT * EXCLUDE (raw, Review), Review, list_filter(flatten(list_transform(raw, lambda w:
    CASE w WHEN 'cannot' THEN ['can', 'not'] WHEN 'gimme' THEN ['gim', 'me']
    WHEN 'gonna' THEN ['gon', 'na'] WHEN 'gotta' THEN ['got', 'ta'] WHEN 'lemme' THEN ['lem', 'me']
    WHEN 'wanna' THEN ['wan', 'na'] ELSE [w] END)), lambda w: w <> '' AND w NOT IN ({_STOPS})) AS tokens
  FROM (SELECT *, string_split({_NORMAL}, ' ') AS raw FROM {source}))"""


def _tokens(spark, folder):
    return P.with_tokens(spread(I.clustered(spark, folder), "review_id"), stop_words=STOP_WORDS)


@query("t1_normalise", f"WITH {I.REVIEWS} SELECT review_id, {_NORMAL} AS clean FROM reviews")
def t1(spark, folder):
    return I.reviews(spark, folder).select("review_id", normalise(F.col("Review")).alias("clean"))


@query(
    "t2_content_tokens",
    f"WITH {I.REVIEWS}, {tokens_sql()} SELECT review_id,"
    " coalesce(array_to_string(tokens, ' '), '') AS clean FROM tok",
)
def t2(spark, folder):
    df = P.preprocessed(spread(I.reviews(spark, folder), "review_id"), stop_words=STOP_WORDS)
    return df.select("review_id", "clean")


def _ngram_sql(n: int) -> str:
    gram = " || ' ' || ".join(
        ["w"] + [f"lead(w, {i}) OVER (PARTITION BY Cluster ORDER BY review_id, p)" for i in range(1, n)]
    )
    return f"""WITH {I.CLUSTERED}, {tokens_sql('clustered')},
  flat AS (SELECT Cluster, review_id, unnest(tokens) AS w, generate_subscripts(tokens, 1) AS p FROM tok),
  grams AS (SELECT Cluster, review_id, p, {gram} AS ngram FROM flat),
  counted AS (SELECT Cluster, ngram, count(*) AS n, min((review_id, p)) AS first_at FROM grams
    WHERE ngram IS NOT NULL GROUP BY ALL)
SELECT Cluster, ngram, n, CAST(place AS INTEGER) AS place FROM (SELECT *,
  row_number() OVER (PARTITION BY Cluster ORDER BY n DESC, first_at) AS place FROM counted)
WHERE place <= 10"""


@query("t3_top_bigrams", _ngram_sql(2))
def t3_bi(spark, folder):
    return P.top_ngrams(_tokens(spark, folder), 2)


@query("t3_top_trigrams", _ngram_sql(3))
def t3_tri(spark, folder):
    return P.top_ngrams(_tokens(spark, folder), 3)


@query(
    "t3_all_bigrams",
    _ngram_sql(2).split("SELECT Cluster, ngram, n, CAST")[0]
    + "SELECT Cluster, ngram, n FROM counted",
)
def t3_all(spark, folder):
    return P.ngrams(_tokens(spark, folder), 2).drop("first_at")


_TFIDF = f"""WITH {I.CLUSTERED}, {tokens_sql('clustered')},
  sizes AS (SELECT Cluster, count(*) AS n FROM tok GROUP BY Cluster),
  tf AS (SELECT Cluster, review_id, term, count(*) AS tf FROM
    (SELECT Cluster, review_id, unnest(tokens) AS term FROM tok) WHERE length(term) >= 2 GROUP BY ALL),
  usage AS (SELECT Cluster, term, sum(tf) AS total, count(*) AS df FROM tf GROUP BY ALL),
  kept AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY Cluster ORDER BY total DESC, term)
    AS place FROM usage) WHERE place <= 100),
  w AS (SELECT Cluster, review_id, term, n, tf * (ln((1.0::DOUBLE + n) / (1.0::DOUBLE + df)) + 1) AS w
    FROM tf JOIN kept USING (Cluster, term) JOIN sizes USING (Cluster)),
  u AS (SELECT *, w / sqrt(sum(w * w) OVER (PARTITION BY Cluster, review_id)) AS u FROM w),
  scores AS (SELECT Cluster, term, sum(u) / max(n) AS score FROM u GROUP BY ALL)"""


@query("t4_tfidf_terms", f"{_TFIDF} SELECT Cluster, term, round(score, 6) AS score FROM scores")
def t4(spark, folder):
    return I.rounded(P.tfidf_terms(_tokens(spark, folder)), "score")


@query(
    "t4_top_terms",
    f"{_TFIDF} SELECT Cluster, term, round(score, 6) AS score, CAST(place AS INTEGER) AS place FROM"
    " (SELECT *, row_number() OVER (PARTITION BY Cluster ORDER BY round(score, 9) DESC, term) AS place"
    " FROM scores) WHERE place <= 20",
)
def t4_top(spark, folder):
    return I.rounded(P.top_terms(P.tfidf_terms(_tokens(spark, folder))), "score")


@query(
    "t5_cluster_profiles",
    f"""{_TFIDF}, terms AS (SELECT Cluster, string_agg(term, ',' ORDER BY place) AS terms FROM
  (SELECT *, row_number() OVER (PARTITION BY Cluster ORDER BY round(score, 9) DESC, term) AS place
   FROM scores) WHERE place <= 20 GROUP BY Cluster),
  bi AS ({_ngram_sql(2).replace('WITH ' + I.CLUSTERED + ', ' + tokens_sql('clustered') + ',', 'WITH')}),
  bis AS (SELECT Cluster, string_agg(ngram || ':' || n, ',' ORDER BY place) AS bigrams FROM bi GROUP BY Cluster),
  tri AS ({_ngram_sql(3).replace('WITH ' + I.CLUSTERED + ', ' + tokens_sql('clustered') + ',', 'WITH')}),
  tris AS (SELECT Cluster, string_agg(ngram || ':' || n, ',' ORDER BY place) AS trigrams FROM tri GROUP BY Cluster),
  base AS (SELECT Cluster, count(*) AS size, round(avg(length(Review)), 6) AS avg_text_length
    FROM clustered GROUP BY Cluster),
  samples AS (SELECT Cluster, string_agg(md5(Review), ',' ORDER BY review_id) AS samples FROM
    (SELECT *, row_number() OVER (PARTITION BY Cluster ORDER BY review_id) AS r FROM clustered)
    WHERE r <= 3 GROUP BY Cluster)
SELECT * FROM base JOIN terms USING (Cluster) JOIN bis USING (Cluster) JOIN tris USING (Cluster)
  JOIN samples USING (Cluster)""",
)
def t5(spark, folder):
    df = P.cluster_profiles(spread(I.clustered(spark, folder), "review_id"), stop_words=STOP_WORDS)
    counted = lambda name: F.array_join(
        F.transform(name, lambda g: F.concat_ws(":", g["ngram"], g["n"])), ","
    )
    return df.select(
        "Cluster",
        "size",
        F.round("avg_text_length", 6).alias("avg_text_length"),
        F.array_join(F.transform("tfidf_terms", lambda t: t["term"]), ",").alias("terms"),
        counted("top_bigrams").alias("bigrams"),
        counted("top_trigrams").alias("trigrams"),
        F.array_join(F.transform("sample_texts", lambda s: F.md5(s["text"].cast("binary"))), ",").alias(
            "samples"
        ),
    )


_RC = f"""WITH {I.REVIEWS}, {I.GLOSSARY} SELECT review_id,
  CAST(list_sum(list_transform(t, lambda x: CAST(contains(Review, x) AS INTEGER))) AS INTEGER) AS rc
  FROM reviews, (SELECT list(Term) AS t FROM glossary)"""


@query("t6_relevant_count", _RC)
def t6(spark, folder):
    df = G.relevant_count(I.reviews(spark, folder), I.glossary(spark, folder))
    return df.select("review_id", "rc")


# A second glossary: the two-letter and longer words of the benchmark texts.
_WORDS = (
    "glossary AS (SELECT DISTINCT w AS Term FROM (SELECT unnest(regexp_extract_all(text,"
    " '[\\p{L}\\p{N}]+')) AS w FROM benchmark) WHERE length(w) >= 2)"
)


def _word_glossary(spark, folder):
    found = F.regexp_extract_all("text", F.lit(r"[\p{L}\p{N}]+"), 0)
    terms = I.table(spark, folder, "benchmark").select(F.explode(found).alias("Term"))
    return terms.where(F.length("Term") >= 2).distinct()


@query(
    "t6_relevant_count_large_glossary",
    f"""WITH {I.REVIEWS}, {_WORDS} SELECT review_id,
  CAST(list_sum(list_transform(t, lambda x: CAST(contains(Review, x) AS INTEGER))) AS INTEGER) AS rc
  FROM reviews, (SELECT list(Term) AS t FROM glossary)""",
)
def t6_large(spark, folder):
    df = G.relevant_count(
        spread(I.reviews(spark, folder), "review_id"), _word_glossary(spark, folder), method="join"
    )
    return df.select("review_id", "rc")


@query(
    "t7_count_vector",
    f"SELECT review_id, rc * 120.0::DOUBLE AS full_sum, rc::DOUBLE AS first_sum FROM ({_RC})",
)
def t7(spark, folder):
    from pyspark.ml.functions import vector_to_array

    df = G.relevant_count(I.reviews(spark, folder), I.glossary(spark, folder))
    df = G.count_vector(G.count_vector(df, 120), 120, full=False, out="first")
    total = lambda c: F.aggregate(vector_to_array(c), F.lit(0.0), lambda s, v: s + v)
    return df.select(
        "review_id", total("rc_vector").alias("full_sum"), total("first").alias("first_sum")
    )


# Two-word and one-word terms: adjacent words of the benchmark texts.
_PHRASES = """bw AS (SELECT regexp_extract_all(text, '[\\p{L}\\p{N}]+') AS ws FROM benchmark),
  glossary AS (SELECT DISTINCT ws[1] || ' ' || ws[2] AS Term FROM bw WHERE len(ws) > 1
    UNION SELECT DISTINCT ws[3] FROM bw WHERE len(ws) > 2)"""
_COVERED = f"""WITH {I.REVIEWS}, {_PHRASES},
  g AS (SELECT DISTINCT array_to_string(t, ' ') AS gram, len(t) AS m FROM (SELECT
    regexp_extract_all(Term, '[\\p{{L}}\\p{{N}}]+') AS t FROM glossary)),
  d AS (SELECT review_id, regexp_extract_all(Review, '[\\p{{L}}\\p{{N}}]+') AS ws FROM reviews),
  s AS (SELECT review_id, ws, unnest(range(0, len(ws))) AS p FROM d),
  k AS (SELECT review_id, p, 1 AS m, ws[p + 1] AS gram FROM s
    UNION ALL SELECT review_id, p, 2, ws[p + 1] || ' ' || ws[p + 2] FROM s WHERE p + 2 <= len(ws)),
  c AS (SELECT DISTINCT review_id, CAST(unnest(range(p, p + m)) AS INTEGER) AS position
    FROM k JOIN g USING (gram, m))"""


def _phrase_glossary(spark, folder):
    found = F.regexp_extract_all("text", F.lit(r"[\p{L}\p{N}]+"), 0)
    ws = I.table(spark, folder, "benchmark").select(found.alias("ws"))
    pairs = ws.where(F.size("ws") > 1).select(F.concat_ws(" ", F.col("ws")[0], F.col("ws")[1]).alias("Term"))
    single = ws.where(F.size("ws") > 2).select(F.col("ws")[2].alias("Term"))
    return pairs.union(single).distinct()


@query("t8_covered_positions", f"{_COVERED} SELECT review_id, position FROM c")
def t8(spark, folder):
    return G.covered_positions(spread(I.reviews(spark, folder), "review_id"), _phrase_glossary(spark, folder))


@query(
    "t8_position_vector",
    f"{_COVERED} SELECT r.review_id, coalesce(list_sort(list(DISTINCT position % 120)"
    " FILTER (position IS NOT NULL))::VARCHAR, '[]') AS slots FROM reviews r LEFT JOIN c USING (review_id)"
    " GROUP BY r.review_id",
)
def t8_vector(spark, folder):
    from pyspark.ml.functions import vector_to_array

    df = G.position_vector(spread(I.reviews(spark, folder), "review_id"), _phrase_glossary(spark, folder), 120)
    # The vector is the argument, not a part of the lambda, which would unpack it for each slot.
    on = F.transform(vector_to_array("rp_vector"), lambda v, i: F.when(v == 1.0, i))
    on = F.filter(on, lambda i: i.isNotNull())
    return df.select(
        "review_id",
        F.concat(F.lit("["), F.array_join(on.cast("array<string>"), ", "), F.lit("]")).alias("slots"),
    )


@query(
    "t9_tokenised_glossary",
    f"WITH {I.GLOSSARY} SELECT Term, array_to_string(regexp_extract_all(Term, '[\\p{{L}}\\p{{N}}]+'),"
    " ' ') AS tokens FROM glossary",
)
def t9(spark, folder):
    df = G.tokenised_glossary(I.glossary(spark, folder))
    return df.select("Term", F.array_join("tokens", " ").alias("tokens"))


@query(
    "t10_json_round_trip",
    f"WITH {I.EMBEDDINGS} SELECT review_id, round(list_sum(features), 6) AS total,"
    " CAST(len(features) AS INTEGER) AS dimension FROM emb",
)
def t10(spark, folder):
    text = to_json_text(F.col("features"))
    df = I.embeddings(spark, folder).select("review_id", from_json_text(text).alias("v"))
    total = F.aggregate("v", F.lit(0.0), lambda s, x: s + x)
    return df.select("review_id", F.round(total, 6).alias("total"), F.size("v").alias("dimension"))


@query(
    "t11_masked_mean",
    f"""WITH {I.EMBEDDINGS}, flat AS (SELECT label, review_id % 3 <> 0 AS m, unnest(features) AS x,
    generate_subscripts(features, 1) AS i FROM emb),
  means AS (SELECT label, i, sum(CASE WHEN m THEN x ELSE 0 END) / greatest(sum(m::INTEGER), 1e-9) AS v
    FROM flat GROUP BY ALL),
  unit AS (SELECT label, i, v / sqrt(sum(v * v) OVER (PARTITION BY label)) AS v FROM means)
SELECT label, round(max(v) FILTER (i = 1), 6) AS first, round(max(v) FILTER (i = 64), 6) AS last,
  round(sqrt(sum(v * v)), 6) AS norm FROM unit GROUP BY label""",
)
def t11(spark, folder):
    tokens = I.embeddings(spark, folder).withColumn(
        "mask", (F.col("review_id") % 3 != 0).cast("int")
    )
    df = masked_mean(tokens, "label", "features", "mask")
    v = F.col("embedding")
    return df.select(
        "label",
        F.round(v[0], 6).alias("first"),
        F.round(v[63], 6).alias("last"),
        F.round(l2_norm(v), 6).alias("norm"),
    )
