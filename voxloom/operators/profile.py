"""What a cluster talks about: n-grams, TF-IDF terms, samples."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.types import IntegerType, LongType, StringType, StructType

from voxloom.functions.lists import counted_values, pieces
from voxloom.functions.ranking import id_bucket, number_rows
from voxloom.functions.text import content_tokens, shifted
from voxloom.operators.cleaning import first_per_cluster
from voxloom.session import stored

SLICE_ROWS = 1 << 14
_POSITION_BITS = 24
# Between the tokens of a review while it travels as one text.
_SEPARATOR = "\u0000"


def with_tokens(
    df: DataFrame, text: str = "Review", stop_words: list[str] | None = None, out: str = "tokens"
) -> DataFrame:
    return df.withColumn(out, content_tokens(F.col(text), stop_words))


def preprocessed(
    df: DataFrame, text: str = "Review", stop_words: list[str] | None = None, out: str = "clean"
) -> DataFrame:
    """The text reduced to its content tokens, joined by single spaces."""
    return df.withColumn(out, F.array_join(content_tokens(F.col(text), stop_words), " "))


def _packed(tokens: Column) -> Column:
    """The tokens as one text, a third of the size of an array; null without tokens."""
    return F.when(F.size(tokens) > 0, F.array_join(tokens, _SEPARATOR))


def _unpacked(text: Column) -> Column:
    return F.coalesce(F.split(text, _SEPARATOR), F.array().cast("array<string>"))


def _ranked_text(tokens: DataFrame, cluster: str, order: str) -> DataFrame:
    kept = stored(tokens.select(cluster, order, _packed(F.col("tokens")).alias("_text")))
    return number_rows(
        kept.withColumn("_empty", F.col("_text").isNull()),
        [order],
        {"empty": F.col("_empty"), "slice": id_bucket(order)},
        within=[cluster],
        out="_rank",
    ).drop("_empty")


def ranked_tokens(tokens: DataFrame, cluster: str = "Cluster", order: str = "review_id") -> DataFrame:
    """Number the reviews that have tokens inside their cluster, as ``_rank``.

    Reviews without tokens are numbered after the others. The tokens are written
    first, since the numbering reads them twice and they cost the most; they are
    ``_text`` too, packed into one value.
    """
    return _ranked_text(tokens, cluster, order).withColumn("tokens", _unpacked(F.col("_text")))


def _following_tokens(numbered: DataFrame, n: int, cluster: str) -> DataFrame:
    """Add ``_next``: the n-1 tokens that follow each review in its cluster.

    The numbered reviews are cut into slices; the first n-1 reviews of a slice
    are repeated at the end of the slice before, so each slice sees its
    successors and no task holds a whole cluster.
    """
    own = F.floor((F.col("_rank") - 1) / SLICE_ROWS)
    borrowed = ((F.col("_rank") - 1) % SLICE_ROWS < n - 1) & (own > 0)
    slices = F.when(borrowed, F.array(own, own - 1)).otherwise(F.array(own))
    head = F.slice(_unpacked(F.col("_text")), 1, n - 1)
    spread = numbered.withColumns({"_own": own, "_head": head}).withColumn("_slice", F.explode(slices))
    ahead = W.partitionBy(cluster, "_slice").orderBy("_rank")
    heads = [
        F.coalesce(
            F.lead("_head", i).over(ahead), F.array().cast("array<string>")
        )
        for i in range(1, n)
    ]
    following = F.slice(F.concat(*heads), 1, n - 1)
    return spread.withColumn("_next", following).where(F.col("_own") == F.col("_slice"))


def ngrams(
    tokens: DataFrame,
    n: int = 2,
    cluster: str = "Cluster",
    order: str = "review_id",
    within_review: bool = False,
) -> DataFrame:
    """All n-grams of a cluster with their count and first position.

    The reviews of a cluster are read as one text in ``order``, so an n-gram
    may run from one review into the next; ``within_review`` stops that.
    """
    if "_rank" not in tokens.columns:
        tokens = ranked_tokens(tokens, cluster, order)
    text = F.col("_text") if "_text" in tokens.columns else _packed(F.col("tokens"))
    numbered = tokens.select(cluster, "_rank", text.alias("_text")).where(F.col("_text").isNotNull())
    if n == 1 or within_review:
        joined = numbered.withColumn("_next", F.array().cast("array<string>"))
    else:
        joined = _following_tokens(numbered, n, cluster)
    streams = joined.select(cluster, "_rank", F.concat(_unpacked(F.col("_text")), "_next").alias("_stream"))
    zipped = streams.select(
        cluster, "_rank", F.posexplode(shifted(F.col("_stream"), n)).alias("_p", "_w")
    )
    parts = [F.col("_w")[f"w{i}"] for i in range(n)]
    rows = zipped.where(parts[-1].isNotNull()).select(
        cluster,
        F.concat_ws(" ", *parts).alias("ngram"),
        (F.shiftleft("_rank", _POSITION_BITS) + F.col("_p")).alias("_at"),
    )
    return rows.groupBy(cluster, "ngram").agg(
        F.count(F.lit(1)).alias("n"), F.min("_at").alias("first_at")
    )


def top_ngrams(
    tokens: DataFrame,
    n: int = 2,
    k: int = 10,
    cluster: str = "Cluster",
    order: str = "review_id",
    within_review: bool = False,
) -> DataFrame:
    """The ``k`` most frequent n-grams of each cluster; ties go to the first seen."""
    counted = ngrams(tokens, n, cluster, order, within_review)
    rank = F.row_number().over(W.partitionBy(cluster).orderBy(F.desc("n"), "first_at"))
    return (
        counted.withColumn("place", rank).where(F.col("place") <= k).select(cluster, "ngram", "n", "place")
    )


def term_counts(tokens: DataFrame) -> DataFrame:
    """Replace ``tokens`` by one row per distinct token of the row and its count.

    All tokens of a row are in one task, so counting needs no shuffle.
    """
    others = [c for c in tokens.columns if c != "tokens"]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, len(others)):
            rows, terms, times = counted_values(piece.column(len(others)))
            held = [piece.column(i).take(pa.array(rows)) for i in range(len(others))]
            yield pa.RecordBatch.from_arrays(
                [*held, terms, pa.array(times.astype("int32"))], [*others, "term", "_tf"]
            )

    schema = StructType([tokens.schema[c] for c in others])
    schema = schema.add("term", StringType()).add("_tf", IntegerType())
    return tokens.select(*others, "tokens").mapInArrow(task, schema)


def _usage(tokens: DataFrame, cluster: str) -> DataFrame:
    """``cluster, term, _total, _df``: occurrences and reviews, added up in the tasks first."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, 1):
            rows, terms, times = counted_values(piece.column(1))
            found = pa.table(
                {"cluster": piece.column(0).take(pa.array(rows)), "term": terms, "tf": pa.array(times)}
            )
            totals = found.group_by(["cluster", "term"], use_threads=False)
            totals = totals.aggregate([("tf", "sum"), ("tf", "count")])
            yield from totals.select(["cluster", "term", "tf_sum", "tf_count"]).rename_columns(
                [cluster, "term", "_total", "_df"]
            ).to_batches()

    schema = StructType([tokens.schema[cluster]])
    schema = schema.add("term", StringType()).add("_total", LongType()).add("_df", LongType())
    parts = tokens.select(cluster, "tokens").mapInArrow(task, schema)
    return parts.groupBy(cluster, "term").agg(F.sum("_total").alias("_total"), F.sum("_df").alias("_df"))


def tfidf_terms(
    tokens: DataFrame, max_features: int = 100, cluster: str = "Cluster", order: str = "review_id"
) -> DataFrame:
    """Mean TF-IDF weight of the terms of each cluster.

    Fitted inside each cluster: terms of two letters or more, the
    ``max_features`` most frequent ones, idf ln((1 + n) / (1 + df)) + 1, rows
    scaled to unit length, weights averaged over all n reviews of the cluster.
    The weights of the kept terms are stored, so Spark knows their size and
    broadcasts them only when they are small.
    """
    sizes = tokens.groupBy(cluster).agg(F.count(F.lit(1)).alias("_n"))
    usage = _usage(tokens, cluster).where(F.length("term") >= 2)
    place = F.row_number().over(W.partitionBy(cluster).orderBy(F.desc("_total"), "term"))
    kept = usage.withColumn("_place", place).where(F.col("_place") <= max_features)
    idf = stored(
        kept.join(sizes, cluster)
        .withColumn("_idf", F.log((1.0 + F.col("_n")) / (1.0 + F.col("_df"))) + 1.0)
        .select(cluster, "term", "_idf", "_n")
    )
    tf = term_counts(tokens.select(cluster, order, "tokens"))
    weighted = tf.join(idf, [cluster, "term"]).withColumn("_w", F.col("_tf") * F.col("_idf"))
    norm = F.sqrt(F.sum(F.col("_w") * F.col("_w")).over(W.partitionBy(cluster, order)))
    return (
        weighted.withColumn("_u", F.col("_w") / norm)
        .groupBy(cluster, "term")
        .agg((F.sum("_u") / F.max("_n")).alias("score"))
    )


def top_terms(scores: DataFrame, k: int = 20, cluster: str = "Cluster") -> DataFrame:
    rank = F.row_number().over(W.partitionBy(cluster).orderBy(F.desc(F.round("score", 9)), "term"))
    return scores.withColumn("place", rank).where(F.col("place") <= k)


def cluster_profiles(
    df: DataFrame,
    text: str = "Review",
    cluster: str = "Cluster",
    order: str = "review_id",
    max_features: int = 100,
    n_terms: int = 20,
    n_grams: int = 10,
    n_samples: int = 3,
    stop_words: list[str] | None = None,
) -> DataFrame:
    """One row per cluster: size, mean length, terms, bigrams, trigrams, samples.

    Each list has a length set by a parameter, so a cluster's row stays small.
    The numbered tokens are written once and read by all four parts.
    """
    df = df.na.drop(subset=[text, cluster]).select(cluster, order, text)
    tokens = with_tokens(df, text, stop_words).select(cluster, order, "tokens")
    tokens = stored(_ranked_text(tokens, cluster, order))
    tokens = tokens.withColumn("tokens", _unpacked(F.col("_text")))
    base = df.groupBy(cluster).agg(
        F.count(F.lit(1)).alias("size"), F.avg(F.length(text)).alias("avg_text_length")
    )

    def listed(ranked: DataFrame, out: str, *fields: str) -> DataFrame:
        items = F.sort_array(F.collect_list(F.struct("place", *fields)))
        return ranked.groupBy(cluster).agg(items.alias("_l")).select(
            cluster, F.transform("_l", lambda r: F.struct(*[r[f].alias(f) for f in fields])).alias(out)
        )

    samples = first_per_cluster(df, n_samples, cluster, order).withColumnRenamed("sample_no", "place")
    parts = [
        listed(top_terms(tfidf_terms(tokens, max_features, cluster, order), n_terms, cluster),
               "tfidf_terms", "term", "score"),
        listed(top_ngrams(tokens, 2, n_grams, cluster, order), "top_bigrams", "ngram", "n"),
        listed(top_ngrams(tokens, 3, n_grams, cluster, order), "top_trigrams", "ngram", "n"),
        listed(samples.withColumnRenamed(text, "text"), "sample_texts", "text"),
    ]
    for part in parts:
        base = base.join(part, cluster, "left")
    return base
