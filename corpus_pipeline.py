"""The corpus pipeline: from raw documents to token ids of a mixed, clean corpus.

Each stage takes what its predecessor kept. Its result is written as Parquet and read again
as the next one's documents; all but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxloom.llm import jaccard, mixing, pieces, rules, sentences
from voxloom.session import stored

SOURCE_WEIGHTS = [5.0, 2.0, 1.0]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that neither the base rule nor a learned rule rejects."""
    return rules.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of texts that are linked by a likeness of 0.8."""
    return jaccard.one_of_each_class(docs)


def repeated_spans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without the sentences that an earlier document or line has."""
    cleaned = sentences.remove_repeats(docs).select(*[F.col(f"`{c}`") for c in docs.columns])
    if "n_chars" not in docs.columns:
        return cleaned
    count = F.length("text").cast(docs.schema["n_chars"].dataType)
    return cleaned.withColumn("n_chars", count).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as many times as the mix of the sources takes them."""
    return mixing.mix_documents(docs, SOURCE_WEIGHTS)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, n_pieces, ids, round_trip`` of every document."""
    model = pieces.load_model(public_tokenizers.path("piece_bpe_32k.model"))
    return pieces.encode_report(docs, model)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("repeated_spans", repeated_spans),
    ("mix_sources", mix_sources),
    ("encode_pieces", encode_pieces),
]

# Learned rules, hashed bands and random trades have no SQL; the tests compare the stages
# with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
