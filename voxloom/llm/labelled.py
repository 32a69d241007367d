"""A bounded sample of labelled documents, to fit models on."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SAMPLE_ROWS = 20_000


def labelled_sample(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """Documents with their label columns, about ``rows`` of the labels at most.

    Labels are picked by a hash of their id, so a rerun picks the same ones. The picked
    labels are a table of bounded size, which travels to the documents; the texts stay
    where they are. Rows without an id have no label.
    """
    labels = labels.where(F.col("doc_id").isNotNull())
    total = labels.count()
    share = F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    picked = labels.where(share < F.lit(min(1.0, rows / max(1, total))))
    names = [c for c in labels.columns if c != "doc_id"]
    picked = picked.select(F.col("doc_id").alias("_id"), *[F.col(c).alias(f"_{c}") for c in names])
    kept = docs.join(F.broadcast(picked), F.col("doc_id") == F.col("_id")).drop("_id")
    clash = [c for c in names if c in kept.columns]
    return kept.drop(*clash).withColumnsRenamed({f"_{c}": c for c in names})
