"""Clean and score reviews as files arrive. The operators are the batch ones."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import LongType, StructField, StructType

from voxloom.operators.cleaning import drop_unusable
from voxloom.operators.scoring import score_with
from voxloom.schemas import REVIEWS
from voxloom.sources.readers import CSV_OPTIONS


def stream_reviews(spark: SparkSession, folder: str) -> DataFrame:
    """New review files of a folder: ``review_id, Review``, blank ones dropped."""
    schema = StructType([StructField("review_id", LongType()), *REVIEWS.fields])
    return drop_unusable(spark.readStream.schema(schema).options(**CSV_OPTIONS).csv(folder))


def score_stream(
    reviews: DataFrame,
    make_model: Callable[[], Callable[[list[str]], list[float]]],
    output: str,
    checkpoint: str,
    available_now: bool = True,
) -> StreamingQuery:
    """Score the stream into Parquet files; ends when all present files are done."""
    writer = score_with(reviews, make_model).writeStream.format("parquet").outputMode("append")
    writer = writer.option("path", output).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start() if available_now else writer.start()
