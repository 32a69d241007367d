"""The row-wise operators give the same rows on a stream."""

from voxloom.catalog.learning import length_model
from voxloom.operators.cleaning import drop_unusable
from voxloom.operators.scoring import score_with
from voxloom.sources import writers
from voxloom.streaming.reviews import score_stream, stream_reviews


def test_stream_equals_batch(spark, tmp_path):
    rows = [(i, "x" * i if i % 3 else "  ") for i in range(1, 40)]
    df = spark.createDataFrame(rows, "review_id long, Review string")
    source = writers.write_csv(df.repartition(3), str(tmp_path / "in"))
    query = score_stream(
        stream_reviews(spark, source), length_model, str(tmp_path / "out"), str(tmp_path / "state")
    )
    query.awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out"))
    want = score_with(drop_unusable(df), length_model)
    assert got.count() == want.count() > 0
    assert got.select(*want.columns).exceptAll(want).count() == 0
