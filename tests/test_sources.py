"""Readers: newlines in quotes, byte-order mark, header case, missing columns."""

import pytest

from voxloom.operators import cleaning
from voxloom.sources import readers, writers


def write(folder, name, text):
    path = folder / name
    path.write_bytes(text.encode("utf-8"))
    return str(path)


def test_quoted_newlines_and_byte_order_mark(spark, tmp_path):
    text = '﻿Review\n"first line\nsecond ""quoted"" line\n"\nplain\n"   \n"\nNA\n'
    df = readers.read_reviews(spark, write(tmp_path, "r.csv", text))
    assert df.columns == ["review_id", "Review"]
    assert df.count() == 4
    kept = [r.Review for r in cleaning.drop_unusable(df).collect()]
    assert kept == ['first line\nsecond "quoted" line\n', "plain"]


def test_header_case_does_not_matter(spark, tmp_path):
    df = readers.read_reviews(spark, write(tmp_path, "r.csv", "review ,stars\ngood,5\n"))
    assert df.columns == ["review_id", "Review", "stars"]


def test_missing_column_is_an_error(spark, tmp_path):
    with pytest.raises(ValueError, match="Review"):
        readers.read_reviews(spark, write(tmp_path, "r.csv", "text\ngood\n"))


def test_missing_text_becomes_the_row_id(spark, tmp_path):
    df = readers.read_embeddings(spark, write(tmp_path, "e.csv", 'embeddings\n"[1, 2.5]"\n'))
    row = df.first()
    assert row["embeddings"] == [1.0, 2.5]
    assert row["text"] == str(row["review_id"])


def test_run_folder_is_named_by_its_time():
    from datetime import datetime

    assert writers.run_folder("/runs/", datetime(2024, 5, 6, 7, 8, 9)) == "/runs/run_id=20240506_070809"
