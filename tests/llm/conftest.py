"""Documents for the operators' tests: a given table and the awkward rows."""

import pytest
from close_texts import near_group

FOLDER = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def folder():
    return FOLDER


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls in every column, empty, long and repeated texts, equal ids."""
    long_text = " ".join(f"word{i % 997} of line {i}." for i in range(4000))
    rows = [
        (900001, None, None, None, None),
        (900002, "", "en", "src0", 0),
        (900003, " \n\t ", "en", None, 4),
        (900004, long_text, "en", "src0", len(long_text)),
        (None, "A text without an id has words. It has two lines.\nAnd one more here.", "en", "s", 9),
        (900005, "same row twice, with a few words in it. And a second sentence. And a third.", "en", "s", 1),
        (900005, "same row twice, with a few words in it. And a second sentence. And a third.", "en", "s", 1),
        (900006, "日本語のテキスト。二つ目の文。三つ目の文です。", "ja", "ｓ", 3),
        (900007, "one", "en", "src1", 3),
        (900007, "same id, other text", "en", "src1", 3),
        (900009, "<|endoftext|>one<|endoftext|><|endoftext|> two", "en", "src1", 3),
        (900008, "😀 <|end|> # * $ % & | < >   ▁ x", "en", "src1", 3),
    ]
    return rows


@pytest.fixture(scope="session")
def docs(spark, odd_rows):
    given = spark.read.parquet(f"{FOLDER}/documents.parquet").select(
        "doc_id", "text", "lang", "source", "n_chars"
    )
    near = [
        (950000 + i, t, "en", "src2", len(t)) for i, t in enumerate(near_group(12, 120, 1, 5))
    ]
    return given.unionByName(spark.createDataFrame(odd_rows + near, SCHEMA)).cache()


@pytest.fixture(scope="session")
def rows(docs):
    return [r.asDict() for r in docs.collect()]


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def labels(spark, folder):
    return spark.read.parquet(f"{folder}/labels.parquet")
