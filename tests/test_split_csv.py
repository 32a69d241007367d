"""Quoted files read in many byte ranges: the rows of the plain reader, numbers by place."""

import csv
import io
import random

import pytest

from voxloom.sources import readers
from voxloom.sources.split_csv import numbered_records

VALUES = [
    "plain", "", 'with "quotes" in it', "two\nlines", "\n\n", "a,b,,c", '"', '""', '\n"\n"', "ñ 日本 🙂",
    "  spaces  ", ",", "ends with a break\n", "x" * 300, "many\n" * 40,
]


def table(seed, rows):
    rng = random.Random(seed)
    return [[rng.choice(VALUES), rng.choice(VALUES), f"{seed}-{i}"] for i in range(rows)]


def write(path, rows, quoting=csv.QUOTE_ALL, end="\n"):
    out = io.StringIO()
    writer = csv.writer(out, quoting=quoting, lineterminator=end)
    writer.writerow(["Review", "other, column", "mark"])
    writer.writerows(rows)
    path.write_bytes(out.getvalue().encode("utf-8"))


@pytest.fixture
def small_ranges(spark):
    """Files are cut into ranges of the given number of bytes."""
    name = "spark.sql.files.maxPartitionBytes"
    old = spark.conf.get(name)
    yield lambda size: spark.conf.set(name, str(size))
    spark.conf.set(name, old)


@pytest.mark.parametrize("quoting", [csv.QUOTE_ALL, csv.QUOTE_MINIMAL])
def test_equal_rows_however_files_are_cut(spark, tmp_path, small_ranges, quoting):
    files = {"b.csv": table(2, 120), "a.csv": table(1, 200), "c.csv": []}
    for name, rows in files.items():
        write(tmp_path / name, rows, quoting)
    # An empty value is null with and without quotes, or the empty text if it is quoted.
    want = [r[2] for name in sorted(files) for r in files[name]]
    plain = {r.mark: tuple(r) for r in readers.read_csv(spark, str(tmp_path)).collect()}
    seen = set()
    for size in (1 << 27, 4_000, 300):
        small_ranges(size)
        seen.add(spark.read.option("lineSep", "\n").text(str(tmp_path / "a.csv")).rdd.getNumPartitions())
        got = readers.read_reviews(spark, str(tmp_path)).orderBy("review_id").collect()
        assert [r.review_id for r in got] == list(range(320))
        assert [r.mark for r in got] == want
        assert {r.mark: tuple(r)[1:] for r in got} == plain
    assert min(seen) == 1 and max(seen) >= 16


def test_values_are_the_written_ones(spark, tmp_path, small_ranges):
    rows = [r for r in table(3, 150) if r[0] and r[1]]
    write(tmp_path / "r.csv", rows)
    small_ranges(500)
    got = readers.read_reviews(spark, str(tmp_path / "r.csv")).orderBy("review_id").collect()
    assert [[r["Review"], r["other, column"], r["mark"]] for r in got] == rows


def test_line_ends_empty_lines_and_byte_order_mark(spark, tmp_path):
    path = tmp_path / "r.csv"
    path.write_bytes('﻿"Review",n\r\n\r\n"a\nb",1\r\n\r\nc,2\r\n"",3\r\n'.encode())
    got = [(r.review_id, r.Review, r.n) for r in readers.read_reviews(spark, str(path)).orderBy("review_id").collect()]
    plain = [(i, *r) for i, r in enumerate(readers.read_csv(spark, str(path)).collect())]
    assert got == plain and got[0] == (0, "a\nb", "1")


def test_a_record_over_many_ranges(spark, tmp_path, small_ranges):
    long = "line, with \"marks\"\n" * 2_000
    write(tmp_path / "r.csv", [["first", "x", "0"], [long, "y", "1"], ["last", "z", "2"]])
    small_ranges(2_000)
    got = readers.read_reviews(spark, str(tmp_path / "r.csv")).orderBy("review_id").collect()
    assert [r.Review for r in got] == ["first", long, "last"]


def test_a_stray_quote_is_an_error_and_not_a_wrong_row(spark, tmp_path):
    path = tmp_path / "r.csv"
    path.write_text('Review,n\na 5" screen,1\nother 7" one,2\n')
    with pytest.raises(Exception, match="split=False"):
        readers.read_reviews(spark, str(path)).collect()
    assert readers.read_reviews(spark, str(path), split=False).count() == 2


def test_own_ids_stay(spark, tmp_path):
    (tmp_path / "r.csv").write_text("Review,review_id\na,17\nb,4\n")
    got = readers.read_reviews(spark, str(tmp_path / "r.csv"))
    assert got.columns == ["Review", "review_id"]
    assert {(r.Review, r.review_id) for r in got.collect()} == {("a", 17), ("b", 4)}


def test_places_start_with_the_header(spark, tmp_path):
    write(tmp_path / "r.csv", table(4, 5))
    rows = numbered_records(spark, str(tmp_path / "r.csv")).orderBy("_place").collect()
    assert [(r["_place"], r["_number"]) for r in rows] == [(i, i - 1) for i in range(6)]
