"""CSV with quoted newlines, read by many tasks, with numbers that follow the place in the files.

A line break inside quotes doesn't end a record, so a reader that starts inside a file can't
tell a record's first line by itself. But a quote in a value is doubled, so a line is inside
quotes if and only if an odd number of quote marks stands before it. The marks are counted per
byte range of a file, the running counts of the ranges (one row each) tell every range how it
starts, and records are put together inside their range. Only a record that crosses from one
range to the next meets its other lines in a second, small step.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from voxloom.session import stored

_RANGE = ["_file", "_block"]


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of the files with their byte range and their order in it."""
    raw = spark.read.option("lineSep", "\n").text(path)
    return raw.select(
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_block"),
        # Grows along a task, which reads a range from its start to its end.
        F.monotonically_increasing_id().alias("_line"),
        F.col("value").alias("_text"),
    )


def _marks(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit('"'), F.lit("")))


def _well_quoted(text: Column, inside: Column) -> Column:
    """Quotes open after a comma or the start, and close before a comma or the end.

    The pieces between quote marks are inside and outside quotes in turn; an empty piece
    outside is a doubled mark.
    """
    pieces = F.split(F.regexp_replace(text, "\r$", ""), '"', -1)
    last = F.size(pieces) - 1

    def fits(piece: Column, at: Column) -> Column:
        outside = (at + F.when(inside, 1).otherwise(0)) % 2 == 0
        # A byte-order mark may stand before the header.
        opens = (at == last) | piece.endswith(",") | piece.isin("", "\ufeff")
        closes = (at == 0) | piece.startswith(",") | (piece == "")
        return ~outside | (opens & closes)

    # The lambda of ``transform`` also takes the place of the piece.
    return F.forall(F.transform(pieces, fits), lambda ok: ok)


def _records(lines: DataFrame) -> DataFrame:
    """``_file, _block, _at, _starts, _record``: whole records and, of a crossing one, its parts."""
    earlier = W.partitionBy("_file").orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    ranges = lines.groupBy(*_RANGE).agg(F.sum(_marks(F.col("_text"))).alias("_marks"))
    opened = ranges.select(*_RANGE, F.coalesce(F.sum("_marks").over(earlier), F.lit(0)).alias("_before"))
    above = W.partitionBy(*_RANGE).orderBy("_line").rowsBetween(W.unboundedPreceding, -1)
    upto = W.partitionBy(*_RANGE).orderBy("_line").rowsBetween(W.unboundedPreceding, 0)
    marks = F.col("_before") + F.coalesce(F.sum(_marks(F.col("_text"))).over(above), F.lit(0))
    placed = lines.join(opened, _RANGE).withColumn("_inside", marks % 2 == 1)
    checked = F.when(_well_quoted(F.col("_text"), F.col("_inside")), F.col("_text")).otherwise(
        F.raise_error(
            F.concat(F.lit("a quote mark inside an unquoted value, read with split=False: "), F.col("_text"))
        )
    )
    placed = placed.withColumn("_text", checked)
    # An empty line between records is no record.
    placed = placed.where(F.col("_inside") | ~F.col("_text").isin("", "\r"))
    numbered = placed.withColumn("_at", F.count_if(~F.col("_inside")).over(upto))
    gathered = numbered.groupBy(*_RANGE, "_at").agg(
        F.array_sort(F.collect_list(F.struct("_line", "_text"))).alias("_all"),
        F.max_by(~F.col("_inside"), -F.col("_line")).alias("_starts"),
    )
    text = F.array_join(F.transform("_all", lambda line: line["_text"]), "\n")
    return gathered.select(*_RANGE, "_at", "_starts", text.alias("_record"))


def numbered_records(spark: SparkSession, path: str) -> DataFrame:
    """``_file, _place, _number, _record``: the records of all files of a path.

    ``_place`` counts the records of a file from 0, its header; ``_number`` counts all but
    the headers from 0, file after file in the order of their names. Both are the same
    however the files are cut into ranges.
    """
    parts = stored(_records(_lines(spark, path)))
    totals = parts.groupBy(*_RANGE).agg(F.count_if("_starts").alias("_size"))
    earlier = W.partitionBy("_file").orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    starts = totals.select(*_RANGE, F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_from"))
    files = totals.groupBy("_file").agg(F.sum("_size").alias("_size"))
    # One row a file; a file's header takes no number.
    before = W.orderBy("_file").rowsBetween(W.unboundedPreceding, -1)
    bases = files.select("_file", F.coalesce(F.sum(F.col("_size") - 1).over(before), F.lit(0)).alias("_base"))
    placed = parts.join(starts, _RANGE).withColumn("_place", F.col("_from") + F.col("_at") - 1)
    # Lines before the first record of a range have place 0 there: they belong to the one before.
    # Whole records leave here; only parts of crossing ones meet again.
    crossing = ~F.col("_starts") | (_marks(F.col("_record")) % 2 == 1)
    whole = placed.where(~crossing).select("_file", "_place", "_record")
    joined = (
        placed.where(crossing)
        .groupBy("_file", "_place")
        .agg(F.array_sort(F.collect_list(F.struct("_block", "_record"))).alias("_all"))
        .select("_file", "_place", F.array_join(F.transform("_all", lambda p: p["_record"]), "\n").alias("_record"))
    )
    return (
        whole.union(joined)
        .join(bases, "_file")
        .select("_file", "_place", (F.col("_base") + F.col("_place") - 1).alias("_number"), "_record")
    )


def read_split_csv(
    spark: SparkSession, path: str, schema: T.StructType, options: dict, number: str
) -> DataFrame:
    """The columns of ``schema`` after a column ``number``; rows are read by many tasks.

    For files by the usual rules: lines end with a line feed (a carriage return before it is
    left out), values that hold quotes, commas or line breaks are quoted, a quote in them is
    doubled. A quote mark elsewhere is an error and never a wrong row. Empty lines are
    left out, an empty file or folder gives no row. The records are written once to the
    shared folder, so the numbers and the rows come from the same reading.
    """
    records = numbered_records(spark, path).where(F.col("_place") > 0)
    text = F.regexp_replace("_record", "\r$", "")
    own = {k: str(v) for k, v in options.items() if k in ("quote", "escape")}
    parsed = records.select("_number", F.from_csv(text, schema.toDDL(), own).alias("_row"))
    return parsed.select(
        F.col("_number").cast("bigint").alias(number), *[F.col("_row")[f.name].alias(f.name) for f in schema]
    )
