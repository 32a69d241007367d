"""Column expressions and numbering shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from voxloom.session import cut_lineage

SPACE = r"[\x20\x09-\x0D]+"
UNIT = float(1 << 53)


def words(text: Column) -> Column:
    """The ``[^\\x20\\x09-\\x0D]+`` words of a text in order; none if it is null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over a value that is computed once, inside a higher-order function."""
    return F.element_at(F.transform(F.array(value), body), 1)


def uniform(*parts: Column | str) -> Column:
    """A number in [0, 1) that depends on the parts alone."""
    return F.pmod(F.xxhash64(*parts), F.lit(1 << 53)) / F.lit(UNIT)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def number_all(df: DataFrame, order: list[Column], out: str, weight: Column | None = None):
    """Running numbers 0, 1, ... over a whole narrow table in ``order``.

    Rows are dealt by range, numbered inside their range, and the totals of the
    ranges, one row each, give every range its start; no task sees the whole
    table. With ``weight`` the number is the total weight of all rows before.
    """
    weight = F.lit(1) if weight is None else weight
    ranged = cut_lineage(
        df.withColumn("_weight", weight.cast("bigint"))
        .repartitionByRange(shuffle_partitions(df.sparkSession), *order)
        .withColumn("_range", F.spark_partition_id())
    )
    before = (W.unboundedPreceding, -1)
    totals = ranged.groupBy("_range").agg(F.sum("_weight").alias("_total"))
    starts = totals.select(
        "_range",
        F.coalesce(
            F.sum("_total").over(W.orderBy("_range").rowsBetween(*before)), F.lit(0)
        ).alias("_start"),
    )
    inside = W.partitionBy("_range").orderBy(*order).rowsBetween(*before)
    # One row per range, so at most spark.sql.shuffle.partitions rows.
    return (
        ranged.join(F.broadcast(starts), "_range")
        .withColumn(out, F.col("_start") + F.coalesce(F.sum("_weight").over(inside), F.lit(0)))
        .drop("_range", "_start", "_weight")
    )
