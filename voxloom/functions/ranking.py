"""Numbering and quantiles that never put one group into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from voxloom.session import stored

BUCKET_ROWS = 1 << 18


def id_bucket(col: Column | str, rows: int = BUCKET_ROWS) -> Column:
    """Bucket of a unique id: at most ``rows`` ids share one."""
    return F.floor(F.col(col) / rows if isinstance(col, str) else col / rows)


def number_rows(
    df: DataFrame,
    order: list[str],
    buckets: dict[str, Column],
    within: list[str] | None = None,
    out: str = "rank",
) -> DataFrame:
    """Consecutive numbers 1.. in ``order``, overall or inside ``within``.

    ``buckets`` are named expressions that follow the order (a prefix of the
    order columns, ids divided by a width) and bound the rows that share their
    values. Rows are numbered inside a bucket, and the running total of the
    bucket sizes, a table of one row per bucket, gives each bucket its start.
    So a group that holds a third of all rows is still spread over many tasks.
    """
    within = within or []
    names = {name: f"_b_{name}" for name in buckets}
    for name, expr in buckets.items():
        df = df.withColumn(names[name], expr)
    keys = within + list(names.values())
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_size"))
    before = W.partitionBy(*within).orderBy(*names.values()).rowsBetween(
        W.unboundedPreceding, -1
    )
    starts = sizes.select(
        *keys, F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_start")
    )
    numbered = df.withColumn("_rn", F.row_number().over(W.partitionBy(*keys).orderBy(*order)))
    return (
        numbered.join(starts, keys)
        .withColumn(out, (F.col("_start") + F.col("_rn")).cast("bigint"))
        .drop("_rn", "_start", *names.values())
    )


def _ranks(probabilities: list[float], count: Column) -> Column:
    """The ranks (from 0) on both sides of every asked position among ``count`` values."""
    positions = [(count - 1) * F.lit(float(p)) for p in probabilities]
    return F.array(*[f(p).cast("bigint") for p in positions for f in (F.floor, F.ceil)])


def rank_slices(
    df: DataFrame,
    value: str,
    probabilities: list[float],
    by: list[str],
    slice_rows: int = BUCKET_ROWS,
    levels: int = 7,
) -> DataFrame:
    """Distinct values that may hold an asked rank, in slices of at most ``slice_rows``.

    Output: the ``by`` columns, ``_n`` (values of the group), ``_start`` (values before the
    slice, which names it), ``_v`` and ``_c`` (a distinct value and how often it occurs).

    Equal values are counted first, so a hot value is one row. Each round cuts the slices
    that are left at their own approximate quantiles, which only steer the split, counts the
    values of the parts exactly, and keeps the parts that hold an asked rank: about one of
    ``2 ** levels`` for each. So 10^12 distinct values take four rounds, and a group of at
    most ``slice_rows`` values none. The driver reads one number a round.
    """
    known = df.where(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("_v"))
    totals = known.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    counts = known.groupBy(*by, "_v").agg(F.count(F.lit(1)).alias("_c"))

    def joined(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
        """Inner join on keys that may be null."""
        renamed = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
        same = F.lit(True)
        for k in keys:
            same = same & left[k].eqNullSafe(renamed[f"_r_{k}"])
        return left.join(renamed, same).drop(*[f"_r_{k}" for k in keys])

    largest = totals.agg(F.max("_n")).first()[0] or 0
    if by:
        left = joined(counts, totals, by)
    else:
        left = counts.withColumn("_n", F.lit(largest))
    left = left.withColumn("_start", F.lit(0).cast("bigint"))
    slice_of = [*by, "_start"]
    grid = [i / (1 << levels) for i in range(1, 1 << levels)]
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(levels))])

    def descend(position: Column, step: Column) -> Column:
        below = F.get(F.col("_cuts"), position + step - 1) < F.col("_v")
        return F.when(below, position + step).otherwise(position)

    while largest > slice_rows:
        left = stored(left)
        size = left.groupBy(*slice_of).count().agg(F.max("count")).first()[0]
        if size <= slice_rows:
            break
        cuts = left.groupBy(*slice_of).agg(F.percentile_approx("_v", grid, 10_000).alias("_cuts"))
        # Binary search: how many cuts lie below the value.
        parts = joined(left, cuts, slice_of).withColumn(
            "_part", F.aggregate(steps, F.lit(0), descend)
        )
        parts = parts.drop("_cuts")
        before = W.partitionBy(*slice_of).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
        sums = parts.groupBy(*slice_of, "_n", "_part").agg(F.sum("_c").alias("_t"))
        sums = sums.withColumn("_from", F.col("_start") + F.coalesce(F.sum("_t").over(before), F.lit(0)))
        asked = F.exists(
            _ranks(probabilities, F.col("_n")),
            lambda r: (r >= F.col("_from")) & (r < F.col("_from") + F.col("_t")),
        )
        kept = sums.where(asked).select(*slice_of, "_part", "_from")
        left = joined(parts, kept, [*slice_of, "_part"]).select(
            *by, "_n", F.col("_from").alias("_start"), "_v", "_c"
        )
        largest = size
    return left


def exact_quantiles(
    df: DataFrame,
    value: str,
    probabilities: list[float],
    by: list[str] | None = None,
    slice_rows: int = BUCKET_ROWS,
) -> DataFrame:
    """Exact quantiles with linear interpolation, one row per group.

    Only slices that hold an asked rank are sorted (``rank_slices``), each of at most
    ``slice_rows`` distinct values. Nulls take no part; a null ``by`` value is a group.
    Output: the ``by`` columns and ``quantiles``, an array in the order given.
    """
    by = by or []
    slices = rank_slices(df, value, probabilities, by, slice_rows)
    in_slice = W.partitionBy(*by, "_start").orderBy("_v").rowsBetween(W.unboundedPreceding, 0)
    ranked = slices.withColumn("_end", F.col("_start") + F.sum("_c").over(in_slice)).withColumn(
        "_begin", F.col("_end") - F.col("_c")
    )

    def at(rank: Column) -> Column:
        hit = (F.col("_begin") <= rank) & (rank < F.col("_end"))
        return F.max(F.when(hit, F.col("_v")))

    parts = []
    for i, p in enumerate(probabilities):
        position = (F.col("_n") - 1) * F.lit(float(p))
        parts += [
            at(F.floor(position)).alias(f"_lo{i}"),
            at(F.ceil(position)).alias(f"_hi{i}"),
            F.max(position - F.floor(position)).alias(f"_f{i}"),
        ]
    picked = ranked.groupBy(*by).agg(*parts)
    values = [
        F.col(f"_lo{i}") + (F.col(f"_hi{i}") - F.col(f"_lo{i}")) * F.col(f"_f{i}")
        for i in range(len(probabilities))
    ]
    return picked.select(*by, F.array(*values).alias("quantiles"))
