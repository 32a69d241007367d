"""Exact quantiles by descent: equal to numpy, and only bounded slices are sorted."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxloom.functions.ranking import exact_quantiles, rank_slices

ASKED = [0.0, 0.1, 0.25, 0.5, 0.75, 0.999, 1.0]


@pytest.fixture(scope="module")
def values(spark):
    """Skewed values of many sizes, a third of all rows equal, one group without a name."""
    row = F.col("id")
    x = F.when(row % 3 == 0, 7.5).otherwise(F.exp((F.hash("id") % 40_000) / 1_000.0))
    name = F.when(row % 10 < 7, "hot").when(row % 10 < 9, "b")
    return spark.range(20_000).select(name.alias("g"), x.alias("x"))


def test_slices_of_any_size_give_numpy_quantiles(values):
    everything = [r.x for r in values.collect()]
    want = np.quantile(everything, ASKED)
    for slice_rows in (60, 1_000, 1 << 18):
        got = exact_quantiles(values, "x", ASKED, slice_rows=slice_rows).first()[0]
        assert np.allclose(got, want, rtol=1e-12, atol=0)


def test_groups_and_a_group_without_a_name(values):
    by_name = {}
    for r in values.collect():
        by_name.setdefault(r.g, []).append(r.x)
    got = {r.g: r.quantiles for r in exact_quantiles(values, "x", ASKED, ["g"], slice_rows=60).collect()}
    assert set(got) == set(by_name) == {"hot", "b", None}
    for name, xs in by_name.items():
        assert np.allclose(got[name], np.quantile(xs, ASKED), rtol=1e-12, atol=0)


def test_few_rows_are_sorted(values):
    left = rank_slices(values, "x", ASKED, ["g"], slice_rows=60)
    sizes = [r["count"] for r in left.groupBy("g", "_start").count().collect()]
    assert max(sizes) <= 60
    # At most two slices for each asked rank and group.
    assert len(sizes) <= 2 * len(ASKED) * 3


def test_no_values(spark):
    empty = spark.createDataFrame([("a", None)], "g string, x double")
    assert exact_quantiles(empty, "x", [0.5], ["g"]).count() == 0
    assert exact_quantiles(empty.limit(0), "x", [0.5]).first()[0] == [None]
