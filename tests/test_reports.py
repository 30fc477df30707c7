"""Report edge cases (C5 histogram bins, C9 normalisation before grouping)."""

import numpy as np
import pytest

from outcomelens.operators import reports as R


def test_histogram_single_value_gives_one_bin(spark):
    df = spark.createDataFrame([(10000.0,), (10000.0,)], "x double")
    rows = R.histogram(df, ["x"], 5000.0).collect()
    assert [(r.bin_start, r.n) for r in rows] == [(10000, 2)]


def test_histogram_last_bin_closed_and_empty_bins(spark):
    df = spark.createDataFrame([(1.0,), (20000.0,)], "x double")
    rows = sorted((r.bin_start, r.n) for r in R.histogram(df, ["x"], 5000.0).collect())
    assert rows == [(0, 1), (5000, 0), (10000, 0), (15000, 1)]


def test_common_configs_normalises_flags_first(spark):
    df = spark.createDataFrame([("A", "Yes", 1), ("A", "1", 0), ("A", "true", 1), ("B", "No", 0)],
                               "item string, flag_a string, label int")
    r = R.common_configs(df, ["item", "flag_a"], ["flag_a"], None).collect()
    assert [(x.item, x.flag_a, x.n, x.positives) for x in r] == [("A", "Yes", 3, 2)]


def test_histogram_of_an_outlier(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (1e9,), (-7e8,)], "x double")
    bins = R.histogram(df, ["x"], 5000.0)
    assert bins.count() == 340_000 and bins.agg({"n": "sum"}).first()[0] == 4
    assert bins.select("bin_start").distinct().count() == 340_000
    far = R.histogram(spark.createDataFrame([(1.0,), (2.0,), (1e14,)], "x double"), ["x"], 5000.0)
    assert far.limit(1000).count() == 1000  # of 20 thousand million rows, which nothing holds at once


def test_histogram_says_when_bins_can_not_be_listed(spark):
    df = spark.createDataFrame([(1.0,), (1e17,)], "x double")
    with pytest.raises(Exception, match="more than 1099511627776 bins"):
        R.histogram(df, ["x"], 5000.0).limit(1).collect()


def test_histogram_against_numpy(spark):
    rng = np.random.default_rng(3)
    for scale in (1e4, 3e5):
        x = np.round(rng.normal(size=300) * scale, 2)
        got = sorted((r.bin_start, r.n) for r in R.histogram(spark.createDataFrame([(float(v),) for v in x], "x double"), ["x"], 5000.0).collect())
        lo, hi = np.floor(x.min() / 5000) * 5000, np.ceil(x.max() / 5000) * 5000
        n, edges = np.histogram(x, np.arange(lo, hi + 1, 5000))
        assert got == [(int(e), int(k)) for e, k in zip(edges, n)]
