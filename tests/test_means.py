import math

import pytest
from pyspark.sql import functions as F

from surveytab.operators.crosstab import in_dictionary_order
from surveytab.operators.means import (
    cross_means,
    mean_statistics,
    means,
    merge_partial_means,
    partial_columns,
)
from tests.conftest import as_dict

STATISTICS = (
    "mean", "mean_weighted", "n", "n_weighted", "sd", "sd_weighted", "error", "error_weighted",
)


def test_means(interviews):
    assert as_dict(means(interviews, ["v30m"], "w"), ("variable",), STATISTICS) == {
        ("v30m",): (20.0, 21.1111, 4, 5.0, 10.0, 8.3571, 5.0, 4.1786)
    }


def test_means_by_code(interviews, options):
    table = cross_means(interviews, options, [("v1", "v30m")], "w")
    assert as_dict(table, ("col_code",), STATISTICS) == {
        ("1",): (20.0, 22.0, 2, 2.5, 14.1421, 12.6491, 10.0, 8.9443),
        ("2",): (20.0, 20.0, 1, 2.0, None, 0.0, None, 0.0),
        (None,): (None, None, 1, 0.5, None, None, None, None),
    }
    assert [r.col_code for r in in_dictionary_order(table).collect()] == ["1", "2", None]


def test_codes_outside_the_dictionary_join_the_null_category(interviews, options):
    listed = options.filter("not (variable = 'v1' and code = '1')")
    table = cross_means(interviews, listed, [("v1", "v30m")], "w")
    got = as_dict(table, ("col_code",), STATISTICS)
    assert got[(None,)] == (20.0, 22.0, 3, 3.0, 14.1421, 12.6491, 8.165, 7.303)


def test_nothing_to_average(interviews):
    got = as_dict(means(interviews.filter("false"), ["v30m"], "w"), ("variable",), STATISTICS)
    assert got == {("v30m",): (None, None, 0, 0.0, None, None, None, None)}
    got = as_dict(means(interviews.filter("id = 3"), ["v30m"], "w"), ("variable",), STATISTICS)
    assert got == {("v30m",): (None, None, 1, 0.5, None, None, None, None)}


def test_zero_weights(interviews):
    got = as_dict(
        means(interviews.withColumn("w", F.lit(0.0)), ["v30m"], "w"), ("variable",), STATISTICS
    )[("v30m",)]
    assert got[:4] == (20.0, None, 4, 0.0) and got[5] is None


def test_other_codes_for_no_answer(interviews):
    got = as_dict(means(interviews, ["v30m"], "w", na_codes=(10, -99)), ("variable",), STATISTICS)
    assert got[("v30m",)][0] == 25.0
    got = as_dict(means(interviews, ["v30m"], "w", na_codes=()), ("variable",), STATISTICS)
    assert got[("v30m",)][0] == -9.75


@pytest.fixture(scope="module")
def samples(spark):
    return spark.range(20000).select(
        (F.rand(1) * 10 + 0.1).alias("w"), (F.randn(2) * 3).alias("z"), (F.col("id") % 7).alias("g")
    ).cache()


@pytest.mark.parametrize("offset", [0.0, 1e6, 1e9])
def test_deviations_keep_their_digits(samples, offset):
    """Weights that go with the answers, as the weights of a survey may."""
    df = samples.select((F.col("w") + F.col("z") + 20).alias("w"), "g", (F.col("z") + offset).alias("x"))
    m = df.select((F.sum(F.col("w") * F.col("x")) / F.sum("w")).alias("m")).first()["m"]
    expected = df.select(
        F.sqrt(F.sum(F.col("w") * (F.col("x") - m) ** 2) / (F.sum("w") - 1)).alias("s")
    ).first()["s"]
    one = means(df, ["x"], "w", na_codes=()).first()
    assert math.isclose(one.sd_weighted, expected, rel_tol=1e-10)
    assert math.isclose(one.mean_weighted, m, rel_tol=1e-14, abs_tol=1e-13)
    partial = df.groupBy("g").agg(*partial_columns(F.col("x"), F.col("w")))
    merged = merge_partial_means(partial.withColumn("k", F.lit(1)), ["k"])
    both = merged.select(*mean_statistics()).first()
    for name in STATISTICS:
        assert math.isclose(both[name], one[name], rel_tol=1e-6), name


def test_weight_one_makes_weighted_equal_plain(samples):
    got = means(samples, ["z"], na_codes=()).first()
    for a, b in (("mean", "mean_weighted"), ("sd", "sd_weighted"), ("error", "error_weighted")):
        assert math.isclose(got[a], got[b], rel_tol=1e-9)
