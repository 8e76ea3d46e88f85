import math
import random
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from surveytab.functions.exact import added, parts, total, whole_parts
from surveytab.operators.crosstab import cross_single
from surveytab.operators.frequency import frequencies
from surveytab.plans.report import build_report, report_spec

from .conftest import as_dict


def grid(value: float) -> Fraction:
    """The value on the grid, as a fraction."""
    whole = math.floor(value)
    return whole + Fraction(round(Fraction((value - whole)) * 2**52), 2**52)


@pytest.fixture(scope="module")
def weights():
    rng = random.Random(7)
    values = [rng.lognormvariate(0, 3) for _ in range(2_000)] + [-rng.random() for _ in range(300)]
    return values + [0.1] * 500 + [1e9 / 3] * 20 + [0.0, -0.0, 2.0**40 + 0.25]


def test_sum_is_the_rounded_exact_sum(spark, weights):
    df = spark.createDataFrame([(w,) for w in weights] + [(None,)], "w double")
    found = df.repartition(7).agg(total(added(parts(F.col("w")))).alias("s")).first().s
    assert found == float(sum(map(grid, weights)))


def test_order_and_partitions_do_not_matter(spark, weights):
    df = spark.createDataFrame([(i % 3, w) for i, w in enumerate(weights)], "k int, w double")
    sums = set()
    for n in (1, 3, 11):
        table = frequencies(df.repartition(n).orderBy(F.rand(n)), ["k"], weight="w")
        sums.add(tuple(sorted((r.code, r.n_weighted, r.pct_weighted) for r in table.collect())))
    assert len(sums) == 1


def test_merging_partial_sums(spark):
    df = spark.createDataFrame([(1, 0.1), (1, 0.2), (2, 0.3), (2, None)], "k int, w double")
    merged = df.groupBy("k").agg(added(parts(F.col("w"))).alias("s")).agg(total(added("s")).alias("s"))
    assert merged.first().s == float(sum(map(grid, (0.1, 0.2, 0.3))))
    none = df.filter("w is null").agg(total(added(parts(F.col("w")))).alias("s")).first().s
    assert none is None
    assert df.agg(total(added(whole_parts(F.col("k")))).alias("s")).first().s == 6.0


def test_crosstab_and_report_too(spark, options, weights):
    rows = [(1 + i % 2, 1 + i % 3, abs(w)) for i, w in enumerate(weights)]
    df = spark.createDataFrame(rows, "v1 int, v5 int, w double")
    spec = report_spec(["Geral", "v1"], ["w", "w"], ["v5"])

    def results(n):
        part = df.repartition(n)
        cross = cross_single(part, options, [("v1", "v5")], "w")
        report = build_report(part, options, spec).frequencies
        return (
            as_dict(cross, ["row_code", "col_code"], ["n_weighted"], 30),
            as_dict(report, ["split_id", "code"], ["n_weighted"], 30),
        )

    assert results(1) == results(5) == results(9)
