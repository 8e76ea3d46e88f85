import math
import re

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from surveytab.operators.trimmed import rows_trimmed, trimmed_means, trimmed_means_by


def tiles(n, of=100):
    """Tile of each of n sorted rows; the first tiles are the larger ones."""
    size, larger = divmod(n, of)
    return [t for t in range(1, of + 1) for _ in range(size + (t <= larger))]


@pytest.mark.parametrize("n", [*range(0, 450), 997, 1003, 4999])
def test_rows_trimmed_equals_trimming_twice_by_tiles(n):
    kept = [i for i, t in enumerate(tiles(n)) if t <= 97.5]
    kept = [i for i, t in zip(kept, tiles(len(kept))) if t >= 2.5]
    bottom, top = rows_trimmed(n)
    assert kept == list(range(bottom, n - top))


def by_tiles(df, value, keys):
    """The same by two ntile windows over everything; for small data only."""
    order = Window.partitionBy(F.lit(1)).orderBy("x", *keys)
    rows = df.select(F.col(value).cast("double").alias("x"), "w", *keys).filter("x is not null")
    rows = rows.withColumn("t", F.ntile(100).over(order)).filter("t <= 97.5")
    rows = rows.withColumn("t", F.ntile(100).over(order)).filter("t >= 2.5")
    return rows.agg(
        F.count(F.lit(1)).alias("n"), F.sum("w").alias("n_weighted"), F.avg("x").alias("mean")
    ).first()


@pytest.fixture(scope="module")
def data(spark):
    return spark.range(6000).select(
        "id",
        (F.col("id") % 11).cast("int").alias("k"),
        (1 + F.col("id") % 5).cast("double").alias("w"),
        F.randn(3).alias("spread"),
        (F.col("id") % 4).alias("few"),
        F.when(F.rand(5) < 0.34, 50.0).otherwise(F.rand(6) * 100).alias("hot"),
        F.when(F.rand(7) < 0.99, 1.0).otherwise(F.randn(8)).alias("nearly_constant"),
        F.when(F.col("id") % 3 > 0, F.lit(2.0)).alias("constant"),
        F.lit(None).cast("double").alias("nothing"),
    ).cache()


@pytest.mark.parametrize(
    "value, sortable, accuracy",
    [
        ("spread", 10**6, 10**4), ("hot", 10**6, 10**4),
        *[(v, 100, 100) for v in ("spread", "few", "hot", "nearly_constant", "constant")],
        ("few", 1, 10), ("hot", 1, 10),
    ],
)
def test_search_equals_tiles(data, value, sortable, accuracy):
    expected = by_tiles(data, value, ["k", "id"])
    got = trimmed_means(
        data, [value], ["k", "id"], "w", na_codes=(), sortable=sortable, accuracy=accuracy
    ).first()
    assert (got.n, got.n_weighted) == (expected.n, expected.n_weighted)
    assert math.isclose(got.mean, expected.mean, rel_tol=1e-12, abs_tol=1e-12)


def test_several_variables_at_once(data):
    names = ["spread", "few", "hot", "nothing"]
    got = {
        r.variable: r
        for r in trimmed_means(data, names, ["id"], "w", na_codes=(), sortable=50).collect()
    }
    for name in names[:3]:
        expected = by_tiles(data, name, ["id"])
        assert (got[name].n, got[name].n_weighted) == (expected.n, expected.n_weighted)
    assert (got["nothing"].n, got["nothing"].mean) == (0, None)


@pytest.mark.parametrize("rows", [0, 1, 3, 99, 101])
def test_few_rows(data, rows):
    got = trimmed_means(data.filter(F.col("id") < rows), ["spread"], ["id"], "w").first()
    bottom, top = rows_trimmed(rows)
    assert got.n == rows - bottom - top


def test_large_and_negative_tie_breakers(data):
    far = data.withColumn("big", (F.lit(1 << 62) - F.col("id") * (1 << 33)) * F.when(
        F.col("id") % 2 == 0, 1).otherwise(-1))
    expected = by_tiles(far, "few", ["big"])
    got = trimmed_means(far, ["few"], ["big"], "w", na_codes=(), sortable=20, accuracy=20).first()
    assert (got.n, got.n_weighted) == (expected.n, expected.n_weighted)


def test_dates_and_times_break_ties(data):
    timed = data.select(
        "*", F.timestamp_seconds("id").alias("at"), F.date_from_unix_date(F.col("id").cast("int")).alias("on")
    )
    expected = by_tiles(timed, "few", ["id"])
    timed = timed.select(
        "*", F.expr("cast(at as timestamp_ntz) as ntz"),
        (F.col("id").cast("decimal(12,2)") / 4 - 100).cast("decimal(14,2)").alias("price"),
    )
    for key in ("at", "on", "ntz", "price"):
        got = trimmed_means(timed, ["few"], [key], "w", na_codes=(), sortable=100).first()
        assert (got.n, got.n_weighted) == (expected.n, expected.n_weighted)


def test_ties_that_cannot_be_broken(data):
    for sortable in (10**6, 10):
        with pytest.raises(ValueError, match="tell the rows"):
            trimmed_means(data, ["few"], ["k"], "w", sortable=sortable)
    with pytest.raises(ValueError, match="cannot order by"):
        trimmed_means(data.withColumn("s", F.col("id").cast("string")), ["few"], ["s"], "w")


def test_a_missing_tie_breaker_is_an_error(data):
    some = data.withColumn("key", F.when(F.col("id") != 5, F.col("id")))
    with pytest.raises(Exception, match="null in the tie-breaking column key"):
        trimmed_means(some, ["few"], ["key"], "w").collect()


def test_survey_figures(spark):
    from workload.inputs import TIE_KEY, survey

    df = survey(spark, "/root/testdata/sf0.01")
    got = trimmed_means(df, ["v30m"], TIE_KEY, "weight").first()
    assert (got.n, got.n_weighted) == (51454, 1307726.0)
    assert round(got.mean, 4) == 52515.6488 and round(got.mean_weighted, 4) == 52636.5949


def test_few_looks_and_bounds_that_reach_the_source(spark, tmp_path, monkeypatch):
    """What is read between the first look and the last is a few rows around the cuts."""
    from pyspark.sql.classic.dataframe import DataFrame

    path = str(tmp_path / "t")
    spark.range(60_000).selectExpr("id", "cast(hash(id) as double) as x").write.parquet(path)
    df, looks, collect = spark.read.parquet(path), [], DataFrame.collect

    def counted(self):
        looks.append(self._jdf.queryExecution().executedPlan().toString())
        return collect(self)

    monkeypatch.setattr(DataFrame, "collect", counted)
    got = trimmed_means(df, ["x"], ["id"], na_codes=(), sortable=1000, accuracy=1000)
    monkeypatch.undo()
    assert len(looks) <= 3
    assert "LessThan(x," in looks[-1] and "Expand" not in looks[-1]
    assert got.first().n == 60_000 - sum(rows_trimmed(60_000))


@pytest.mark.parametrize("sortable", [10**6, 40])
def test_by_split_equals_each_split_alone(data, sortable):
    names = ["spread", "hot", "few"]
    found = trimmed_means_by(data, names, "k", ["id"], "w", na_codes=(), sortable=sortable, accuracy=100, splits=[0, 3, 7, 99])
    got = {(r.split, r.variable): r for r in found.collect()}
    assert len(got) == 12
    for code in (0, 3, 7):
        for name in names:
            expected = by_tiles(data.filter(F.col("k") == code), name, ["id"])
            r = got[str(code), name]
            assert (r.n, r.n_weighted) == (expected.n, expected.n_weighted)
            assert math.isclose(r.mean, expected.mean, rel_tol=1e-12, abs_tol=1e-12)
    assert (got["99", "few"].n, got["99", "few"].mean) == (0, None)


def test_by_all_splits_found(data):
    some = data.withColumn("s", F.when(F.col("id") % 5 > 0, F.concat(F.lit("s"), F.col("id") % 5)))
    got = {r.split: r.n for r in trimmed_means_by(some, ["spread"], "s", ["id"]).collect()}
    assert got == {f"s{i}": 1200 - sum(rows_trimmed(1200)) for i in range(1, 5)}
    with pytest.raises(ValueError, match="no codes"):
        trimmed_means_by(some.filter("s is null"), ["spread"], "s", ["id"])


TYPES = {
    "int": "cast(hash(id) % 100000 as int)", "bigint": "9007199254740992L + hash(id) % 1000", "smallint": "cast(id % 3000 as smallint)",
    "decimal": "cast((hash(id) % 100000) / 8 as decimal(12,2))", "double": "cast(hash(id) as double)",
}


@pytest.mark.parametrize("kind", list(TYPES))
def test_bounds_reach_the_source_for_numbers_of_all_types(spark, tmp_path, monkeypatch, kind):
    from pyspark.sql.classic.dataframe import DataFrame

    path = str(tmp_path / "t")
    spark.range(20_000).selectExpr("id", f"{TYPES[kind]} as x", "1.0D as w").write.parquet(path)
    df, looks, collect = spark.read.parquet(path), [], DataFrame.collect

    def counted(self):
        looks.append(self._jdf.queryExecution().executedPlan().toString())
        return collect(self)

    monkeypatch.setattr(DataFrame, "collect", counted)
    found = trimmed_means(df, ["x"], ["id"], "w", na_codes=(), sortable=1000, accuracy=1000)
    monkeypatch.undo()
    assert re.search(r"PushedFilters: .*(Less|Greater)Than\w*\(x,", looks[-1])
    expected, got = by_tiles(df, "x", ["id"]), found.first()
    assert (got.n, got.n_weighted) == (expected.n, expected.n_weighted)
    assert math.isclose(got.mean, expected.mean, rel_tol=1e-10)


def test_many_measures_take_few_looks(spark, monkeypatch):
    """A hundred variables of four types, in which 30 % of the answers are equal, in as many looks as one."""
    from pyspark.sql.classic.dataframe import DataFrame

    kinds = ["int", "bigint", "decimal(12,2)", "double"]
    df = spark.range(4_000).select("id", *[
        F.when(F.rand(i) < 0.3, 40).otherwise(F.rand(1000 + i) * 1000).cast(kinds[i % 4]).alias(f"x{i}") for i in range(100)
    ]).cache()
    df.count()
    looks, collect = [], DataFrame.collect
    monkeypatch.setattr(DataFrame, "collect", lambda self: looks.append(1) or collect(self))
    found = trimmed_means(df, [f"x{i}" for i in range(100)], ["id"], na_codes=(), sortable=4_000)
    monkeypatch.undo()
    assert len(looks) <= 3
    got = {r.variable: r.n for r in found.collect()}
    assert set(got.values()) == {4_000 - sum(rows_trimmed(4_000))} and len(got) == 100
