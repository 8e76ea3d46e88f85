import decimal
from decimal import Decimal
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from surveytab.functions.codes import (
    any_answered,
    canonical_code,
    code_value,
    in_codes,
    literal_code,
    not_in_codes,
    null_codes,
    numeric_answer,
)
from surveytab.functions.frames import literal_rows, pick, weight_column
from surveytab.functions.names import (
    clean_names,
    group_name,
    names_a_mean,
    repair_names,
    without_mention_suffix,
)


@pytest.mark.parametrize(
    "kind, value, text",
    [
        ("int", 1, "1"),
        ("bigint", 12345678, "12345678"),
        ("double", 1.0, "1"),
        ("double", 12345678.0, "12345678"),
        ("double", -88.0, "-88"),
        ("double", 2.5, "2.5"),
        ("double", 1e300, "1.0E300"),
        ("double", float("inf"), "Infinity"),
        ("double", float("nan"), None),
        ("boolean", True, "1"),
        ("boolean", False, "0"),
        ("string", "01", "01"),
        ("decimal(10,2)", decimal.Decimal("1.00"), "1"),
        ("decimal(10,2)", decimal.Decimal("10.50"), "10.5"),
        ("decimal(10,0)", decimal.Decimal("100"), "100"),
        ("int", None, None),
    ],
)
def test_canonical_code(spark, kind, value, text):
    df = spark.createDataFrame([(value,)], f"x {kind}")
    assert df.select(canonical_code(df, "x").alias("c")).first()["c"] == text


def test_literals():
    assert [literal_code(v) for v in (1, 1.0, True, "1", -88, 2.5)] == [
        "1", "1", "1", "1", "-88", "2.5",
    ]


def test_membership_is_never_null(spark):
    df = spark.createDataFrame([(1,), (2,), (None,)], "x int")
    code = canonical_code(df, "x")
    rows = df.select(
        "x", in_codes(code, [2]).alias("i"), not_in_codes(code, [2.0]).alias("o"),
        in_codes(code, []).alias("e"),
    ).collect()
    assert [(r.i, r.o, r.e) for r in rows] == [
        (False, True, False), (True, False, False), (False, True, False),
    ]


def test_text_is_compared_with_numbers_as_text(spark):
    df = spark.createDataFrame([("1",), ("abc",), (None,)], "x string")
    kept = df.filter(not_in_codes(canonical_code(df, "x"), [1])).collect()
    assert [r.x for r in kept] == ["abc", None]
    nulled = df.select(null_codes(df, "x", ["abc"]).alias("x")).collect()
    assert [r.x for r in nulled] == ["1", None, None]


def test_numeric_answers(spark):
    df = spark.createDataFrame(
        [(1.5, "2"), (-88.0, "-99"), (float("nan"), None), (None, "3.5")], "x double, t string"
    )
    got = df.select(
        numeric_answer(df, "x", (-88, -99)).alias("x"), numeric_answer(df, "t", (-88, -99)).alias("t")
    ).collect()
    assert [(r.x, r.t) for r in got] == [(1.5, 2.0), (None, None), (None, None), (None, 3.5)]


def test_answered(spark):
    df = spark.createDataFrame(
        [(1, None, 2.0), (None, None, float("nan")), (None, "x", None)], "a int, b string, c double"
    )
    names = ["a", "b", "c"]
    got = df.select(any_answered(df, names).alias("any"))
    assert [r["any"] for r in got.collect()] == [True, False, True]


def test_odd_column_names(spark):
    df = spark.createDataFrame([(1, 2.0)], "`a.b` int, `c``d` double")
    row = df.select(canonical_code(df, "a.b").alias("x"), canonical_code(df, "c`d").alias("y"))
    assert tuple(row.first()) == ("1", "2")


def test_null_weights(spark):
    df = spark.createDataFrame([(1.0,), (None,)], "w double")
    total = df.select(F.sum(weight_column(df, "w", "ignore")).alias("t"))
    assert total.first()["t"] == 1.0
    with pytest.raises(Exception, match="null weight in column w"):
        df.select(weight_column(df, "w", "raise").alias("w")).collect()
    with pytest.raises(ValueError):
        weight_column(df, "w", "other")


def test_literal_rows_and_pick(spark):
    rows = [["it's", 1, None, 2.5], ["a\\b \"q\"", -(1 << 40), "é漢", float("inf")]]
    schema = {"a": "string", "b": "bigint", "c": "string", "d": "double"}
    assert [list(r) for r in literal_rows(spark, schema, rows).collect()] == rows
    assert literal_rows(spark, schema, []).count() == 0
    df = spark.range(2).select(pick(["x'y", None], "id", "string").alias("p"))
    assert [r.p for r in df.collect()] == ["x'y", None]


def test_names():
    assert clean_names(["n_Não sabe", "pct (%)", "1a", "a", "a", "nPeso", ""]) == [
        "n_nao_sabe", "pct_percent", "x1a", "a", "a_2", "n_peso", "x",
    ]
    assert repair_names(["id", "x", "id"]) == ["id...1", "x", "id...3"]
    assert group_name(["v5_1", "v5_2"]) == "v5mrg"
    assert group_name(["v5_1_2"]) == "v5_2mrg"
    assert names_a_mean("v20m") and not names_a_mean("v20")
    assert without_mention_suffix("v3_citou_citou") == "v3_citou"


def test_one_text_for_every_double(spark):
    values = [1e15, 2.0**53, -(2.0**60), 1e20, 1.25, -0.5, 12345678.5, 0.0001, 1e-7, 100.0, 0.001, 9999999.5]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = [r[0] for r in df.select(canonical_code(df, "v")).collect()]
    assert got == [literal_code(v) for v in values]
    assert got[:3] == ["1000000000000000", "9007199254740992", "-1152921504606846976"]


def test_text_with_settings_in_it_stays_as_it_is(spark):
    from surveytab.functions.frames import literal_rows, pick

    text = "price ${spark.app.name} $x \\ 'now'"
    assert literal_rows(spark, {"t": "string"}, [[text]]).first().t == text
    assert spark.range(1).select(pick([text], "id").alias("t")).first().t == text


def test_a_weight_that_is_no_number(spark):
    from surveytab.functions.frames import weight_column

    df = spark.createDataFrame([(1.0,), (float("nan"),), (None,)], "w double")
    assert [r[0] for r in df.select(weight_column(df, "w", "ignore")).collect()] == [1.0, 0.0, 0.0]
    with pytest.raises(Exception, match="null weight"):
        df.select(weight_column(df, "w", "raise")).collect()


def test_clean_names_are_never_given_twice():
    assert clean_names(["a", "a", "a_2"]) == ["a", "a_2", "a_2_2"]
    assert clean_names(["a_2", "a", "a", "a"]) == ["a_2", "a", "a_3", "a_4"]


def test_decimal_and_other_number_literals(spark):
    df = spark.createDataFrame([(Decimal("1.00"), 2.5), (Decimal("10.50"), 3.0)], "d decimal(6,2), x double")
    listed = [Decimal("1.00"), Decimal("1.05E+1")]
    assert [r[0] for r in df.select(in_codes(canonical_code(df, "d"), listed)).collect()] == [True, True]
    assert [r[0] for r in df.select(in_codes(canonical_code(df, "x"), [Decimal("2.500"), Fraction(3)])).collect()] == [True, True]
    assert [literal_code(v) for v in (Decimal("-0.0"), Decimal("100"), Decimal("1E+3"), np.int64(7), np.float32(0.5))] == [
        "0", "100", "1000", "7", "0.5"]


def test_code_values_stay_within_their_type():
    assert code_value("12345678901234567890", "bigint") is None and code_value("7", "bigint") == 7
    assert code_value("01", "bigint") is None and code_value("x", "double") is None and code_value("01", "string") == "01"
