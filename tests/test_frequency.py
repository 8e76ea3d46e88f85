import pytest
from pyspark.sql import functions as F

from surveytab.operators.frequency import (
    frequencies,
    in_table_order,
    mentioned_frequencies,
    multiple_frequencies,
    single_frequencies,
)
from tests.conftest import as_dict

MEASURES = ("n", "n_weighted", "pct", "pct_weighted")


def lines(table, keys=("code",)):
    return as_dict(table, keys, MEASURES)


def test_single(interviews):
    assert lines(single_frequencies(interviews, ["v1"], "w")) == {
        ("1",): (2, 2.5, 66.6667, 55.5556),
        ("2",): (1, 2.0, 33.3333, 44.4444),
        ("Total",): (3, 4.5, 100.0, 100.0),
        ("Base",): (3, 4.5, 75.0, 90.0),
    }


def test_multiple_counts_mentions_and_persons(interviews):
    assert lines(multiple_frequencies(interviews, {"v5": ["v5_1", "v5_2"]}, "w")) == {
        ("1",): (3, 5.0, 60.0, 66.6667),
        ("2",): (1, 1.0, 20.0, 13.3333),
        ("3",): (1, 1.5, 20.0, 20.0),
        ("Total",): (5, 7.5, 100.0, 100.0),
        ("Base",): (3, 4.5, 75.0, 90.0),
    }


def test_mentioned_is_over_persons(interviews):
    assert lines(mentioned_frequencies(interviews, {"g": ["v19", "v20"]}, "w")) == {
        ("v19",): (2, 3.0, 66.6667, 66.6667),
        ("v20",): (1, 2.0, 33.3333, 44.4444),
        ("Total",): (3, 5.0, 100.0, 111.1111),
        ("Base",): (3, 4.5, 75.0, 90.0),
    }


def test_all_kinds_equal_each_alone(interviews):
    together = lines(
        frequencies(interviews, ["v1"], {"v5": ["v5_1", "v5_2"]}, {"g": ["v19", "v20"]}, "w"),
        ("variable", "code"),
    )
    alone = {}
    for table in (
        single_frequencies(interviews, ["v1"], "w"),
        multiple_frequencies(interviews, {"v5": ["v5_1", "v5_2"]}, "w"),
        mentioned_frequencies(interviews, {"g": ["v19", "v20"]}, "w"),
    ):
        alone |= lines(table, ("variable", "code"))
    assert together == alone


def test_unweighted_weighs_one(interviews):
    for n, n_weighted, pct, pct_weighted in lines(single_frequencies(interviews, ["v1"])).values():
        assert (n, pct) == (n_weighted, pct_weighted)


@pytest.mark.parametrize("case", ["no answers", "no rows", "nothing mentioned"])
def test_empty_tables_have_null_total_and_base(interviews, case):
    if case == "no answers":
        table = single_frequencies(interviews.withColumn("v1", F.lit(None).cast("int")), ["v1"], "w")
    elif case == "no rows":
        table = multiple_frequencies(interviews.filter("false"), {"v5": ["v5_1", "v5_2"]}, "w")
    else:
        nobody = interviews.withColumns({c: F.col(c) * 0 for c in ("v19", "v20")})
        table = mentioned_frequencies(nobody, {"g": ["v19", "v20"]}, "w")
    empty = (None,) * 4
    assert lines(table) == {("Total",): empty, ("Base",): empty}


def test_schema(interviews):
    table = single_frequencies(interviews, ["v1"], "w")
    assert table.dtypes == [
        ("variable", "string"), ("code", "string"), ("row_kind", "string"), ("row_order", "double"),
        ("n", "bigint"), ("n_weighted", "double"), ("pct", "double"), ("pct_weighted", "double"),
    ]


def test_order_is_numeric_then_total_then_base(spark):
    df = spark.createDataFrame([(c,) for c in (10, 2, -88, 2**40, 1)], "v bigint")
    codes = [r.code for r in in_table_order(single_frequencies(df, ["v"])).collect()]
    assert codes == ["-88", "1", "2", "10", str(2**40), "Total", "Base"]
    text = df.select(F.col("v").cast("string").alias("v"))
    codes = [r.code for r in in_table_order(single_frequencies(text, ["v"])).collect()]
    assert codes == ["-88", "1", "10", str(2**40), "2", "Total", "Base"]


def test_mixed_types_in_one_call_and_one_group(spark):
    df = spark.createDataFrame(
        [(1, 1.0, "1", True), (2, 2.5, "x", False), (None, float("nan"), None, None)],
        "a int, b double, c string, d boolean",
    )
    got = lines(frequencies(df, ["a", "b", "c", "d"], {"g": ["a", "b", "c"]}), ("variable", "code"))
    assert got[("g", "1")][:1] == (3,)
    assert got[("g", "2.5")][:1] == got[("g", "x")][:1] == (1,)
    assert got[("g", "Total")][:1] == (6,) and got[("g", "Base")] == (2, 2.0, 66.6667, 66.6667)
    assert got[("d", "0")][:1] == (1,)
    assert [got[(v, "Base")][0] for v in "abcd"] == [2, 2, 2, 2]


def test_mentions_of_every_type(spark):
    df = spark.createDataFrame(
        [(1, 1.0, "1", True), (0, 0.0, "0", False), (None, None, "2", None)],
        "a int, b double, c string, d boolean",
    )
    got = lines(mentioned_frequencies(df, {"g": ["a", "b", "c", "d"]}))
    assert {k: v[0] for k, v in got.items()} == {
        ("a",): 1, ("b",): 1, ("c",): 1, ("d",): 1, ("Total",): 4, ("Base",): 3,
    }


def test_names_that_look_internal_do_not_clash(spark):
    df = spark.createDataFrame([(1, 2, 3, 1.5)], "base_n int, code int, n int, n_weighted double")
    got = lines(single_frequencies(df, ["base_n", "code", "n"], "n_weighted"), ("variable", "code"))
    assert got[("n", "3")] == (1, 1.5, 100.0, 100.0)
    assert got[("code", "2")][0] == got[("base_n", "1")][0] == 1


def test_by_split(interviews):
    got = lines(single_frequencies(interviews, ["v1"], "w", by="v20"), ("split", "code"))
    assert got[("0", "1")] == (2, 2.5, 100.0, 100.0)
    assert got[("1", "Base")] == (1, 2.0, 100.0, 100.0)
    assert got[(None, "Total")] == (None,) * 4


def test_unnamed_groups_take_the_first_slot(interviews):
    table = multiple_frequencies(interviews, [["v5_1", "v5_2"]], "w")
    assert {r.variable for r in table.collect()} == {"v5mrg"}


def test_bad_arguments(interviews):
    with pytest.raises(ValueError, match="nope"):
        single_frequencies(interviews, ["nope"])
    with pytest.raises(ValueError, match="no variables"):
        frequencies(interviews)
    with pytest.raises(ValueError, match="name of its own"):
        frequencies(interviews, ["v1"], {"v1": ["v5_1"]})
    with pytest.raises(ValueError, match="at least one column"):
        multiple_frequencies(interviews, {"g": []})


def test_null_weight_raises_unless_ignored(interviews):
    some = interviews.withColumn("w", F.when(F.col("id") != 1, F.col("w")))
    with pytest.raises(Exception, match="null weight"):
        single_frequencies(some, ["v1"], "w").collect()
    got = lines(single_frequencies(some, ["v1"], "w", null_weight="ignore"))
    assert got[("1",)][:2] == (2, 1.5) and got[("Base",)][:2] == (3, 3.5)


def test_survey_figures(spark):
    """Figures computed beforehand for the interviews made from lineitem at sf0.01."""
    from workload.inputs import MENTIONS, SLOTS, survey

    df = survey(spark, "/root/testdata/sf0.01")
    got = lines(frequencies(df, ["v1"], SLOTS, MENTIONS, "weight"), ("variable", "code"))
    assert got[("v1", "1")] == (17152, 434099.0, 33.3684, 33.1972)
    assert got[("v1", "2")] == (17045, 436723.0, 33.1602, 33.3979)
    assert got[("v1", "3")] == (17205, 436816.0, 33.4715, 33.4050)
    assert got[("v1", "Base")] == (51402, 1307638.0, 85.67, 85.7954)
    v5 = [got[("v5", str(c))][:2] for c in range(1, 6)]
    assert v5 == [
        (16163, 521928.0), (16226, 520816.0), (16155, 528576.0), (12684, 374902.0),
        (12874, 384252.0),
    ]
    assert [got[("G019", c)][0] for c in ("v19", "v20", "v21", "Base")] == [
        41001, 17152, 10202, 51402,
    ]
