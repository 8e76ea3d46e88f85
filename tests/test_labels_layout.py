import pytest
from pyspark.sql import functions as F

from surveytab.operators.frequency import (
    frequencies,
    mentioned_frequencies,
    multiple_frequencies,
    single_frequencies,
)
from surveytab.operators.labels import label_coded, label_mentioned
from surveytab.operators.layout import (
    layout_compare,
    layout_compare_blocks,
    layout_map,
    layout_tidy,
    layout_wide,
)
from tests.conftest import as_dict


@pytest.fixture(scope="module")
def single(interviews):
    return single_frequencies(interviews, ["v1"], "w")


def dictionary(spark, rows):
    return spark.createDataFrame(
        rows, "option_id int, variable string, code string, label string"
    )


def test_coded_labels(spark, single):
    words = dictionary(
        spark,
        [(9, "v1", "-99", "refused"), (1, "v1", "-88", "dk"), (5, "v1", "1", "one"),
         (2, "v1", "7", "never"), (3, "xv1", "2", "other variable"), (4, "v10", "2", "other")],
    )
    rows = label_coded(single, words, ["v1"]).orderBy("row_order").collect()
    assert [(r.code, r.label, r.n) for r in rows] == [
        ("7", "never", None), ("1", "one", 2), ("-88", "dk", None), ("-99", "refused", None),
        ("Total", "Total", 3), ("Base", "Base", 3),
    ]


def test_a_group_takes_the_options_of_its_slots(interviews, spark):
    words = dictionary(
        spark, [(1, "v5_1", "1", "a"), (2, "v5_2", "1", "a"), (3, "v5_2", "3", "c"),
                (4, "v5", "2", "b"), (5, "v55_1", "9", "no")],
    )
    table = multiple_frequencies(interviews, {"v5": ["v5_1", "v5_2"]}, "w")
    rows = label_coded(table, words, ["v5"]).orderBy("row_order").collect()
    assert [(r.code, r.label, r.n) for r in rows][:3] == [("1", "a", 3), ("3", "c", 1), ("2", "b", 1)]


def test_names_are_not_patterns(spark):
    df = spark.createDataFrame([(1,)], "`v.1` int")
    words = dictionary(spark, [(1, "v.1", "1", "one"), (2, "vx1", "2", "two")])
    table = single_frequencies(df, ["v.1"])
    assert [r.code for r in label_coded(table, words, ["v.1"]).orderBy("row_order").collect()] == [
        "1", "Total", "Base",
    ]


def test_label_faults(spark, single, interviews):
    words = dictionary(spark, [(1, "v1", "1", "one"), (2, "v1", "1", "uno")])
    with pytest.raises(Exception, match="two labels for code 1"):
        label_coded(single, words, ["v1"]).collect()
    with pytest.raises(Exception, match="not in the dictionary: v2"):
        label_coded(single, words.filter("label = 'one'"), ["v1", "v2"]).collect()


def test_labels_within_splits(spark, interviews):
    words = dictionary(spark, [(1, "v1", "1", "one"), (2, "v1", "2", "two"), (3, "v1", "9", "none")])
    table = label_coded(single_frequencies(interviews, ["v1"], "w", by="v20"), words, ["v1"])
    assert as_dict(table, ("split", "code"), ("label", "n")) == {
        ("0", "1"): ("one", 2), ("0", "2"): ("two", None), ("0", "9"): ("none", None),
        ("1", "1"): ("one", None), ("1", "2"): ("two", 1), ("1", "9"): ("none", None),
        (None, "1"): ("one", None), (None, "2"): ("two", None), (None, "9"): ("none", None),
        **{(s, c): (c, n) for s, n in (("0", 2), ("1", 1), (None, None)) for c in ("Total", "Base")},
    }
    wide = layout_compare(table)
    assert wide.columns[4:8] == ["label", "n_0", "n_1", "n_na"]
    texts = spark.createDataFrame(
        [("v19", "g", "Q19"), ("v20", "g", "Q20")],
        "variable string, question_number string, question_text string",
    )
    groups = mentioned_frequencies(interviews, {"g": ["v19", "v20"]}, by="v1")
    labelled = label_mentioned(groups, texts, ["g"])
    assert as_dict(labelled.filter("row_kind = 'code'"), ("split", "code"), ("label", "n")) == {
        ("1", "v19"): ("Q19", 1), ("2", "v19"): ("Q19", 1), ("2", "v20"): ("Q20", 1),
        (None, "v19"): ("Q19", None), (None, "v20"): ("Q20", None),
    }
    two = texts.union(texts.replace("Q19", "other"))
    with pytest.raises(Exception, match="two texts for option v19"):
        label_mentioned(groups, two, ["g"]).collect()


def test_what_is_not_listed_is_no_silent_loss(spark, single, interviews):
    with pytest.raises(Exception, match="code not listed: 2"):
        layout_wide(single, [1]).collect()
    assert layout_wide(single, [1], unlisted="drop").columns[2:] == ["row_order", "1", "Total", "Base"]
    assert layout_wide(single).columns[3:] == ["1", "2", "Total", "Base"]
    table = single_frequencies(interviews, ["v1"], "w", by="v20")
    with pytest.raises(Exception, match="split not listed: NA"):
        layout_compare(table, [0, 1]).collect()
    assert layout_compare(table, [0, 1, None]).columns[4:7] == ["n_0", "n_1", "n_na"]


def test_a_code_called_total(spark):
    df = spark.createDataFrame([("Total",), ("Total",), ("x",)], "v string")
    row = layout_wide(single_frequencies(df, ["v"])).filter("measure = 'n_weighted'").first()
    assert row.asDict() == {
        "variable": "v", "measure": "n_weighted", "row_order": 2, "Total...4": 2.0, "x": 1.0,
        "Total...6": 3.0, "Base": 3.0,
    }


def test_mentioned_labels(spark, interviews):
    texts = spark.createDataFrame(
        [("v19", "g", "Q19"), ("v20", "g", "Q20"), ("v21", "g", "Q21"), ("v19", "h", "Q19")],
        "variable string, question_number string, question_text string",
    )
    half = interviews.withColumn("v20", F.lit(0)).withColumn("other", F.lit(1))
    table = mentioned_frequencies(half, {"g": ["v19", "v20", "other"], "h": ["v20"]}, "w")
    rows = label_mentioned(table, texts, ["g", "h"]).orderBy("variable", "row_order", "code")
    assert [(r.variable, r.code, r.label, r.n) for r in rows.collect()] == [
        ("g", "v19", "Q19", 2), ("g", "Total", "Total", 6), ("g", "Base", "Base", 4),
        ("h", "v19", "Q19", None), ("h", "Total", "Total", None), ("h", "Base", "Base", None),
    ]


def test_tidy(single):
    names = ("n", "n_weighted", "pct", "pct_weighted", "total", "total_weighted", "pct_base",
             "pct_base_weighted")
    assert as_dict(layout_tidy(single), ("code",), names) == {
        ("1",): (2, 2.5, 66.6667, 55.5556, 3, 4.5, 75.0, 90.0),
        ("2",): (1, 2.0, 33.3333, 44.4444, 3, 4.5, 75.0, 90.0),
    }


def test_tidy_keeps_splits_apart(interviews):
    table = layout_tidy(single_frequencies(interviews, ["v1"], "w", by="v20"))
    assert as_dict(table, ("split", "code"), ("n", "total", "pct_base")) == {
        ("0", "1"): (2, 2, 100.0), ("1", "2"): (1, 1, 100.0),
    }


def test_wide(single):
    rows = layout_wide(single, [1, 2, 3]).orderBy("row_order").collect()
    assert [r.measure for r in rows] == ["pct_weighted", "n_weighted"]
    assert [round(rows[0][c], 4) for c in ("1", "2", "3", "Total", "Base")] == [
        55.5556, 44.4444, 0.0, 100.0, 90.0,
    ]
    assert [rows[1][c] for c in ("1", "2", "3", "Total", "Base")] == [2.5, 2.0, 0.0, 4.5, 4.5]


def test_wide_keeps_all_digits(spark):
    df = spark.createDataFrame([(1, 123456789.125)], "v int, w double")
    assert layout_wide(single_frequencies(df, ["v"], "w"), [1]).orderBy("row_order").collect()[1][
        "1"
    ] == 123456789.125


def test_compare(interviews):
    table = single_frequencies(interviews, ["v1"], "w", by="v20")
    wide = layout_compare(table, [0, 1, 5], unlisted="drop")
    assert wide.columns[4:10] == [
        "n_0", "n_1", "n_5", "n_weighted_0", "n_weighted_1", "n_weighted_5",
    ]
    assert as_dict(wide, ("code",), ("n_0", "n_1", "n_5", "pct_1")) == {
        ("1",): (2, 0, 0, 0.0), ("2",): (0, 1, 0, 100.0), ("Total",): (2, 1, 0, 100.0),
        ("Base",): (2, 1, 0, 100.0),
    }


def test_compare_cleans_names(spark):
    df = spark.createDataFrame([("São Paulo", 1), ("Rio", 1)], "city string, v int")
    wide = layout_compare(single_frequencies(df, ["v"], by="city"), ["São Paulo", "Rio"])
    assert wide.columns[4:6] == ["n_sao_paulo", "n_rio"]


def test_total_percent_is_100_for_coded_tables(interviews):
    table = frequencies(interviews, ["v1", "v19"], {"v5": ["v5_1", "v5_2"]}, weight="w")
    for r in table.filter("row_kind = 'total'").collect():
        assert (round(r.pct, 9), round(r.pct_weighted, 9)) == (100.0, 100.0)
    for r in table.filter("row_kind = 'base'").collect():
        assert r.n <= 4 and r.pct <= 100.0


def test_splits_that_differ_in_case_only(spark):
    df = spark.createDataFrame([("a", 1, 1.0), ("A", 1, 2.0), ("A", 2, 3.0), ("á", 2, 5.0)], "s string, v int, w double")
    table = layout_compare(single_frequencies(df, ["v"], "w", by="s"), ["a", "A", "á"])
    assert [c for c in table.columns if c.startswith("n_weighted")] == ["n_weighted_a", "n_weighted_a_2", "n_weighted_a_3"]
    found = {r.code: (r.n_weighted_a, r.n_weighted_a_2, r.n_weighted_a_3) for r in table.collect() if r.row_kind == "code"}
    assert found == {"1": (1.0, 2.0, 0.0), "2": (0.0, 3.0, 5.0)}
    every = layout_compare(single_frequencies(df, ["v"], "w", by="s"))
    assert len(every.columns) == len(table.columns)


def test_five_thousand_splits(spark):
    df = spark.range(20_000).selectExpr("id % 5000 as s", "if(id % 3 = 0, 1, 2) as v", "1.5D as w")
    table = single_frequencies(df, ["v"], "w", by="s")
    found = {r.code: r for r in layout_map(table).collect()}
    assert len(found["1"].n) + len(found["2"].n) > 5_000 and sum(found["1"].n.values()) == 6_667
    assert found["Total"].n == {str(i): 4 for i in range(5_000)}
    splits = layout_map(table).filter("row_kind = 'total'").select(F.map_keys("pct")).first()[0]
    assert splits == sorted(splits)
    with pytest.raises(ValueError, match="layout_map"):
        layout_compare(table)


def test_blocks_put_side_by_side_are_the_whole(spark):
    df = spark.createDataFrame([(s, v, 1.0) for s in "abcde" for v in range(ord(s) % 4)] + [(None, 9, 2.0)], "s string, v int, w double")
    table = single_frequencies(df, ["v"], "w", by="s")
    whole = layout_compare(table)
    keys = ["variable", "code", "row_kind", "row_order"]
    first, *others = layout_compare_blocks(table, width=2)
    assert len(others) == 2
    for other in others:
        first = first.join(other, keys)
    assert sorted(map(str, first.select(whole.columns).collect())) == sorted(map(str, whole.collect()))
    maps = {(r.code, s): n for r in layout_map(table).collect() for s, n in r.n.items()}
    flat = {(r.code, s): r[f"n_{s}"] for r in whole.collect() for s in "abce" if r[f"n_{s}"]}
    assert {k: n for k, n in maps.items() if n and k[1] != "NA"} == flat
