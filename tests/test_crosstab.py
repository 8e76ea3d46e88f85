import random
import re
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from surveytab.operators import crosstab, packs
from surveytab.operators.crosstab import cross_many, cross_multiple, cross_single, in_dictionary_order
from surveytab.operators.means import cross_means
from tests.conftest import as_dict

MEASURES = ("n", "n_weighted", "pct", "pct_weighted")


def cells(table, keys=("col_code", "row_code")):
    return as_dict(table, keys, MEASURES)


def test_single_by_single(interviews, options):
    table = cross_single(interviews, options, [("v1", "v19")], "w")
    assert cells(table) == {
        ("1", "0"): (1, 1.5, 50.0, 60.0),
        ("1", "1"): (1, 1.0, 50.0, 40.0),
        ("2", "1"): (1, 2.0, 100.0, 100.0),
        (None, None): (1, 0.5, 100.0, 100.0),
    }
    order = [(r.col_code, r.row_code) for r in in_dictionary_order(table).collect()]
    assert order == [("1", "0"), ("1", "1"), ("2", "1"), (None, None)]


def test_single_by_multiple_counts_empty_slots(interviews, options):
    table = cross_multiple(interviews, options, [("v1", "v5")], {"v5": ["v5_1", "v5_2"]}, "w")
    assert cells(table) == {
        ("1", "1"): (1, 1.0, 25.0, 20.0),
        ("1", "2"): (1, 1.0, 25.0, 20.0),
        ("1", "3"): (1, 1.5, 25.0, 30.0),
        ("1", None): (1, 1.5, 25.0, 30.0),
        ("2", "1"): (2, 4.0, 100.0, 100.0),
        (None, None): (2, 1.0, 100.0, 100.0),
    }


def test_codes_outside_the_dictionary(interviews, options):
    listed = options.filter("not (variable = 'v1' and code = '2')")
    got = cells(cross_single(interviews, listed, [("v1", "v19")], "w"))
    assert got[(None, "1")] == (1, 2.0, 50.0, 80.0)
    assert got[(None, None)] == (1, 0.5, 50.0, 20.0)


def test_many_pairs_at_once(interviews, options):
    pairs = [("v1", "v19"), ("v19", "v1")]
    both = cross_single(interviews, options, pairs, "w")
    for col, row in pairs:
        alone = cells(cross_single(interviews, options, [(col, row)], "w"))
        part = both.filter((F.col("col_variable") == col) & (F.col("row_variable") == row))
        assert cells(part) == alone


def test_mixed_types(interviews, options):
    text = interviews.withColumn("v19", F.col("v19").cast("string")).withColumn(
        "v1", F.col("v1").cast("double")
    )
    assert cells(cross_single(text, options, [("v1", "v19")], "w")) == cells(
        cross_single(interviews, options, [("v1", "v19")], "w")
    )


def test_shares_add_up_in_every_column(spark):
    from workload.inputs import survey, survey_options

    sf = "/root/testdata/sf0.001"
    table = cross_single(survey(spark, sf), survey_options(spark), [("v1", "v13")], "weight")
    sums = table.groupBy("col_code").agg(F.sum("pct").alias("a"), F.sum("pct_weighted").alias("b"))
    for r in sums.collect():
        assert round(r.a, 6) == round(r.b, 6) == 100.0


def test_bad_dictionary_and_arguments(interviews, options):
    twice = options.union(options.filter("variable = 'v1' and code = '1'"))
    with pytest.raises(Exception, match="listed twice in the dictionary: 1"):
        cross_single(interviews, twice, [("v1", "v19")], "w").collect()
    with pytest.raises(ValueError, match="groups without slots: v6"):
        cross_multiple(interviews, options, [("v1", "v6")], {"v5": ["v5_1"]}, "w")
    with pytest.raises(ValueError, match="nope"):
        cross_single(interviews, options, [("v1", "nope")], "w")


@pytest.fixture(scope="module")
def questionnaire(spark):
    """Questions of every type; some codes are not in the dictionary."""
    rng = random.Random(11)
    rows = [
        (rng.choice([1, 2, 3, None]), rng.choice([0.5, 1.0, 2.0, None]), rng.choice(["x", "y", "01", None]),
         Decimal(rng.choice(["1.00", "2.50"])), rng.choice([True, False, None]), rng.choice([1, 2]), rng.choice([2, 3, None]),
         rng.randint(1, 9) / 7)
        for _ in range(400)
    ]
    return spark.createDataFrame(
        rows, "a int, b double, c string, d decimal(5,2), e boolean, s1 int, s2 int, w double")


@pytest.fixture(scope="module")
def listed(spark):
    codes = {"a": "1 2 9", "b": "0.5 1", "c": "x 01", "d": "1 2.5", "e": "1 0", "g": "1 2 3", "long": " ".join(map(str, range(90)))}
    rows = [(i, v, c, c) for i, (v, c) in enumerate((v, c) for v, cs in codes.items() for c in cs.split())]
    return spark.createDataFrame(rows, "option_id int, variable string, code string, label string")


GROUPS = {"g": ["s1", "s2"]}
PAIRS = [(c, r) for c in "abcde" for r in ("a", "b", "c", "d", "e", "g")]


def one_by_one(df, options, pairs):
    """Every pair by itself, the older way."""
    out = []
    for pair in pairs:
        lines = [(pair[0], pair[1], slot) for slot in GROUPS.get(pair[1], [pair[1]])]
        out += crosstab._table(crosstab._count_lines(df, options, lines, "w", "raise"), options).collect()
    return sorted(map(str, out))


def test_many_pairs_equal_pair_by_pair(questionnaire, listed):
    found = cross_many(questionnaire, listed, PAIRS, GROUPS, "w")
    assert sorted(map(str, found.collect())) == one_by_one(questionnaire, listed, PAIRS)


def test_many_pairs_without_a_dictionary(questionnaire, listed):
    found = cross_many(questionnaire, None, PAIRS, GROUPS, "w")
    assert sorted(map(str, found.collect())) == one_by_one(questionnaire, None, PAIRS)


def test_long_dictionaries_and_several_names_of_a_column(spark, questionnaire, listed):
    df = questionnaire.withColumn("long", F.col("a") * 20)
    pairs = [("long", "a"), ("long", "b"), ("long", "long"), ("a", "long"), ("a", "a"), ("b", "c"), ("b", "g"), ("g", "a")]
    df = df.withColumn("g", F.col("s1"))
    found = cross_many(df, listed, pairs, GROUPS, "w")
    assert sorted(map(str, found.collect())) == one_by_one(df, listed, pairs)


def test_packs_hold_every_pair_and_cost_least():
    questions = [packs.Question(f"q{i}", f"q{i}", "bigint", tuple("123456789"[: 2 + i % 5])) for i in range(40)]
    pairs = [(i, j) for i in range(20) for j in range(20, 40)]
    chosen = packs.choose_packs(pairs, questions)
    assert sorted(p for pack in chosen for p in pack.pairs) == pairs
    assert all(set(p) <= set(pack.members) for pack in chosen for p in pack.pairs)
    singly = [packs.Pack(p, (p,)) for p in pairs]
    assert len(chosen) < len(pairs) / 3 and packs.cost(chosen, questions) < packs.cost(singly, questions) / 3
    every = [(i, j) for i in range(20) for j in range(20)]
    both = packs.choose_packs(every, questions)
    assert sorted(p for pack in both for p in pack.pairs) == every and len(both) < len(chosen)


def test_wide_questionnaire_scans_once_and_makes_few_lines(spark):
    from workload.inputs import wide_options, wide_survey
    from workload.queries import _all_pairs

    sf = "/root/testdata/sf0.001"
    df = wide_survey(spark, sf)
    counted = crosstab._count_packs(df, wide_options(spark), [(c, r, r) for c, r in _all_pairs()], "weight", "raise")
    counted.collect()
    assert len(_all_pairs()) == 400
    plan = counted._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("FileScan") == 1 and "Python" not in plan
    below = plan[re.search(r"Exchange hashpartitioning\(packed", plan).start():]
    assert "partial_count" in below.splitlines()[1]


def test_means_of_many_columns_equal_one_by_one(questionnaire, listed):
    pairs = [(c, x) for c in "abc" for x in ("w", "s2")]
    found = as_dict(cross_means(questionnaire, listed, pairs, "w"), ["mean_variable", "col_variable", "col_code"],
                    ["mean", "mean_weighted", "n", "n_weighted", "sd", "sd_weighted", "error_weighted"], 9)
    singly = {}
    for pair in pairs:
        singly |= as_dict(cross_means(questionnaire, listed, [pair], "w"), ["mean_variable", "col_variable", "col_code"],
                          ["mean", "mean_weighted", "n", "n_weighted", "sd", "sd_weighted", "error_weighted"], 9)
    assert found == singly
