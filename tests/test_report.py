import pytest
from pyspark.sql import functions as F

import surveytab.plans.report as report_module
from surveytab.operators.frequency import multiple_frequencies, single_frequencies
from surveytab.operators.means import means
from surveytab.plans.report import (
    build_report,
    report_spec,
    route_variables,
    split_options,
    write_report,
)
from tests.conftest import as_dict
from workload.inputs import REPORT_SPLITS, REPORT_WEIGHTS

V5 = {"v5": ["v5_1", "v5_2"]}


@pytest.fixture
def spec():
    return report_spec(["Geral", "v1", "v19"], ["w", None, "w"], ["v1"], V5, ["v30m"])


@pytest.fixture(params=[1000, 3], ids=["one pack", "a pack per split"])
def packing(request, monkeypatch):
    monkeypatch.setattr(report_module, "_MOST_COMBINATIONS", request.param)


@pytest.fixture(scope="module")
def survey_sf(spark):
    from workload.inputs import survey, survey_options

    sf = "/root/testdata/sf0.001"
    return survey(spark, sf), survey_options(spark)


def test_frequencies(interviews, options, spec, packing):
    table = build_report(interviews, options, spec).frequencies
    got = as_dict(
        table, ("split_id", "variable", "code"), ("n", "n_weighted", "pct", "pct_weighted")
    )
    assert got[(101, "v1", "1")] == (2, 2.5, 66.6667, 55.5556)
    assert got[(201, "v1", "1")] == (2, 2.0, 100.0, 100.0)
    assert got[(201, "v1", "2")] == (0, 0.0, 0.0, 0.0)
    assert got[(202, "v5", "1")] == (2, 2.0, 100.0, 100.0)
    assert got[(301, "v5", "3")] == (1, 1.5, 100.0, 100.0)
    assert len(got) == 5 * (2 + 3)


def test_bases(interviews, options, spec, packing):
    table = build_report(interviews, options, spec).bases
    got = as_dict(
        table, ("split_id", "variable"),
        ("total", "total_weighted", "pct_base", "pct_base_weighted", "respondents"),
    )
    assert got[(101, "v5")] == (5, 4.5, 125.0, 90.0, 3)
    assert got[(101, "v1")] == (3, 4.5, 75.0, 90.0, 3)
    assert got[(201, "v5")] == (3, 2.0, 75.0, 50.0, 2)
    assert got[(302, "v5")] == (4, 3.0, 100.0, 60.0, 2)
    assert len(got) == 5 * 2


def test_description(interviews, options, spec):
    rows = build_report(interviews, options, spec).description.orderBy("split_id").collect()
    assert [(r.split_id, r.split, r.option, r.weight) for r in rows] == [
        (101, "Geral", "Geral", "w"), (201, "v1", "1", "Sem Peso"), (202, "v1", "2", "Sem Peso"),
        (301, "v19", "0", "w"), (302, "v19", "1", "w"),
    ]
    later = report_spec(["Geral"], ["w"], ["X1"])
    assert report_module.report_description(options, later, 100).first().note == "FAZER DEPOIS"
    routed = report_spec(["Geral"], ["w"], **route_variables([["X5", "v5_1"], "v1"]))
    assert report_module.report_description(options, routed, 100).first().note == "FAZER DEPOIS"


def test_codes_outside_the_dictionary_stay(interviews, options, spec):
    listed = options.filter("not (variable = 'v5' and code = '3')")
    got = as_dict(
        build_report(interviews, listed, spec).frequencies,
        ("split_id", "variable", "code"), ("n",),
    )
    assert got[(101, "v5", "3")] == (1,) and got[(301, "v5", "3")] == (1,)
    assert (302, "v5", "3") not in got


def test_a_split_nobody_is_in(interviews, options, spec):
    nobody = interviews.filter("coalesce(v1, 0) <> 2")
    report = build_report(nobody, options, spec)
    base = as_dict(report.bases, ("split_id", "variable"), ("total", "total_weighted", "pct_base"))
    assert base[(202, "v1")] == (0, 0.0, 0.0)
    mean = as_dict(report.means, ("split_id",), ("n", "n_weighted", "mean"))
    assert mean[(202,)] == (0, 0.0, None)


def test_every_split_equals_its_own_filter(survey_sf, packing):
    df, options = survey_sf
    slots = {"v5": ["v5_1", "v5_2", "v5_3"]}
    spec = report_spec(REPORT_SPLITS, REPORT_WEIGHTS, ["v1"], slots, ["v30m"])
    report = build_report(df, options, spec)
    measures = ("n", "n_weighted", "pct", "pct_weighted")
    got = as_dict(report.frequencies.filter("n > 0"), ("split_id", "variable", "code"), measures)
    mean = as_dict(report.means, ("split_id",), ("mean", "n", "sd", "sd_weighted", "error_weighted"))
    expected, expected_means = {}, {}
    for option in split_options(options, spec):
        part = df if option.split_no == 1 else df.filter(
            F.col(option.split.variable) == int(option.code)
        )
        for table in (
            single_frequencies(part, ["v1"], option.split.weight),
            multiple_frequencies(part, slots, option.split.weight),
        ):
            lines = as_dict(table.filter("row_kind = 'code'"), ("variable", "code"), measures)
            expected |= {(option.split_id, *k): v for k, v in lines.items()}
        alone = as_dict(
            means(part, ["v30m"], option.split.weight), ("variable",),
            ("mean", "n", "sd", "sd_weighted", "error_weighted"),
        )
        expected_means[(option.split_id,)] = alone[("v30m",)]
    assert got == expected
    assert mean == expected_means


@pytest.mark.parametrize("kind", ["int", "double", "string", "decimal(4,1)"])
def test_split_codes_of_any_type(interviews, options, spec, kind):
    typed = interviews.withColumn("v1", F.col("v1").cast(kind))
    names = ("split_id", "variable", "code")
    assert as_dict(build_report(typed, options, spec).frequencies, names, ("n",)) == as_dict(
        build_report(interviews, options, spec).frequencies, names, ("n",)
    )


def test_written_report_equals_the_lazy_one(interviews, options, spec, tmp_path, spark):
    path = str(tmp_path / "report")
    write_report(interviews, options, spec, path)
    lazy = build_report(interviews, options, spec)
    for name, table in lazy.tables().items():
        saved = spark.read.parquet(f"{path}/{name}")
        assert saved.dtypes == table.dtypes
        key = [c for c in ("split_id", "variable", "code") if c in table.columns]
        assert saved.orderBy(*key).collect() == table.orderBy(*key).collect()
    with pytest.raises(Exception, match="(?i)already exists"):
        write_report(interviews, options, spec, path)


def test_null_weights(interviews, options, spec):
    some = interviews.withColumn("w", F.when(F.col("id") != 1, F.col("w")))
    with pytest.raises(Exception, match="null weight"):
        build_report(some, options, spec).bases.collect()
    ignoring = report_spec(["Geral"], ["w"], ["v1"], null_weight="ignore")
    got = as_dict(
        build_report(some, options, ignoring).bases, ("split_id",), ("total", "total_weighted")
    )
    assert got == {(101,): (3, 3.5)}


def test_spec_faults():
    with pytest.raises(ValueError, match="same length"):
        report_spec(["Geral", "v1"], ["w"], ["v1"])
    with pytest.raises(ValueError, match="first split"):
        report_spec(["v1", "Geral"], ["w", "w"], ["v1"])
    with pytest.raises(ValueError, match="twice"):
        report_spec(["Geral", "v1", "v1"], ["w", "w", "w"], ["v1"])
    with pytest.raises(ValueError, match="name of its own"):
        report_spec(["Geral"], [False], ["v5"], V5)
    assert report_spec(["Geral"], [False], ["v1"]).splits[0].weight is None


def test_split_faults(spark, interviews, options):
    spec = report_spec(["Geral", "v20"], ["w", "w"], ["v1"])
    with pytest.raises(ValueError, match="v20 has no options"):
        build_report(interviews, options, spec)
    missing = report_spec(["Geral", "zz"], ["w", "w"], ["v1"])
    with pytest.raises(ValueError, match="zz"):
        build_report(interviews, options.withColumn("variable", F.lit("zz")), missing)


def test_routing_by_shape():
    assert route_variables([["G41MRG", "v41", "v42"], "v1", "v20m", ["v3"]]) == {
        "singles": ["v1", "v3"], "multiples": {"G41MRG": ["v41", "v42"]}, "means": ["v20m"],
        "wanted": ["G41MRG", "v1", "v20m", "v3"],
    }


@pytest.mark.parametrize("kind", ["int", "string", "double"])
def test_a_split_of_many_options(spark, interviews, kind):
    many = spark.range(1, 251).selectExpr(
        "id as option_id", "'v20' as variable", "string(id - 1) as code", "'x' as label"
    ).union(spark.sql("select 999L, 'v20', cast(null as string), 'no code'"))
    many = many.unionByName(spark.sql(
        "select id as option_id, 'v1' as variable, string(id) as code, '' as label from range(1, 3)"))
    spec = report_spec(["Geral", "v20"], ["w", "w"], ["v1"], means=["v30m"])
    report = build_report(interviews.withColumn("v20", F.col("v20").cast(kind)), many, spec)
    got = as_dict(report.frequencies, ("split_id", "code"), ("n",))
    assert len(got) == 251 * 2
    assert got[(1001, "1")] == (2,) and got[(2001, "1")] == (2,) and got[(2002, "2")] == (1,)
    described = report.description.filter("split_id in (1001, 2001, 2250)").orderBy("split_id")
    assert [(r.split_no, r.option_no, r.option) for r in described.collect()] == [
        (1, 1, "Geral"), (2, 1, "0"), (2, 250, "249"),
    ]
    assert report.means.filter("split_id = 2001").first()["mean"] == 20.0


def test_writing_again(interviews, options, spec, tmp_path):
    path = str(tmp_path / "report")
    with pytest.raises(ValueError, match="mode"):
        write_report(interviews, options, spec, path, mode="append")
    write_report(interviews, options, spec, path)
    with pytest.raises(Exception, match="(?i)already exists"):
        write_report(interviews, options, spec, path)
    write_report(interviews, options, spec, path, mode="overwrite")
    table = interviews.sparkSession.read.parquet(f"{path}/frequencies")
    assert as_dict(table, ("split_id", "variable", "code"), ("n",))[(101, "v1", "1")] == (2,)


def test_packing_can_be_chosen(survey_sf):
    df, options = survey_sf
    tables = [
        build_report(df, options, report_spec(
            REPORT_SPLITS, REPORT_WEIGHTS, ["v1"], most_combinations=most)).frequencies
        for most in (2, 10_000)
    ]
    keys, measures = ("split_id", "variable", "code"), ("n", "n_weighted")
    assert as_dict(tables[0], keys, measures) == as_dict(tables[1], keys, measures)
