import pytest
from pyspark.sql import functions as F

import surveytab.plans.report as report_module
from surveytab.plans import manifest
from surveytab.plans.report import (
    add_batch,
    build_report,
    number_splits,
    refresh_tables,
    remove_batch,
    report_spec,
    split_options,
    stored_report,
    write_report,
)
from tests.conftest import as_dict

KEYS = ("split_id", "variable", "code")
MEASURES = ("n", "n_weighted", "pct", "pct_weighted")


@pytest.fixture
def spec():
    return report_spec(["Geral", "v1", "v19"], ["w", None, "w"], ["v1"], {"v5": ["v5_1", "v5_2"]}, ["v30m"])


@pytest.fixture(scope="module")
def many(interviews):
    """The interviews twenty times over, with weights that are no round numbers."""
    return interviews.crossJoin(interviews.sparkSession.range(20).withColumnRenamed("id", "copy")).selectExpr(
        "*", "w / (copy + 3) as u").drop("w").withColumnRenamed("u", "w")


def contents(report):
    bases = as_dict(report.bases, ("split_id", "variable"), ("total", "total_weighted", "pct_base", "respondents"), 12)
    means = as_dict(report.means, ("split_id",), ("mean", "mean_weighted", "n", "sd", "sd_weighted"), 9)
    return as_dict(report.frequencies, KEYS, MEASURES, 12), bases, means


def test_batches_equal_the_report_of_their_union(spark, many, options, spec, tmp_path):
    path = str(tmp_path / "report")
    add_batch(many.filter("copy < 7"), options, spec, path, "a")
    add_batch(many.filter("copy >= 7"), options, spec, path, "b")
    assert contents(stored_report(options, spec, path)) == contents(build_report(many, options, spec))
    # A batch replaced, one taken out, one without interviews.
    add_batch(many.filter("copy >= 12"), options, spec, path, "b")
    add_batch(many.limit(0), options, spec, path, "c")
    part = many.filter("copy < 7 or copy >= 12")
    assert contents(stored_report(options, spec, path)) == contents(build_report(part, options, spec))
    remove_batch(spark, path, "a")
    late = many.filter("copy >= 12")
    assert contents(refresh_tables(options, spec, path)) == contents(build_report(late, options, spec))
    assert as_dict(spark.read.parquet(f"{path}/frequencies"), KEYS, MEASURES, 12) == contents(build_report(late, options, spec))[0]
    gone = manifest.remove_unused(spark, path)
    assert sorted(g.split("/")[0] for g in gone) == ["counts"] * 2 + ["moments"] * 2
    assert contents(stored_report(options, spec, path)) == contents(build_report(late, options, spec))
    with pytest.raises(ValueError, match="no batch"):
        remove_batch(spark, path, "a")


def test_dictionary_may_grow_between_batches(spark, many, options, spec, tmp_path):
    path = str(tmp_path / "report")
    add_batch(many.filter("copy < 7"), options, spec, path, "a")
    more = options.unionByName(spark.sql(
        "select 0 as option_id, 'v1' as variable, '9' as code, 'nine' as label union all select -1, 'v19', '7', 'seven'"))
    add_batch(many.filter("copy >= 7"), more, spec, path, "b")
    assert contents(stored_report(more, spec, path)) == contents(build_report(many, more, spec))


def test_a_report_can_only_be_added_to_by_its_own_kind(many, options, spec, tmp_path):
    path = str(tmp_path / "report")
    with pytest.raises(ValueError, match="no report"):
        stored_report(options, spec, path)
    add_batch(many, options, spec, path, "a")
    other = report_spec(["Geral", "v1"], ["w", None], ["v1"])
    with pytest.raises(ValueError, match="another specification"):
        add_batch(many, options, other, path, "b")
    with pytest.raises(ValueError, match="another specification"):
        stored_report(options, other, path)


@pytest.mark.parametrize("mode", ["errorifexists", "overwrite"])
@pytest.mark.parametrize("fails_at", ["bases", "moments"])
def test_a_run_that_failed_half_way_is_in_nobodys_way(spark, interviews, options, spec, tmp_path, monkeypatch, mode, fails_at):
    path = str(tmp_path / "report")

    def broken(*args, **kwargs):
        raise RuntimeError("lost")

    if fails_at == "bases":
        def some(report, path):
            report.frequencies.write.mode("overwrite").parquet(f"{path}/frequencies")
            raise RuntimeError("lost")

        monkeypatch.setattr(report_module, "_write_tables", some)
    else:
        monkeypatch.setattr(report_module, "report_moments", broken)
    with pytest.raises(RuntimeError):
        write_report(interviews, options, spec, path)
    monkeypatch.undo()
    assert manifest.entries(spark, path) == {}
    report = write_report(interviews, options, spec, path, mode=mode)
    assert contents(report) == contents(build_report(interviews, options, spec))
    counted = []
    monkeypatch.setattr(report_module, "report_counts", lambda *a: counted.append(a))
    with pytest.raises(ValueError, match="already exists"):
        write_report(interviews, options, spec, path)
    assert counted == []  # told before anything is counted
    assert manifest.remove_unused(spark, path) == []


def test_two_hundred_thousand_options(spark):
    n = 200_000
    listed = spark.range(1, n + 1).selectExpr("id as option_id", "'s' as variable", "string(id * 7) as code", "'' as label")
    listed = listed.unionByName(spark.sql("select 0L, 's', '123456789012345678901', '' union all select 1L, 'v', '1', ''"
                                          " union all select 2L, 'v', '2', ''").toDF("option_id", "variable", "code", "label"))
    df = spark.range(5_000).selectExpr("if(id % 3 = 0, 7, id * 7) as s", "id % 2 + 1 as v", "1.5D as w")
    spec = report_spec(["Geral", "s"], ["w", None], ["v"])
    numbers = number_splits(listed, spec)
    assert (numbers.unit, numbers.sizes, numbers.short) == (1_000_000, {2: n + 1}, {})
    report = build_report(df, listed, spec)
    plan = report.frequencies._jdf.queryExecution().optimizedPlan().toString()
    assert len(plan) < 60_000 and "CartesianProduct" not in report.frequencies._jdf.queryExecution().executedPlan().toString()
    found = report.frequencies.agg(F.count("*").alias("rows"), F.sum("n").alias("n")).first()
    assert (found.rows, found.n) == (2 * (n + 2), 2 * 5_000)
    hot = report.frequencies.filter("split_id = 2000002").collect()  # the second option: code 7, every third and id 1
    assert sum(r.n for r in hot) == 1_667 + 1


def test_no_task_numbers_a_long_split(spark, monkeypatch):
    """Ranges of a split's order are numbered by themselves, whatever the ids: null, shared by many, far apart."""
    monkeypatch.setattr(report_module, "_MOST_IN_A_RANGE", 100)
    monkeypatch.setattr(report_module, "_SAMPLED_IN_A_RANGE", 10)
    some = spark.range(6_000).selectExpr(
        "case when id % 5 = 0 then null when id % 5 < 3 then 7L when id % 5 = 3 then -id * id * 1000000 else id end as option_id",
        "if(id % 3 = 0, 's', 't') as variable", "concat(if(id % 2 = 0, 'é', '$'), id * 7919 % 6000) as code", "'' as label")
    listed = some.unionByName(some.filter("option_id < 3000").withColumn("option_id", F.lit(9_999)))
    listed = listed.unionByName(spark.sql("select 3L as option_id, 'u' as variable, 'x' as code, '' as label union all select 2L, 'u', 'y', ''"))
    spec = report_spec(["Geral", "s", "u", "t"], [None] * 4, ["v"])
    numbers = number_splits(listed, spec)
    assert (numbers.unit, numbers.sizes, numbers.short) == (10_000, {2: 2_000, 3: 2, 4: 4_000}, {3: ("y", "x")})
    of = {}
    for r in listed.collect():
        place = (r.option_id is not None, r.option_id or 0, r.code.encode())
        of[r.variable, r.code] = min(place, of.get((r.variable, r.code), place))
    expected = {}
    for n, name in ((2, "s"), (3, "u"), (4, "t")):
        codes = sorted((c for v, c in of if v == name), key=lambda c: of[name, c])
        expected |= {(n, code): (i, n * 10_000 + i) for i, code in enumerate(codes, 1)}
    assert as_dict(numbers.table, ("split_no", "option"), ("option_no", "split_id")) == expected
    found = report_module.report_description(listed, spec, numbers.unit).filter("split_no > 1")
    assert as_dict(found, ("split_no", "option"), ("option_no", "split_id")) == expected
    by_number = numbers.table.filter("split_no <> 3").withColumn("option_id", F.col("option_no"))
    ranged, _ = report_module._ranges(by_number, {2: 2_000, 4: 4_000})
    rows = ranged.groupBy("split_no", "part").count().collect()
    assert len(rows) > 40 and max(r["count"] for r in rows) < 400
    plan = numbers.table._jdf.queryExecution().optimizedPlan().toString()
    assert "windowspecdefinition(split_no" in plan and ", part" in plan


def test_options_as_a_list(options, spec):
    listed = split_options(options, spec)
    assert [(o.split_id, o.split_no, o.code) for o in listed] == [
        (101, 1, "1"), (201, 2, "1"), (202, 2, "2"), (301, 3, "0"), (302, 3, "1")]


@pytest.mark.parametrize("kind", ["int", "bigint", "double", "string"])
def test_codes_beyond_the_type_of_the_column(spark, interviews, options, kind):
    more = options.unionByName(spark.sql(
        "select 9 as option_id, 'v1' as variable, '98765432109876543210' as code, '' as label union all select 10, 'v1', '01', ''"))
    spec = report_spec(["Geral", "v1"], ["w", None], ["v1"])
    report = build_report(interviews.withColumn("v1", F.col("v1").cast(kind)), more, spec)
    found = as_dict(report.frequencies.filter("n > 0"), KEYS, ("n",))
    assert found == {(101, "v1", "1"): (2,), (101, "v1", "2"): (1,), (201, "v1", "1"): (2,), (202, "v1", "2"): (1,)}
