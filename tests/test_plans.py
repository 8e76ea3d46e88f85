"""What the plans must look like at any size."""

import re

import pytest

from surveytab.operators.frequency import frequencies
from surveytab.operators.labels import label_coded
from surveytab.operators.layout import layout_tidy, layout_wide
from surveytab.operators.means import means
from surveytab.plans.report import build_report, report_spec
from workload.inputs import MENTIONS, REPORT_SPLITS, REPORT_WEIGHTS, SLOTS, survey, survey_options

SF = "/root/testdata/sf0.001"


def final_plan(df) -> str:
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan.split("== Initial Plan ==")[0]


def scans(df) -> int:
    return final_plan(df).count("FileScan")


@pytest.fixture(scope="module")
def interviews_sf(spark):
    return survey(spark, SF)


@pytest.fixture(scope="module")
def options(spark):
    return survey_options(spark)


@pytest.fixture(scope="module")
def many(interviews_sf):
    return frequencies(interviews_sf, ["v1", "v13"], SLOTS, MENTIONS, "weight")


def test_all_tables_from_one_scan_and_one_shuffle_of_counts(many):
    plan = final_plan(many)
    assert plan.count("FileScan") == 1
    of_rows = [l for l in plan.splitlines() if "Exchange hashpartitioning(slot" in l]
    assert len([l for l in of_rows if "Reused" not in l]) == 1


def test_rows_are_aggregated_before_the_shuffle(many):
    plan = final_plan(many)
    below = plan[plan.index("Exchange hashpartitioning(slot"):]
    assert "partial_count" in below.splitlines()[1]


def test_only_needed_columns_are_read(spark, interviews_sf):
    plan = final_plan(frequencies(interviews_sf, ["v13"], weight="weight"))
    schema = re.search(r"ReadSchema: struct<(.*?)>", plan).group(1)
    assert schema == "l_quantity:double,l_linestatus:string"


def test_layouts_and_labels_do_not_scan_again(many, options):
    assert scans(layout_tidy(many)) == 1
    assert scans(layout_wide(many, [1, 2], unlisted="drop")) == 1
    assert scans(label_coded(many, options, ["v1", "v13"])) == 1


def test_report_tables_scan_once_each(interviews_sf, options):
    spec = report_spec(REPORT_SPLITS, REPORT_WEIGHTS, ["v1"], SLOTS, ["v30m"])
    report = build_report(interviews_sf, options, spec)
    assert scans(report.frequencies) == 1
    assert scans(report.bases) == 1
    assert scans(report.means) == 1


def test_means_of_many_variables_in_one_scan(interviews_sf):
    assert scans(means(interviews_sf, ["v30m", "v5_1", "v5_2"], "weight")) == 1


def test_codes_of_all_types_from_one_scan_and_one_shuffle(interviews_sf):
    mixed = interviews_sf.selectExpr("*", "v30m / 2 as v60", "string(v1) as v61")
    table = frequencies(mixed, ["v1", "v60", "v61"], {"v5": ["v5_1", "v61"]}, weight="weight")
    plan = final_plan(table)
    assert plan.count("FileScan") == 1
    of_rows = [l for l in plan.splitlines() if "Exchange hashpartitioning(slot" in l]
    assert len([l for l in of_rows if "Reused" not in l]) == 1


def test_many_options_are_joined_and_not_listed(spark):
    from workload.inputs import ordered_days, priorities, ship_options

    spec = report_spec(["Geral", "v70"], [None, "weight"], ["v71"])
    options = ship_options(spark, SF).unionByName(priorities(spark))
    plan = final_plan(build_report(ordered_days(spark, SF), options, spec).frequencies)
    assert "BroadcastHashJoin" in plan and "19960101" not in plan.split("Project")[1]
