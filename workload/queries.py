"""The registered queries: each takes (spark, sf_dir) and returns a DataFrame."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from surveytab.functions.codes import canonical_code, in_codes, not_in_codes
from surveytab.functions.frames import literal_rows
from surveytab.operators.crosstab import cross_many, cross_multiple, cross_single
from surveytab.operators.frequency import (
    frequencies,
    mentioned_frequencies,
    multiple_frequencies,
    single_frequencies,
)
from surveytab.operators.labels import label_coded, label_mentioned
from surveytab.operators.layout import layout_compare, layout_map, layout_tidy, layout_wide
from surveytab.operators.means import cross_means, means
from surveytab.operators.trimmed import trimmed_means, trimmed_means_by
from surveytab.plans.report import (
    add_batch,
    build_report,
    report_spec,
    route_variables,
    stored_report,
    write_report,
)
from surveytab.sources.dictionary import (
    alias_options,
    check_options,
    open_ended_answers,
    open_ended_options,
    options_from,
    override_options,
    questions_from,
)
from surveytab.sources.responses import CODED_AT, STATUS, completed_interviews, latin1_text
from workload.inputs import (
    FRACTION,
    MEASURES,
    MENTIONS,
    REPORT_SPLITS,
    REPORT_WEIGHTS,
    SLOTS,
    TIE_KEY,
    WEIGHT,
    WIDE_COLUMNS,
    WIDE_ROWS,
    ordered_days,
    part_options,
    priorities,
    ship_options,
    supplier_open_options,
    survey,
    survey_options,
    survey_questions,
    table,
    wide_options,
    wide_survey,
)

DIGITS = 4


def rounded(df: DataFrame) -> DataFrame:
    """Percentages, means and deviations to four decimals; counts as they are."""
    exact = ("n_weighted", "total_weighted", "weight")
    return df.select(
        *[
            F.round(c, DIGITS).alias(c) if t == "double" and not c.startswith(exact) else F.col(c)
            for c, t in df.dtypes
        ]
    )


# --- sources and dictionary -------------------------------------------------------


def responses_filtered(spark, sf):
    orders = table(spark, sf, "orders").selectExpr(
        "o_orderkey",
        "o_custkey",
        "o_totalprice as weight",
        f"case when o_orderstatus = 'F' then 0 else 1 end as {STATUS}",
        f"nullif(o_orderpriority, '5-LOW') as {CODED_AT}",
    )
    return completed_interviews(orders).select("o_orderkey", "o_custkey", "weight")


def responses_text_status(spark, sf):
    """A status that is text, and not always a number."""
    orders = table(spark, sf, "orders").selectExpr(
        "o_orderkey",
        f"case o_orderstatus when 'F' then '0' when 'O' then 'open' else '0.0' end as {STATUS}",
        f"o_orderdate as {CODED_AT}",
    )
    return completed_interviews(orders).select("o_orderkey", STATUS)


def _open_answers(spark, sf):
    questions = table(spark, sf, "documents").selectExpr(
        "doc_id as questaoaberta_id", "lang as questaoaberta_variavel"
    )
    answers = table(spark, sf, "labels").selectExpr(
        "doc_id as questaoaberta_id",
        "quality as respostaaberta_cod",
        "cast(toxic as string) as respostaaberta_label",
    )
    return open_ended_answers(questions, answers)


def open_ended_join(spark, sf):
    joined = _open_answers(spark, sf)
    return joined.select(
        F.col("`questaoaberta_id...1`").alias("question_key"),
        F.col("`questaoaberta_id...3`").alias("answer_key"),
        "questaoaberta_variavel",
        "respostaaberta_cod",
        "respostaaberta_label",
    )


def open_ended_hot(spark, sf):
    """Six in ten answers are to one question."""
    questions = table(spark, sf, "documents").selectExpr(
        "doc_id as questaoaberta_id", "lang as questaoaberta_variavel"
    )
    answers = table(spark, sf, "labels").selectExpr(
        "case when doc_id % 5 < 3 then 7 else doc_id end as questaoaberta_id",
        "doc_id as answer", "quality as respostaaberta_cod",
    )
    joined = open_ended_answers(questions, answers, spread_hot=True)
    return joined.select(
        F.col("`questaoaberta_id...1`").alias("question_key"),
        F.col("`questaoaberta_id...3`").alias("answer_key"),
        "questaoaberta_variavel", "answer", "respostaaberta_cod",
    )


def open_ended_dictionary(spark, sf):
    return open_ended_options(_open_answers(spark, sf))


def latin1(spark, sf):
    documents = table(spark, sf, "documents").selectExpr(
        "doc_id", "case when doc_id % 10 = 0 then concat(text, '漢') else text end as text"
    )
    return latin1_text(documents)


def dictionary_override(spark, sf):
    closed = check_options(options_from(part_options(spark, sf)))
    return override_options(closed, options_from(supplier_open_options(spark, sf)))


def dictionary_alias(spark, sf):
    return alias_options(options_from(part_options(spark, sf)), "Brand#12", "G12MRG")


def not_in_null_safe(spark, sf):
    interviews = survey(spark, sf)
    code = canonical_code(interviews, "v1")
    return (
        interviews.select(
            code.alias("code"),
            not_in_codes(code, [2]).alias("kept"),
            in_codes(code, [1, 2]).alias("listed"),
            WEIGHT,
        )
        .groupBy("code", "kept", "listed")
        .agg(F.count(F.lit(1)).alias("n"), F.sum(WEIGHT).alias("n_weighted"))
    )


# --- frequencies ------------------------------------------------------------------


def freq_single(spark, sf):
    return rounded(single_frequencies(survey(spark, sf), ["v1", "v13"], WEIGHT))


def freq_single_unweighted(spark, sf):
    return rounded(single_frequencies(survey(spark, sf), ["v1", "v13"]))


def freq_single_empty(spark, sf):
    nobody = survey(spark, sf).withColumn("v1", F.lit(None).cast("int"))
    return rounded(single_frequencies(nobody, ["v1"], WEIGHT))


def freq_text_codes(spark, sf):
    orders = table(spark, sf, "orders")
    return rounded(single_frequencies(orders, ["o_orderstatus", "o_orderpriority"]))


def freq_multi(spark, sf):
    return rounded(multiple_frequencies(survey(spark, sf), SLOTS, WEIGHT))


def freq_mentioned(spark, sf):
    return rounded(mentioned_frequencies(survey(spark, sf), MENTIONS, WEIGHT))


def _nobody_mentioned(spark, sf):
    nobody = survey(spark, sf).withColumns({c: F.col(c) * 0 for c in MENTIONS["G019"]})
    return mentioned_frequencies(nobody, MENTIONS, WEIGHT)


def freq_mentioned_none(spark, sf):
    return rounded(_nobody_mentioned(spark, sf))


def freq_all_kinds(spark, sf):
    return rounded(frequencies(survey(spark, sf), ["v1", "v13"], SLOTS, MENTIONS, WEIGHT))


def freq_multi_unnamed(spark, sf):
    return rounded(multiple_frequencies(survey(spark, sf), [["v5_1", "v5_2", "v5_3"]], WEIGHT))


def freq_mixed_types(spark, sf):
    """Whole numbers, fractions and text in one call and one scan."""
    interviews = survey(spark, sf).selectExpr(
        "*", "cast(v5_1 as double) / 2 as v60",
        "case v13 when 1 then 'closed' when 2 then 'open' end as v61",
    )
    return rounded(single_frequencies(interviews, ["v1", "v60", "v61"], WEIGHT))


def freq_fractional_weights(spark, sf):
    """Weights that are no round numbers: totals equal bit for bit, in any partitioning."""
    interviews = survey(spark, sf).withColumn(WEIGHT, F.expr(FRACTION))
    return single_frequencies(interviews, ["v1", "v13"], WEIGHT).drop("pct", "pct_weighted")


def freq_large_codes(spark, sf):
    """Codes beyond 2^31, doubles beyond 10^15, and negative fractions, in their order."""
    interviews = survey(spark, sf).selectExpr(
        "v1 * 3000000000L as v62", "cast(v5_1 as double) * 1e15 as v63", "v5_1 * -0.25D as v64", WEIGHT)
    return rounded(single_frequencies(interviews, ["v62", "v63", "v64"], WEIGHT))


# --- labels and layouts -----------------------------------------------------------


def label_coded_query(spark, sf):
    table_ = single_frequencies(survey(spark, sf), ["v1"], WEIGHT)
    return rounded(label_coded(table_, survey_options(spark), ["v1"]))


def label_mentioned_query(spark, sf):
    table_ = mentioned_frequencies(survey(spark, sf), MENTIONS, WEIGHT)
    return rounded(label_mentioned(table_, survey_questions(spark), list(MENTIONS)))


def label_mentioned_none(spark, sf):
    return rounded(
        label_mentioned(_nobody_mentioned(spark, sf), survey_questions(spark), list(MENTIONS))
    )


def label_mentioned_from_table(spark, sf):
    """Question texts read from a table: the names of the parts, three of them in the group."""
    questions = table(spark, sf, "part").selectExpr(
        "concat('v', cast(p_partkey as string)) as opcao_variavel",
        "if(p_partkey between 19 and 21, 'G019', 'G000') as pergunta_num_quest",
        "p_name as pergunta_enunciado")
    table_ = mentioned_frequencies(survey(spark, sf), MENTIONS, WEIGHT)
    return rounded(label_mentioned(table_, questions_from(questions), list(MENTIONS)))


def label_coded_by(spark, sf):
    table_ = single_frequencies(survey(spark, sf), ["v1"], WEIGHT, by="v13")
    return rounded(label_coded(table_, survey_options(spark), ["v1"]))


def label_mentioned_by(spark, sf):
    table_ = mentioned_frequencies(survey(spark, sf), MENTIONS, WEIGHT, by="v13")
    return rounded(label_mentioned(table_, survey_questions(spark), list(MENTIONS)))


def layout_compare_labelled(spark, sf):
    """Frequency, labels, comparison of all splits found."""
    table_ = single_frequencies(survey(spark, sf), ["v1"], WEIGHT, by="v13")
    return rounded(layout_compare(label_coded(table_, survey_options(spark), ["v1"])))


def layout_compare_cleaned(spark, sf):
    """Splits whose names need cleaning before they are columns."""
    interviews = survey(spark, sf).selectExpr(
        "*", "case v13 when 1 then 'Já fechado (F)' when 2 then 'Em aberto' end as v65")
    table_ = single_frequencies(interviews, ["v1"], WEIGHT, by="v65")
    return rounded(layout_compare(table_, ["Já fechado (F)", "Em aberto"]))


def layout_wide_all(spark, sf):
    """All codes found as columns, without a list."""
    wide = layout_wide(single_frequencies(survey(spark, sf), ["v1", "v5_1"], WEIGHT))
    codes = [c for c in wide.columns if c not in ("variable", "measure", "row_order")]
    return rounded(
        wide.select("variable", "measure", *[F.col(f"`{c}`").alias(f"c_{c.lower()}") for c in codes])
    )


def layout_tidy_query(spark, sf):
    return rounded(layout_tidy(single_frequencies(survey(spark, sf), ["v1", "v13"], WEIGHT)))


def layout_wide_query(spark, sf):
    table_ = single_frequencies(survey(spark, sf), ["v1"], WEIGHT)
    wide = layout_wide(table_, [1, 2, 3, 4])
    codes = [c for c in wide.columns if c not in ("variable", "measure", "row_order")]
    return rounded(
        wide.select("variable", "measure", "row_order", *[
            F.col(f"`{c}`").alias(f"c_{c.lower()}") for c in codes
        ])
    )


def layout_compare_query(spark, sf):
    return rounded(
        layout_compare(single_frequencies(survey(spark, sf), ["v1"], WEIGHT, by="v13"), [1, 2])
    )


def layout_map_query(spark, sf):
    """A split per supplier, side by side, as text."""
    interviews = survey(spark, sf)
    table_ = layout_map(single_frequencies(interviews, ["v1"], WEIGHT, by="l_suppkey"))

    def text(measure):
        entries = F.map_entries(F.col(measure))
        lines = F.transform(entries, lambda e: F.concat_ws("=", e["key"], e["value"].cast("decimal(20,2)").cast("string")))
        return F.array_join(lines, ";").alias(measure)

    return table_.select("variable", "code", "row_kind", text("n"), text("n_weighted"), text("pct"))


# --- means ------------------------------------------------------------------------


def mean_stats(spark, sf):
    return rounded(means(survey(spark, sf), ["v30m", "v5_1"], WEIGHT))


def mean_stats_shifted(spark, sf):
    """Answers a thousand million from zero, with weights that go with them."""
    interviews = survey(spark, sf).selectExpr("l_extendedprice + 1e9D as v66", "l_extendedprice as w")
    found = means(interviews, ["v66"], "w")
    return found.select(
        "variable", F.round("mean", 2).alias("mean"), F.round("mean_weighted", 2).alias("mean_weighted"),
        "n", F.round("sd", 3).alias("sd"), F.round("sd_weighted", 3).alias("sd_weighted"))


def mean_trimmed(spark, sf):
    return rounded(trimmed_means(survey(spark, sf), ["v30m"], TIE_KEY, WEIGHT))


def mean_trimmed_scalable(spark, sf):
    """The same search with so few sortable rows that it has to narrow down first."""
    return rounded(
        trimmed_means(survey(spark, sf), ["v30m"], TIE_KEY, WEIGHT, sortable=1_000, accuracy=1_000)
    )


def mean_trimmed_ties(spark, sf):
    """Fifty values over all rows: both cuts fall among many equal answers."""
    interviews = survey(spark, sf).withColumn("rating", F.col(WEIGHT))
    return rounded(
        trimmed_means(interviews, ["rating"], TIE_KEY, WEIGHT, sortable=1_000, accuracy=1_000)
    )


def mean_trimmed_by(spark, sf):
    """Two measures trimmed within each code of another question."""
    return rounded(trimmed_means_by(survey(spark, sf), ["v30m", "v5_1"], "v1", TIE_KEY, WEIGHT))


def mean_trimmed_types(spark, sf):
    """Whole numbers, long ones, decimals and doubles; a third of the answers are equal."""
    interviews = survey(spark, sf).selectExpr(*TIE_KEY, WEIGHT, *[f"{sql} as {n}" for n, sql in MEASURES])
    return rounded(trimmed_means(interviews, [n for n, _ in MEASURES], TIE_KEY, WEIGHT))


# --- crosstabs --------------------------------------------------------------------


def cross_single_query(spark, sf):
    return rounded(
        cross_single(survey(spark, sf), survey_options(spark), [("v1", "v13")], WEIGHT)
    )


def cross_single_outside(spark, sf):
    """A dictionary that lacks two codes: they join the null category."""
    listed = survey_options(spark).filter("option_id not in (102, 201)")
    return rounded(
        cross_single(survey(spark, sf), listed, [("v1", "v13"), ("v13", "v1")], WEIGHT)
    )


def _all_pairs():
    return [(c, r) for c, *_ in WIDE_COLUMNS for r, *_ in WIDE_ROWS]


def cross_many_query(spark, sf):
    """Twenty questions by twenty, of mixed types: 400 tables."""
    return rounded(cross_many(wide_survey(spark, sf), wide_options(spark), _all_pairs(), weight=WEIGHT))


def cross_many_codes(spark, sf):
    """The same without a dictionary: all codes found."""
    table_ = cross_many(wide_survey(spark, sf), None, _all_pairs(), weight=WEIGHT)
    return rounded(table_.drop("row_order", "col_order"))


def cross_many_groups(spark, sf):
    """Single questions and a group, each by each."""
    pairs = [(c, r) for c in ("v1", "v13", "v19", "v20") for r in ("v5", "v13", "v21")]
    return rounded(cross_many(survey(spark, sf), survey_options(spark), pairs, SLOTS, WEIGHT))


def cross_multi(spark, sf):
    options = survey_options(spark)
    return rounded(cross_multiple(survey(spark, sf), options, [("v1", "v5")], SLOTS, WEIGHT))


def cross_mean(spark, sf):
    return rounded(
        cross_means(survey(spark, sf), survey_options(spark), [("v1", "v30m")], WEIGHT)
    )


def cross_mean_outside(spark, sf):
    listed = survey_options(spark).filter("option_id <> 102")
    return rounded(
        cross_means(survey(spark, sf), listed, [("v1", "v30m"), ("v13", "v30m")], WEIGHT)
    )


# --- the split report -------------------------------------------------------------


def _report(spark, sf, singles=("v1",), multiples=None, means_=()):
    spec = report_spec(REPORT_SPLITS, REPORT_WEIGHTS, singles, multiples, means_)
    return build_report(survey(spark, sf), survey_options(spark), spec)


def report_routed(spark, sf):
    """The description of a report whose variables come as one list, a group first."""
    wanted = route_variables([["X5", *SLOTS["v5"]], "v1", "v30m"])
    spec = report_spec(REPORT_SPLITS, REPORT_WEIGHTS, **wanted)
    return build_report(survey(spark, sf), survey_options(spark), spec).description


def report_many_options(spark, sf):
    """A split of some 360 days."""
    options = ship_options(spark, sf).unionByName(priorities(spark))
    spec = report_spec(["Geral", "v70"], [None, WEIGHT], ["v71"])
    report = build_report(ordered_days(spark, sf), options, spec)
    described = report.description.select("split_id", "option")
    return rounded(report.frequencies.join(described, "split_id"))


def report_written(spark, sf):
    """The report as a job writes it: read back from the folder."""
    spec = report_spec(REPORT_SPLITS, REPORT_WEIGHTS, ["v1"])
    path = _report_folder(spark)
    write_report(survey(spark, sf), survey_options(spark), spec, path)
    return rounded(spark.read.parquet(f"{path}/frequencies"))


def _report_folder(spark):
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="surveytab-")
    return f"{folder.rstrip('/')}/report-{uuid.uuid4().hex}"


def report_two_batches(spark, sf):
    """Interviews that come in two batches, the second one twice; the first time it was not whole."""
    spec = report_spec(REPORT_SPLITS, REPORT_WEIGHTS, ["v1"], SLOTS)
    interviews, options, path = survey(spark, sf), survey_options(spark), _report_folder(spark)
    late = interviews.filter("l_orderkey % 3 = 0")
    add_batch(interviews.filter("l_orderkey % 3 <> 0"), options, spec, path, "early")
    add_batch(late.filter("l_linenumber < 3"), options, spec, path, "late")
    add_batch(late, options, spec, path, "late")
    report = stored_report(options, spec, path)
    lines = report.frequencies.withColumn("line", F.lit("frequency")).unionByName(
        report.bases.withColumn("line", F.lit("base")), allowMissingColumns=True)
    return rounded(lines)


def report_two_batches_means(spark, sf):
    """Means of two batches, from their moments."""
    spec = report_spec(REPORT_SPLITS, REPORT_WEIGHTS, ["v1"], means=["v30m"])
    interviews, options, path = survey(spark, sf), survey_options(spark), _report_folder(spark)
    add_batch(interviews.filter("l_extendedprice < 40000"), options, spec, path, "small")
    add_batch(interviews.filter("l_extendedprice >= 40000"), options, spec, path, "large")
    return rounded(stored_report(options, spec, path).means)


def report_order_options(spark, sf):
    """A split with an option for every order, and two codes beyond any whole number."""
    interviews = table(spark, sf, "lineitem").selectExpr("l_orderkey as v72", "l_linenumber as v73", "l_quantity as weight")
    orders = table(spark, sf, "orders").selectExpr(
        "o_orderkey as option_id", "'v72' as variable", "cast(o_orderkey as string) as code", "'order' as label")
    rows = [[-n, "v73", str(n), f"line {n}"] for n in range(1, 8)] + [[0, "v72", "98765432109876543210", "no order"]]
    names = ("option_id", "variable", "code", "label")
    more = literal_rows(spark, dict(zip(names, ("bigint", "string", "string", "string"))), rows)
    spec = report_spec(["Geral", "v72"], [WEIGHT, None], ["v73"])
    report = build_report(interviews, orders.unionByName(more), spec)
    described = report.description.select("split_id", "option")
    return rounded(report.frequencies.join(described, "split_id").drop("split_id"))


def report_freq_single(spark, sf):
    return rounded(_report(spark, sf).frequencies)


def report_freq_multi(spark, sf):
    return rounded(_report(spark, sf, (), SLOTS).frequencies)


def report_base_single(spark, sf):
    return rounded(_report(spark, sf).bases)


def report_base_multi(spark, sf):
    return rounded(_report(spark, sf, (), SLOTS).bases)


def report_description(spark, sf):
    return _report(spark, sf).description


def report_assembled(spark, sf):
    """Frequencies and bases of everything, as one list of rows."""
    report = _report(spark, sf, ("v1", "v13"), SLOTS)
    described = report.description.select("split_id", "split", "option", "weight")
    lines = report.frequencies.withColumn("line", F.lit("frequency")).unionByName(
        report.bases.withColumn("line", F.lit("base")), allowMissingColumns=True
    )
    return rounded(lines.join(described, "split_id", "left"))


def report_means(spark, sf):
    return rounded(_report(spark, sf, means_=("v30m",)).means)


QUERIES = {
    "responses_filtered": responses_filtered,
    "responses_text_status": responses_text_status,
    "open_ended_join": open_ended_join,
    "open_ended_hot": open_ended_hot,
    "open_ended_dictionary": open_ended_dictionary,
    "latin1_text": latin1,
    "dictionary_override": dictionary_override,
    "dictionary_alias": dictionary_alias,
    "not_in_null_safe": not_in_null_safe,
    "freq_single": freq_single,
    "freq_single_unweighted": freq_single_unweighted,
    "freq_single_empty": freq_single_empty,
    "freq_text_codes": freq_text_codes,
    "freq_multi": freq_multi,
    "freq_multi_unnamed": freq_multi_unnamed,
    "freq_mixed_types": freq_mixed_types,
    "freq_large_codes": freq_large_codes,
    "freq_fractional_weights": freq_fractional_weights,
    "freq_mentioned": freq_mentioned,
    "freq_mentioned_none": freq_mentioned_none,
    "freq_all_kinds": freq_all_kinds,
    "label_coded": label_coded_query,
    "label_mentioned": label_mentioned_query,
    "label_mentioned_none": label_mentioned_none,
    "label_mentioned_from_table": label_mentioned_from_table,
    "label_coded_by": label_coded_by,
    "label_mentioned_by": label_mentioned_by,
    "layout_tidy": layout_tidy_query,
    "layout_wide": layout_wide_query,
    "layout_wide_all": layout_wide_all,
    "layout_compare": layout_compare_query,
    "layout_compare_labelled": layout_compare_labelled,
    "layout_compare_cleaned": layout_compare_cleaned,
    "layout_map": layout_map_query,
    "mean_stats": mean_stats,
    "mean_stats_shifted": mean_stats_shifted,
    "mean_trimmed": mean_trimmed,
    "mean_trimmed_scalable": mean_trimmed_scalable,
    "mean_trimmed_ties": mean_trimmed_ties,
    "mean_trimmed_by": mean_trimmed_by,
    "mean_trimmed_types": mean_trimmed_types,
    "cross_single": cross_single_query,
    "cross_single_outside": cross_single_outside,
    "cross_multi": cross_multi,
    "cross_many": cross_many_query,
    "cross_many_codes": cross_many_codes,
    "cross_many_groups": cross_many_groups,
    "cross_mean": cross_mean,
    "cross_mean_outside": cross_mean_outside,
    "report_freq_single": report_freq_single,
    "report_freq_multi": report_freq_multi,
    "report_base_single": report_base_single,
    "report_base_multi": report_base_multi,
    "report_description": report_description,
    "report_routed": report_routed,
    "report_many_options": report_many_options,
    "report_written": report_written,
    "report_two_batches": report_two_batches,
    "report_two_batches_means": report_two_batches_means,
    "report_order_options": report_order_options,
    "report_assembled": report_assembled,
    "report_means": report_means,
}
