"""Labels for frequency tables.

The dictionary decides which rows a labelled table has: options nobody chose are
added with null counts, codes it does not list are dropped.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from surveytab.functions.frames import literal_rows
from surveytab.operators.frequency import BASE_ORDER, TOTAL_ORDER

# The codes for "no answer" that close a table, in this order.
LAST_CODES = ("-88", "-99")
LAST_ORDER = 1e299  # of the first of them

# Variables are named v1, v2, ...; other names are no options of a question.
OPTION_NAME = r"^v\d"

_MEASURES = ("n", "n_weighted", "pct", "pct_weighted")
_COLUMNS = ("variable", "code", "label", "row_kind", "row_order", *_MEASURES)


def label_coded(table: DataFrame, options: DataFrame, variables: Sequence[str]) -> DataFrame:
    """Labels for tables of single-choice and multiple-response questions.

    A variable takes the options listed under its own name and under its name
    followed by ``_`` (the slots of a group). The order is that of the dictionary,
    then the codes for no answer, then Total and Base. A table made with ``by`` is labelled
    within every split that it has. A variable that is not in the dictionary stops the job.
    """
    keys = _keys(table)
    parts = F.split("variable", "_")
    stems = F.transform(
        F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "_")
    )
    twice = F.raise_error(F.concat(F.lit("two labels for code "), F.col("code"))).cast("string")
    listed = (
        options.select(F.explode(stems).alias("variable"), "code", "label", "option_id")
        .filter(F.col("variable").isin(list(variables)))
        .groupBy("variable", "code")
        .agg(
            F.min("option_id").alias("option_id"),
            F.min("label").alias("first_label"),
            F.max("label").alias("last_label"),
        )
        .select(
            "variable",
            "code",
            F.when(F.col("first_label").eqNullSafe(F.col("last_label")), F.col("first_label"))
            .otherwise(twice)
            .alias("label"),
            F.lit("code").alias("row_kind"),
            _position(F.col("code"), F.col("option_id")).alias("row_order"),
        )
    )
    asked = literal_rows(table.sparkSession, {"variable": "string"}, [[v] for v in variables])
    unknown = F.raise_error(F.concat(F.lit("variable not in the dictionary: "), F.col("variable")))
    listed = asked.join(listed, "variable", "left").withColumn(
        "code", F.coalesce("code", F.when(F.col("row_kind").isNull(), unknown.cast("string"))))
    closing = literal_rows(
        table.sparkSession,
        {"variable": "string", "code": "string", "label": "string", "row_kind": "string",
         "row_order": "double"},
        [
            [v, name, name, name.lower(), order]
            for v in variables
            for name, order in (("Total", TOTAL_ORDER), ("Base", BASE_ORDER))
        ],
    )
    rows = listed.unionByName(closing)
    if keys:
        rows = rows.join(table.select("split", "variable").distinct(), "variable")
    same = [*keys, "variable", "code", "row_kind"]
    counts = table.select(*[F.col(c).alias(f"of_{c}") for c in same], *_MEASURES)
    return rows.join(
        counts, [F.col(c).eqNullSafe(F.col(f"of_{c}")) for c in same], "left"
    ).select(*keys, *_COLUMNS)


def label_mentioned(
    table: DataFrame,
    questions: DataFrame,
    groups: Sequence[str],
    option_name: str = OPTION_NAME,
) -> DataFrame:
    """Question texts for tables of mentioned / not mentioned groups.

    A table has the options that somebody mentioned. Where nobody mentioned any,
    it lists all options of the question numbered like the group, uncounted. A table made
    with ``by`` is labelled within every split. An option with two texts stops the job.
    """
    keys, groups = _keys(table), list(groups)
    table = table.filter(F.col("variable").isin(groups))
    mentioned = table.filter((F.col("row_kind") == "code") & F.col("code").rlike(option_name))
    twice = F.raise_error(F.concat(F.lit("two texts for option "), F.col("code"))).cast("string")
    first, last = F.min("question_text"), F.max("question_text")
    texts = questions.groupBy(F.col("variable").alias("code")).agg(
        first.alias("first"), last.alias("last")
    ).select("code", F.when(F.col("first").eqNullSafe(F.col("last")), F.col("first"))
             .otherwise(twice).alias("label"))
    labelled = mentioned.join(texts, "code", "inner")

    asked = literal_rows(table.sparkSession, {"variable": "string"}, [[g] for g in groups])
    if keys:
        asked = table.select("split", "variable").distinct()
    heard = mentioned.select(*[F.col(c).alias(f"of_{c}") for c in [*keys, "variable"]]).distinct()
    silent = asked.join(
        heard, [F.col(c).eqNullSafe(F.col(f"of_{c}")) for c in [*keys, "variable"]], "left_anti"
    )
    uncounted = (
        questions.select(
            F.col("question_number").alias("variable"),
            F.col("variable").alias("code"),
            F.col("question_text").alias("label"),
        )
        .distinct()
        .join(silent, "variable")
        .withColumn("row_kind", F.lit("code"))
        .withColumn("row_order", F.lit(0.0))
    )
    closing = table.filter(F.col("row_kind") != "code").withColumn("label", F.col("code"))
    return (
        labelled.unionByName(uncounted, allowMissingColumns=True)
        .unionByName(closing)
        .select(*keys, *_COLUMNS)
    )


def _keys(table: DataFrame) -> list[str]:
    return [c for c in ("split",) if c in table.columns]


def _position(code: Column, option_id: Column) -> Column:
    out = F.when(F.lit(False), option_id)
    for i, last in enumerate(LAST_CODES):
        out = out.when(code == last, F.lit(LAST_ORDER * (i + 1)))
    return out.otherwise(option_id).cast("double")
