"""Weighted means with their deviations and errors, in two steps.

Squared distances from a mean that is not known yet lose their digits when the mean is
large. So a first, narrow scan gives every measured variable an anchor, its plain mean, one
row in all; the second scan works with answers less the anchor, which are no larger than the
data are spread. From these, with k answers, plain mean a and weight W:

    sum(w (x - a))   = k * covar_pop(w, x)
    sum(w (x - a)^2) = k * (covar_pop(w x, x) - a * covar_pop(w, x))

the weighted mean m is a step of ``sum(w (x - a)) / W`` away and
``sum(w (x - m)^2)`` is smaller by that step squared times W. The same rule merges
partial results, with the partial means in place of x. At the end the anchor is added to the
means.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from surveytab.functions.codes import (
    code_as,
    numeric_answer,
    shared_code_type,
    text_code,
)
from surveytab.functions.frames import (
    broadcast_if_bounded,
    literal_rows,
    pick,
    require_columns,
    weight_column,
)
from surveytab.operators.domain import with_dictionary_code
from surveytab.operators.packs import PackedKeys, listed_codes, pack_singly, questions_of
from surveytab.operators.tally import explode_lines, explode_slots

NO_ANSWER = (-88, -99)

WEIGHTED_MOMENTS = ("rows_weight", "answers_weight", "mean_weighted", "spread_weighted")


def means(
    df: DataFrame,
    variables: Sequence[str],
    weight: str | None = None,
    na_codes: Sequence = NO_ANSWER,
    null_weight: str = "raise",
) -> DataFrame:
    """Eight statistics per variable, one row each.

    ``n`` and ``n_weighted`` count all rows, those without an answer included, and
    both errors divide by the square root of that ``n``.
    """
    require_columns(df, variables)
    weights = {"_w": weight_column(df, weight, null_weight)}
    centres = anchors(df, variables, na_codes)
    partial = choose_weight(
        partial_means(df, variables, weights, na_codes, centres=centres),
        lambda name: F.col(f"{name}_w"),
    )
    asked = literal_rows(df.sparkSession, {"variable": "string"}, [[v] for v in variables])
    found = asked.join(partial, "variable", "left").na.fill(0, ["rows", "rows_weight"])
    return found.select("variable", *mean_statistics(centre_of("variable", centres)))


def anchors(df: DataFrame, variables: Sequence[str], na_codes: Sequence) -> dict[str, float]:
    """A number near the answers of each variable: their plain mean, from a scan of these
    columns alone. 0 without answers."""
    names = list(dict.fromkeys(variables))
    row = df.agg(*[F.avg(numeric_answer(df, v, na_codes)) for v in names]).first()
    return {v: float(a) if a is not None and math.isfinite(a) else 0.0 for v, a in zip(names, row)}


def centre_of(variable: str, centres: dict[str, float]) -> Column:
    """The anchor of the variable that a column names."""
    pairs = [F.lit(x) for pair in centres.items() for x in pair]
    return F.element_at(F.create_map(*pairs), F.col(variable))


def cross_means(
    df: DataFrame,
    options: DataFrame,
    pairs: Sequence[tuple[str, str]],
    weight: str | None = None,
    na_codes: Sequence = NO_ANSWER,
    null_weight: str = "raise",
) -> DataFrame:
    """The eight statistics of a measured variable per code of another.

    ``pairs`` are (column variable, measured variable). Codes that the dictionary
    does not list fall into the null category, which is kept. The dictionary meets only grouped
    rows; with many pairs, several column variables are counted as one key.
    """
    require_columns(df, [name for pair in pairs for name in pair])
    centres = anchors(df, [x for _, x in pairs], na_codes)
    count = _count_lines if len(pairs) <= _FEW_PAIRS else _count_packs
    partial = count(df, options, list(dict.fromkeys(pairs)), weight_column(df, weight, null_weight), na_codes, centres)
    placed = with_dictionary_code(partial, options, "col_variable", "col_code", "col_order")
    merged = merge_partial_means(
        placed, ["mean_variable", "col_variable", "col_code", "col_order"]
    )
    return merged.select(
        "mean_variable", "col_variable", "col_code", "col_order",
        *mean_statistics(centre_of("mean_variable", centres)),
    )


# With more pairs than this, several column variables are counted together.
_FEW_PAIRS = 4


def _count_lines(df, options, pairs, weight, na_codes, centres) -> DataFrame:
    """Moments by column code, from a line per row and pair."""
    kind = shared_code_type(df, [c for c, _ in pairs])
    lines = [
        {
            "pair": F.lit(i),
            "native": code_as(df, c, kind),
            "value": numeric_answer(df, x, na_codes) - F.lit(centres[x]),
        }
        for i, (c, x) in enumerate(pairs)
    ]
    return (
        explode_lines(df, {"weight": weight}, lines)
        .groupBy("pair", "native")
        .agg(*partial_columns(F.col("value"), F.col("weight")))
        .withColumn("col_variable", pick([c for c, _ in pairs], "pair"))
        .withColumn("mean_variable", pick([x for _, x in pairs], "pair"))
        .withColumn("col_code", text_code(F.col("native"), kind))
    )


def _count_packs(df, options, pairs, weight, na_codes, centres) -> DataFrame:
    """The same from a line per row, pack of column variables and measured variable."""
    columns = list(dict.fromkeys(c for c, _ in pairs))
    measured = list(dict.fromkeys(x for _, x in pairs))
    questions = questions_of(df, [(c, c) for c in columns], listed_codes(options, columns))
    keys = PackedKeys(df, questions, pack_singly(questions))
    answers = F.array(*[numeric_answer(df, x, na_codes) - F.lit(centres[x]) for x in measured])
    lines = keys.exploded({"weight": weight, "values": answers}).select(
        "weight", *keys.names, explode_slots("values").alias("slot", "value"))
    counted = lines.groupBy("slot", *keys.names).agg(*partial_columns(F.col("value"), F.col("weight")))
    asked = literal_rows(df.sparkSession, {"col_variable": "string", "mean_variable": "string"}, pairs)
    return (
        keys.spread(counted)
        .withColumn("col_variable", pick(columns, "first"))
        .withColumn("mean_variable", pick(measured, "slot"))
        .withColumnRenamed("first_code", "col_code")
        .drop("first", "second", "second_code")
        .join(broadcast_if_bounded(asked, len(pairs)), ["col_variable", "mean_variable"], "left_semi")
    )


def partial_means(
    df: DataFrame,
    variables: Sequence[str],
    weights: dict[str, Column],
    na_codes: Sequence,
    keys: dict[str, Column] | None = None,
    centres: dict[str, float] | None = None,
) -> DataFrame:
    """Mergeable moments per key and variable, all variables and weights in one
    scan. The weighted moments of each weight carry its name as a suffix. Answers are taken
    less their anchor in ``centres``."""
    require_columns(df, variables)
    keys = keys or {}
    centres = centres or dict.fromkeys(variables, 0.0)
    answers = F.array(*[
        numeric_answer(df, v, na_codes) - F.lit(centres[v]) for v in variables
    ])
    x = F.col("value")
    return (
        df.select(
            *[c.alias(k) for k, c in keys.items()],
            *[w.alias(name) for name, w in weights.items()],
            answers.alias("answers"),
        )
        .select(*keys, *weights, explode_slots("answers").alias("slot", "value"))
        .groupBy(*keys, "slot")
        .agg(*_plain_columns(x), *[c for w in weights for c in _weight_columns(x, F.col(w), w)])
        .withColumn("variable", pick(variables, "slot"))
        .drop("slot")
    )


def choose_weight(partial: DataFrame, choose: Callable[[str], Column]) -> DataFrame:
    """Settle which weight's moments to go on with; ``choose`` gets their plain name."""
    return partial.select("*", *[choose(name).alias(name) for name in WEIGHTED_MOMENTS])


def partial_columns(x: Column, w: Column) -> list[Column]:
    """Aggregates that :func:`mean_statistics` and the merge work on.

    ``rows`` and their weight count every row; ``answers`` and the moments count
    the rows that hold an answer.
    """
    return [*_plain_columns(x), *_weight_columns(x, w)]


def _plain_columns(x: Column) -> list[Column]:
    return [
        F.count(F.lit(1)).alias("rows"),
        F.count(x).alias("answers"),
        F.avg(x).alias("mean"),
        (F.var_pop(x) * F.count(x)).alias("spread"),
    ]


def _weight_columns(x: Column, w: Column, suffix: str = "") -> list[Column]:
    mean, spread = _weighted_moments(x, w)
    moments = [F.sum(w), F.sum(F.when(x.isNotNull(), w)), mean, spread]
    return [m.alias(name + suffix) for name, m in zip(WEIGHTED_MOMENTS, moments)]


def merge_partial_means(partial: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Moments of the union of groups, from the moments of each group."""
    c = F.col
    mean, between = _weighted_moments(c("mean"), c("answers").cast("double"))
    mean_w, between_w = _weighted_moments(c("mean_weighted"), c("answers_weight"))
    return partial.groupBy(*keys).agg(
        F.sum("rows").alias("rows"),
        F.sum("rows_weight").alias("rows_weight"),
        F.sum("answers").alias("answers"),
        F.sum("answers_weight").alias("answers_weight"),
        mean.alias("mean"),
        (F.sum("spread") + between).alias("spread"),
        mean_w.alias("mean_weighted"),
        (F.sum("spread_weighted") + between_w).alias("spread_weighted"),
    )


def mean_statistics(centre: Column | None = None) -> list[Column]:
    """The eight statistics from the moments; null where they are undefined. ``centre`` is the
    anchor that the answers were taken less."""
    centre = F.lit(0.0) if centre is None else centre
    c = F.col
    n = c("rows").cast("double")
    sd = F.when(c("answers") > 1, F.sqrt(c("spread") / (c("answers") - 1)))
    above_one = c("answers_weight") > 1
    sd_weighted = F.when(
        above_one, F.sqrt(c("spread_weighted") / F.when(above_one, c("answers_weight") - 1))
    )
    return [
        (centre + c("mean")).alias("mean"),
        (centre + c("mean_weighted")).alias("mean_weighted"),
        c("rows").alias("n"),
        c("rows_weight").alias("n_weighted"),
        sd.alias("sd"),
        sd_weighted.alias("sd_weighted"),
        F.try_divide(sd, F.sqrt(n)).alias("error"),
        F.try_divide(sd_weighted, F.sqrt(n)).alias("error_weighted"),
    ]


def _weighted_moments(x: Column, w: Column) -> tuple[Column, Column]:
    """Weighted mean and weighted sum of squared distances from it."""
    count, plain_mean = F.count(x), F.avg(x)
    weight = F.sum(F.when(x.isNotNull(), w))
    tilt = F.covar_pop(w, x)
    shift = F.try_divide(count * tilt, weight)
    around_plain = count * (F.covar_pop(w * x, x) - plain_mean * tilt)
    around_weighted = F.greatest(around_plain - shift * shift * weight, F.lit(0.0))
    return plain_mean + shift, F.when(shift.isNotNull(), around_weighted)
