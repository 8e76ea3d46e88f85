"""Weighted frequency tables with their Total and Base rows.

Three kinds of question, three meanings of "base"; they are kept apart:

* single choice: percentages over the answers given;
* multiple response: a person fills several slots. *Mentions* are counted, so a
  code given twice counts twice, and percentages are over mentions; the Base row
  counts *persons* with at least one slot filled;
* mentioned / not mentioned: one 0/1 column per option. Percentages are over the
  persons who answered any of them and may add up to more than 100.

All return ``variable, code, row_kind, row_order, n, n_weighted, pct,
pct_weighted``, preceded by ``split`` when ``by`` names a column. ``row_kind`` is
``code``, ``total`` or ``base``; :func:`in_table_order` sorts for reading.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from surveytab.functions.codes import canonical_code
from surveytab.functions.exact import added, total
from surveytab.functions.frames import (
    broadcast_if_bounded,
    literal_rows,
    percent,
    require_columns,
    weight_column,
)
from surveytab.functions.names import group_name
from surveytab.operators.tally import (
    code_of_cell,
    is_base_cell,
    is_code_cell,
    mentioned_slots,
    multiple_slots,
    single_slots,
    tally,
)

# After all codes; ``row_order`` is a double.
TOTAL_ORDER, BASE_ORDER = 1e300, 2e300

Groups = dict[str, Sequence[str]] | Sequence[Sequence[str]]


def frequencies(
    df: DataFrame,
    singles: Sequence[str] = (),
    multiples: Groups = (),
    mentioned: Groups = (),
    weight: str | None = None,
    by: str | None = None,
    null_weight: str = "raise",
) -> DataFrame:
    """Tables of any number of questions of all kinds, from one scan."""
    multiples, mentioned = _named(multiples), _named(mentioned)
    used = [*singles, *sum(map(list, [*multiples.values(), *mentioned.values()]), [])]
    require_columns(df, [*used, *([by] if by else [])])
    variables = [*singles, *multiples, *mentioned]
    if not variables:
        raise ValueError("no variables given")
    if len(set(variables)) < len(variables):
        raise ValueError("every variable and group needs a name of its own")

    slots = (
        single_slots(df, singles) + multiple_slots(df, multiples) + mentioned_slots(df, mentioned)
    )
    keys = {"split": canonical_code(df, by)} if by else {}
    weights = {"n_weighted": weight_column(df, weight, null_weight)}
    cells = tally(df, slots, weights, keys)
    return _with_total_and_base(cells, list(keys), variables, list(mentioned))


def single_frequencies(df, variables: Sequence[str], weight=None, by=None, null_weight="raise"):
    """Tables of single-choice questions."""
    return frequencies(df, singles=variables, weight=weight, by=by, null_weight=null_weight)


def multiple_frequencies(df, groups: Groups, weight=None, by=None, null_weight="raise"):
    """Tables of multiple-response groups, ``{name: [slot columns]}``."""
    return frequencies(df, multiples=groups, weight=weight, by=by, null_weight=null_weight)


def mentioned_frequencies(df, groups: Groups, weight=None, by=None, null_weight="raise"):
    """Tables of mentioned / not mentioned groups, ``{name: [0/1 columns]}``."""
    return frequencies(df, mentioned=groups, weight=weight, by=by, null_weight=null_weight)


def in_table_order(table: DataFrame) -> DataFrame:
    """Codes in ascending order, then the Total row, then the Base row."""
    first = [c for c in ("split_id", "split") if c in table.columns]
    return table.orderBy(*first, "variable", "row_order", "code")


def _named(groups: Groups) -> dict[str, Sequence[str]]:
    named = dict(groups) if isinstance(groups, dict) else {group_name(g): g for g in groups}
    if not isinstance(groups, dict) and len(named) < len(groups):
        raise ValueError("unnamed groups would share a name; pass a dict")
    if any(not columns for columns in named.values()):
        raise ValueError("a group needs at least one column")
    return named


def _with_total_and_base(cells, keys, variables, mentioned) -> DataFrame:
    is_code, is_base = is_code_cell(), is_base_cell()
    in_base_slot = F.col("counts_base") == 1
    totals = cells.groupBy(*keys, "variable").agg(
        F.sum(F.when(is_code, F.col("n"))).alias("codes_n"),
        total(added(F.when(is_code, F.col("n_weighted")))).alias("codes_weight"),
        F.sum(F.when(is_base, F.col("n"))).alias("base_n"),
        total(added(F.when(is_base, F.col("n_weighted")))).alias("base_weight"),
        F.sum(F.when(in_base_slot, F.col("rows"))).alias("all_n"),
        total(added(F.when(in_base_slot, F.col("n_weighted")))).alias("all_weight"),
    )
    # What a percentage is taken of: the persons for mentioned groups, else the
    # answers counted.
    over_persons = F.col("variable").isin(list(mentioned)) if mentioned else F.lit(False)
    totals = totals.withColumn(
        "whole_n", F.when(over_persons, F.col("base_n")).otherwise(F.col("codes_n"))
    ).withColumn(
        "whole_weight", F.when(over_persons, F.col("base_weight")).otherwise(F.col("codes_weight"))
    )

    shares = totals.select(
        *[F.col(k).alias(f"of_{k}") for k in keys],
        F.col("variable").alias("of_variable"),
        "whole_n",
        "whole_weight",
    )
    if not keys:
        # One row per variable asked for; the code rows need not be shuffled.
        shares = broadcast_if_bounded(shares, len(variables))
    same = [F.col("variable") == F.col("of_variable")]
    same += [F.col(k).eqNullSafe(F.col(f"of_{k}")) for k in keys]
    code_rows = cells.filter(is_code).join(shares, same, "inner").select(
        *keys,
        "variable",
        code_of_cell().alias("code"),
        F.lit("code").alias("row_kind"),
        "row_order",
        "n",
        total("n_weighted").alias("n_weighted"),
        percent(F.col("n"), F.col("whole_n")).alias("pct"),
        percent(total("n_weighted"), F.col("whole_weight")).alias("pct_weighted"),
    )

    if not keys:
        # A table without a single row still has its empty Total and Base.
        asked = literal_rows(cells.sparkSession, {"variable": "string"}, [[v] for v in variables])
        totals = asked.join(totals, "variable", "left")

    total_row = _summary(
        "Total", TOTAL_ORDER, "codes_n", "codes_weight", "whole_n", "whole_weight"
    )
    base = _summary("Base", BASE_ORDER, "base_n", "base_weight", "all_n", "all_weight")
    summary_rows = totals.selectExpr(*keys, "variable", f"inline(array({total_row}, {base}))")
    return code_rows.unionByName(summary_rows)


def _summary(label: str, order: int, n: str, weight: str, of_n: str, of_weight: str) -> str:
    """SQL for a Total or Base row, all null when nothing was counted."""
    def filled(value: str) -> str:
        return f"if(codes_n > 0, {value}, null)"

    def share(part: str, whole: str) -> str:
        return f"try_divide(100.0D * {part}, cast({whole} AS double))"

    return (
        f"named_struct('code', '{label}', 'row_kind', '{label.lower()}', 'row_order', double('{order}'), "
        f"'n', {filled(n)}, 'n_weighted', {filled(weight)}, "
        f"'pct', {filled(share(n, of_n))}, "
        f"'pct_weighted', {filled(share(weight, of_weight))})"
    )
