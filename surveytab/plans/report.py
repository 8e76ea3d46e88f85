"""The split report: every table of a survey, for everybody and for each group.

A report repeats the tables of its variables inside every option of every split.
All of it comes from one scan and one grouping of the interviews:

1. each row's options in all splits are packed into one small number, so a row is
   counted once per variable and not once per variable and split;
2. rows are counted by that number, the variable and the code;
3. the few counted rows are spread over the splits and added up.

Splits whose options multiply to too many combinations are packed in several
numbers, and a row is then counted once per number.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from surveytab.functions.codes import (
    code_type,
    code_value,
    in_codes,
    native_code,
    text_code,
)
from surveytab.functions.exact import added, total, whole_parts
from surveytab.functions.frames import (
    broadcast_if_bounded,
    literal_rows,
    percent,
    require_columns,
    sql_literal,
    weight_column,
)
from surveytab.functions.names import names_a_mean, without_mention_suffix
from surveytab.plans import manifest
from surveytab.operators.means import (
    NO_ANSWER,
    anchors,
    centre_of,
    choose_weight,
    mean_statistics,
    merge_partial_means,
    partial_means,
)
from surveytab.operators.tally import (
    code_of_cell,
    explode_slots,
    is_base_cell,
    is_code_cell,
    multiple_slots,
    single_slots,
    tally,
)

# How a report names the overall split and a missing weight, and the
# notes of its description.
OVERALL = "Geral"
NO_WEIGHT = "Sem Peso"
NOTE = "Todas especificadas em 'variaveis_quero'"
NOTE_LATER = "FAZER DEPOIS"
NOTE_LATER_MARK = "X"

# Split ids are 100 * split + option; with splits of more than 99 options, the next power of
# ten takes the place of 100 for all.
_LEAST_IDS_PER_SPLIT = 100

# Combinations of options counted together, if the spec does not say. One split always fits.
# Fewer mean more lines per row before counting, more mean more counted rows to shuffle.
_MOST_COMBINATIONS = 100

# Options that are looked up in a list of literals; more are joined.
_MOST_LITERALS = 64

# Options that are numbered by one task; longer splits are cut into ranges, of about so many options or, of
# very long ones, more. Where ranges begin is taken from so many sampled options of each.
_MOST_IN_A_RANGE = 100_000
_MOST_RANGES = 1024
_SAMPLED_IN_A_RANGE = 32


@dataclass(frozen=True)
class Split:
    variable: str
    weight: str | None = None


@dataclass(frozen=True)
class ReportSpec:
    """What to report. Make one with :func:`report_spec`, which checks it."""

    splits: tuple[Split, ...]
    singles: tuple[str, ...] = ()
    multiples: dict[str, Sequence[str]] = field(default_factory=dict)
    means: tuple[str, ...] = ()
    null_weight: str = "raise"
    wanted: tuple[str, ...] = ()
    most_combinations: int | None = None

    @property
    def first(self) -> str | None:
        """The first of all variables, in the caller's order if that is known."""
        return next(iter([*self.wanted, *self.variables, *self.means]), None)

    @property
    def variables(self) -> list[str]:
        return [*self.singles, *self.multiples]

    @property
    def weights(self) -> list[str | None]:
        """The different weights in use."""
        return list(dict.fromkeys(s.weight for s in self.splits))


@dataclass(frozen=True)
class SplitOption:
    split_id: int
    split_no: int
    split: Split
    code: str


@dataclass(frozen=True)
class SplitNumbers:
    """How the options of the splits are numbered: ``unit`` ids belong to a split.

    ``table`` (split_no, split, option, option_no, split_id) is lazy and numbered in Spark, whatever the
    number of options; ``sizes`` are the numbers of options, ``short`` the options of the splits that have few.
    """

    unit: int
    sizes: dict[int, int]
    short: dict[int, tuple[str, ...]]
    table: DataFrame

    @property
    def overall_id(self) -> int:
        return self.unit + 1

    @property
    def total(self) -> int:
        return 1 + sum(self.sizes.values())

    def ids(self) -> DataFrame:
        """``split_no, split_id`` of every option, the overall one included."""
        spark, schema = self.table.sparkSession, {"split_no": "int", "split_id": "bigint"}
        overall = [[1, self.overall_id]]
        if len(self.short) == len(self.sizes):
            rows = [[n, self.unit * n + i] for n, codes in self.short.items() for i in range(1, len(codes) + 1)]
            return literal_rows(spark, schema, overall + rows)
        return literal_rows(spark, schema, overall).unionByName(self.table.select("split_no", "split_id"))


def report_spec(
    splits: Sequence[str],
    weights: Sequence[str | None],
    singles: Sequence[str] = (),
    multiples: dict[str, Sequence[str]] | None = None,
    means: Sequence[str] = (),
    null_weight: str = "raise",
    wanted: Sequence[str] = (),
    most_combinations: int | None = None,
) -> ReportSpec:
    """A checked specification; ``weights`` go with ``splits``, None or False for
    no weight. The first split is the overall one. ``wanted`` is the order of all variables,
    ``most_combinations`` how many combinations of options of several splits may be counted
    together."""
    if len(splits) != len(weights):
        raise ValueError("splits and weights must have the same length")
    if not splits or splits[0] != OVERALL:
        raise ValueError(f"the first split must be {OVERALL!r}")
    if len(set(splits)) < len(splits):
        raise ValueError("a split is given twice")
    names = [*singles, *(multiples or {})]
    if len(set(names)) < len(names):
        raise ValueError("every variable and group needs a name of its own")
    return ReportSpec(
        tuple(Split(s, w or None) for s, w in zip(splits, weights)),
        tuple(singles),
        dict(multiples or {}),
        tuple(means),
        null_weight,
        tuple(wanted),
        most_combinations,
    )


def route_variables(wanted: Sequence[str | Sequence[str]]) -> dict:
    """Sort a mixed list by shape, as arguments for :func:`report_spec`: a name is
    a single-choice question or, ending in ``m``, a mean; a list is a group, its
    name first. ``wanted`` keeps the order of the list."""
    singles, multiples, means, names = [], {}, [], []
    for item in wanted:
        name, *slots = [item] if isinstance(item, str) else item
        names.append(name)
        if slots:
            multiples[name] = slots
        elif names_a_mean(without_mention_suffix(name)):
            means.append(name)
        else:
            singles.append(name)
    return {"singles": singles, "multiples": multiples, "means": means, "wanted": names}


def number_splits(options: DataFrame, spec: ReportSpec) -> SplitNumbers:
    """The options of every split, numbered in dictionary order. Small jobs on the dictionary bring
    the numbers of options to the driver, and the options of splits that have few."""
    numbered, short, sizes = _numbered_options(options, spec)
    for number, split in enumerate(spec.splits[1:], start=2):
        if number not in sizes:
            raise ValueError(f"split {split.variable} has no options in the dictionary")
    unit = _LEAST_IDS_PER_SPLIT
    while any(n >= unit for n in sizes.values()):
        unit *= 10
    split_id = F.col("split_no").cast("bigint") * unit + F.col("option_no")
    return SplitNumbers(unit, sizes, short, numbered.withColumn("split_id", split_id))


def _numbered_options(
    options: DataFrame, spec: ReportSpec
) -> tuple[DataFrame, dict[int, tuple[str, ...]], dict[int, int]]:
    """``split_no, split, option, option_no``, lazy; the options of the splits that have few; all sizes.

    No task numbers a long split: it is cut into ranges of its order, numbered by themselves
    and moved up by the counts of the ranges before. A range is known by its first option, so a row's
    number does not depend on where or how often it is computed.
    """
    names = [[i, s.variable] for i, s in enumerate(spec.splits, start=1)][1:]
    splits = literal_rows(options.sparkSession, {"split_no": "int", "split": "string"}, names)
    listed = _listed_options(options, spec).withColumnsRenamed({"variable": "split", "code": "option"})
    listed = listed.join(broadcast_if_bounded(splits, len(names)), "split")
    in_order = ("split_no", "option_id", "option")
    most = _MOST_LITERALS * len(names)
    rows = listed.orderBy(*in_order).limit(most + 1).collect() if names else []
    if len(rows) <= most:  # that is all of them
        sizes = dict(Counter(r["split_no"] for r in rows))
    else:
        sizes = {r["split_no"]: r["count"] for r in listed.groupBy("split_no").count().collect()}
        few = F.col("split_no").isin([n for n, size in sizes.items() if size <= _MOST_LITERALS])
        rows = listed.filter(few).orderBy(*in_order).collect()
    short = {
        n: tuple(r["option"] for r in rows if r["split_no"] == n)
        for n, size in sizes.items() if size <= _MOST_LITERALS
    }
    ranged, before = _ranges(listed, {n: size for n, size in sizes.items() if size > _MOST_IN_A_RANGE})
    of_range = Window.partitionBy("split_no", "part").orderBy("option_id", "option")
    numbered = ranged.withColumn("option_no", (before + F.row_number().over(of_range)).cast("int"))
    return numbered.select("split_no", "split", "option", "option_no"), short, sizes


def _ranges(listed: DataFrame, sizes: dict[int, int]) -> tuple[DataFrame, Column]:
    """The options with their range (``part``) in the order of their split, a few ranges in a task, and how many options
    are in the ranges before: 0 for splits that are not in ``sizes``. A sample proposes where ranges begin; all are counted."""
    if not sizes:
        return listed.withColumn("part", F.lit(0)), F.lit(0)
    every = {n: max(_MOST_IN_A_RANGE, -(-size // _MOST_RANGES)) // _SAMPLED_IN_A_RANGE for n, size in sizes.items()}
    chosen = F.pmod(F.xxhash64("split_no", "option"), _by_split(every, 1)) == 0
    sample = listed.filter(F.col("split_no").isin(list(sizes)) & chosen)
    sample = sample.orderBy("split_no", "option_id", "option").collect()
    kinds = [listed.schema[name].dataType.simpleString() for name in ("option_id", "option")]
    firsts, ranges = {}, {}
    for n in sizes:
        found = [r for r in sample if r["split_no"] == n][_SAMPLED_IN_A_RANGE::_SAMPLED_IN_A_RANGE]
        ranges[n] = len(found) + 1
        if found:
            firsts[n] = F.expr("array({})".format(", ".join(
                f"struct({sql_literal(r['option_id'], kinds[0])} as option_id, {sql_literal(r['option'], kinds[1])} as option)"
                for r in found
            )))
    ranged = listed.withColumn("part", F.lit(0))
    if firsts:
        # How many of the first options are not after the row's: a search by halving.
        row = F.struct("option_id", "option")
        for k in reversed(range(max(ranges.values()).bit_length())):
            ahead = F.col("part") + (1 << k)
            reached = _by_split({n: F.get(some, ahead - 1) <= row for n, some in firsts.items()}, False)
            ranged = ranged.withColumn("part", F.when(reached, ahead).otherwise(F.col("part")))
    counted = ranged.filter(F.col("split_no").isin(list(sizes))).groupBy("split_no", "part").count()
    counts = {(r["split_no"], r["part"]): r["count"] for r in counted.collect()}
    before = {}
    for n, some in ranges.items():
        sums = accumulate((counts.get((n, i), 0) for i in range(some - 1)), initial=0)
        before[n] = F.expr(f"element_at(array({', '.join(map(str, sums))}), part + 1)")
    # A number of tasks is given, as rows here are short but what is made of an option later is not.
    return ranged.repartition(sum(ranges.values()), "split_no", "part"), _by_split(before, 0)


def _by_split(values: dict, otherwise) -> Column:
    out = F.lit(otherwise)
    for n, value in values.items():
        out = F.when(F.col("split_no") == n, value).otherwise(out)
    return out


def split_options(options: DataFrame, spec: ReportSpec) -> list[SplitOption]:
    """The numbered options of every split as a list, to look at; reports do not need it."""
    numbers = number_splits(options, spec)
    rows = numbers.table.orderBy("split_id").collect()
    return [SplitOption(numbers.overall_id, 1, spec.splits[0], "1")] + [
        SplitOption(r["split_id"], r["split_no"], spec.splits[r["split_no"] - 1], r["option"]) for r in rows
    ]


def _listed_options(options: DataFrame, spec: ReportSpec) -> DataFrame:
    """``variable, code, option_id`` of the splits' options; a code is listed once."""
    wanted = [s.variable for s in spec.splits[1:]]
    return (
        options.filter(in_codes(F.col("variable"), wanted) & F.col("code").isNotNull())
        .groupBy("variable", "code")
        .agg(F.min("option_id").alias("option_id"))
    )


def report_counts(df: DataFrame, spec: ReportSpec, numbers: SplitNumbers) -> DataFrame:
    """All counts of the report: ``split_no, split_id, variable, counts_codes,
    counts_base, code, rows, n, n_weighted``.

    Rows in no option of a split are kept under the split's id with option 0; the
    percentages of the base need them.
    """
    slots = single_slots(df, spec.singles) + multiple_slots(df, spec.multiples)
    if not slots:
        raise ValueError("no variables given")
    require_columns(df, [s.variable for s in spec.splits[1:]])
    packs = _packs(spec, numbers)
    weights = {
        f"weight_{i}": weight_column(df, w, spec.null_weight)
        for i, w in enumerate(spec.weights)
        if w is not None
    }
    packed, keys = _with_packs(df, packs, numbers)
    cells = tally(packed, slots, weights, keys)
    weight_of = {
        w: whole_parts(F.col("rows")) if w is None else F.col(f"weight_{i}")
        for i, w in enumerate(spec.weights)
    }
    places = _splits_of_packs(packs, numbers.unit)
    spread = cells.select("*", F.inline(places).alias("split_no", "split_id"))
    weight = _of_split([weight_of[s.weight] for s in spec.splits])
    return (
        spread.withColumn("split_weight", weight)
        .groupBy("split_no", "split_id", "variable", "counts_codes", "counts_base", "code")
        .agg(
            F.sum("rows").alias("rows"),
            F.sum("n").alias("n"),
            added("split_weight").alias("n_weighted"),
        )
    )


def report_frequencies(
    counts: DataFrame, options: DataFrame, spec: ReportSpec, numbers: SplitNumbers
) -> DataFrame:
    """``split_id, variable, code, n, n_weighted, pct, pct_weighted``.

    Options nobody chose have a row of zeros in every split; codes the dictionary
    does not list keep theirs. Both sides of that full join are added up in one
    grouping, the dictionary's rows as zeros.
    """
    in_an_option = _in_an_option(numbers.unit)
    found = counts.filter(is_code_cell() & in_an_option).select(
        "split_id", "variable", code_of_cell().alias("code"), "n", "n_weighted"
    )
    listed = options.filter(in_codes(F.col("variable"), spec.variables)).select("variable", "code")
    unused = (
        _grid(spec.variables, numbers).join(listed, "variable").select("split_id", "variable", "code")
        .withColumn("n", F.lit(0).cast("bigint"))
        .withColumn("n_weighted", whole_parts(F.lit(0)))
    )
    table = (
        found.unionByName(unused)
        .groupBy("split_id", "variable", "code")
        .agg(F.sum("n").alias("n"), total(added("n_weighted")).alias("n_weighted"))
    )
    answered = (
        counts.filter(is_code_cell() & in_an_option)
        .groupBy("split_id", "variable")
        .agg(F.sum("n").alias("whole"), total(added("n_weighted")).alias("whole_weight"))
    )
    answered = broadcast_if_bounded(answered, numbers.total * len(spec.variables))
    zero = F.lit(0.0)
    return table.join(answered, ["split_id", "variable"], "left").select(
        "split_id",
        "variable",
        "code",
        "n",
        "n_weighted",
        F.coalesce(percent(F.col("n"), F.col("whole")), zero).alias("pct"),
        F.coalesce(percent(F.col("n_weighted"), F.col("whole_weight")), zero).alias(
            "pct_weighted"
        ),
    )


def report_bases(
    counts: DataFrame, spec: ReportSpec, numbers: SplitNumbers
) -> DataFrame:
    """``split_id, variable, total, total_weighted, pct_base, pct_base_weighted,
    respondents``.

    ``total`` counts answers: persons for a single choice, mentions for a group.
    ``total_weighted`` is the weight of persons in both. Percentages are of the
    whole file, not of the split, so mentions may pass 100.
    """
    in_base_slot = F.col("counts_base") == 1
    whole = counts.groupBy(
        F.col("split_no").alias("of_split_no"), F.col("variable").alias("of_variable")
    ).agg(
        F.sum(F.when(in_base_slot, F.col("rows"))).alias("file_rows"),
        total(added(F.when(in_base_slot, F.col("n_weighted")))).alias("file_weight"),
    )
    found = counts.groupBy("split_id", "variable").agg(
        F.sum(F.when(is_code_cell(), F.col("n"))).alias("total"),
        total(added(F.when(is_base_cell(), F.col("n_weighted")))).alias("total_weighted"),
        F.sum(F.when(is_base_cell(), F.col("n"))).alias("respondents"),
    )
    grid = _grid(spec.variables, numbers)
    return (
        grid.join(found, ["split_id", "variable"], "left")
        .na.fill(0, ["total", "total_weighted", "respondents"])
        .join(
            whole,
            (F.col("split_no") == F.col("of_split_no"))
            & (F.col("variable") == F.col("of_variable")),
            "left",
        )
        .select(
            "split_id",
            "variable",
            "total",
            "total_weighted",
            percent(F.col("total"), F.col("file_rows")).alias("pct_base"),
            percent(F.col("total_weighted"), F.col("file_weight")).alias("pct_base_weighted"),
            "respondents",
        )
    )


def report_description(
    options: DataFrame, spec: ReportSpec, unit: int, numbers: SplitNumbers | None = None
) -> DataFrame:
    """``split_id, split_no, option_no, split, option, note, weight``, one row per split
    option, numbered in the order of the dictionary (``numbers``, if known); ``unit`` ids belong to a split."""
    note = NOTE_LATER if NOTE_LATER_MARK in (spec.first or "") else NOTE
    schema = {"split_no": "int", "split": "string", "weight": "string"}
    rows = [[i, s.variable, s.weight or NO_WEIGHT] for i, s in enumerate(spec.splits, start=1)]
    splits = literal_rows(options.sparkSession, schema, rows)
    numbered = _numbered_options(options, spec)[0] if numbers is None else numbers.table
    listed = numbered.select("split_no", "option_no", "option").join(broadcast_if_bounded(splits, len(rows)), "split_no")
    overall = splits.filter("split_no = 1").withColumns(
        {"option_no": F.lit(1), "option": F.lit(OVERALL)}
    )
    split_id = F.col("split_no").cast("bigint") * unit + F.col("option_no")
    return overall.unionByName(listed).select(
        split_id.alias("split_id"), "split_no", "option_no", "split", "option",
        F.lit(note).alias("note"), "weight",
    )


def report_moments(
    df: DataFrame, spec: ReportSpec, numbers: SplitNumbers, na_codes: Sequence = NO_ANSWER
) -> DataFrame:
    """Mergeable moments of the mean variables by split option (``split_no, split_id, variable``), answers
    taken less ``centre``."""
    if not spec.means:
        raise ValueError("no mean variables given")
    require_columns(df, [s.variable for s in spec.splits[1:]])
    packs = _packs(spec, numbers)
    packed, keys = _with_packs(df, packs, numbers)
    weights = {
        f"_{i}": weight_column(df, w, spec.null_weight) for i, w in enumerate(spec.weights)
    }
    centres = anchors(df, spec.means, na_codes)
    partial = partial_means(packed, spec.means, weights, na_codes, keys, centres)
    places = _splits_of_packs(packs, numbers.unit)
    spread = partial.select("*", F.inline(places).alias("split_no", "split_id"))
    spread = choose_weight(
        spread.filter(_in_an_option(numbers.unit)),
        lambda name: _of_split(
            [F.col(f"{name}_{spec.weights.index(s.weight)}") for s in spec.splits]
        ),
    )
    merged = merge_partial_means(spread, ["split_no", "split_id", "variable"])
    return merged.withColumn("centre", centre_of("variable", centres))


def report_means(moments: DataFrame, spec: ReportSpec, numbers: SplitNumbers) -> DataFrame:
    """The eight mean statistics of the mean variables in every split option, from the moments of one or
    several sets of interviews."""
    together = Window.partitionBy("split_id", "variable")
    placed = moments.withColumn("place", F.min("centre").over(together))
    shift = F.col("centre") - F.col("place")
    merged = merge_partial_means(
        placed.withColumns({m: F.col(m) + shift for m in ("mean", "mean_weighted")}),
        ["split_id", "variable", "place"],
    )
    grid = _grid(list(spec.means), numbers).drop("split_no")
    found = grid.join(merged, ["split_id", "variable"], "left")
    return found.na.fill(0, ["rows", "rows_weight"]).select(
        "split_id", "variable", *mean_statistics(F.coalesce("place", F.lit(0.0)))
    )


@dataclass(frozen=True)
class Report:
    """The tables of a report, all lazy; ``means`` is None without mean variables."""

    frequencies: DataFrame
    bases: DataFrame
    description: DataFrame
    means: DataFrame | None = None

    def tables(self) -> dict[str, DataFrame]:
        tables = {
            "frequencies": self.frequencies,
            "bases": self.bases,
            "description": self.description,
            "means": self.means,
        }
        return {name: table for name, table in tables.items() if table is not None}


def build_report(
    df: DataFrame, options: DataFrame, spec: ReportSpec, counts: DataFrame | None = None
) -> Report:
    """The whole report. ``counts`` may be passed to build on saved counts: frequencies and
    bases are separate lazy tables and would each scan the interviews."""
    numbers = number_splits(options, spec)
    if counts is None:
        counts = report_counts(df, spec, numbers)
    return Report(
        report_frequencies(counts, options, spec, numbers),
        report_bases(counts, spec, numbers),
        report_description(options, spec, numbers.unit, numbers),
        report_means(report_moments(df, spec, numbers), spec, numbers) if spec.means else None,
    )


# --- stored reports ---------------------------------------------------------------


def write_report(
    df: DataFrame, options: DataFrame, spec: ReportSpec, path: str, mode: str = "errorifexists"
) -> Report:
    """Write the counts of a report, and every table of it as Parquet, under ``path``.

    The counts are written first and the tables made from them, so the interviews are scanned once for all
    frequencies and bases. The report is there when its entry in the manifest is, which comes last: a run
    that failed half way is in nobody's way, in either mode. ``mode`` is ``errorifexists``, tested before
    anything is counted, or ``overwrite``, which takes the place of all batches under ``path``.
    """
    if mode not in ("errorifexists", "overwrite"):
        raise ValueError("mode must be 'errorifexists' or 'overwrite'")
    spark = df.sparkSession
    older = manifest.entries(spark, path)
    if older and mode == "errorifexists":
        raise ValueError(f"a report already exists under {path}")
    run = _write_run(df, options, spec, path)
    report = _report_of_runs(spark, options, spec, path, [run])
    _write_tables(report, path)
    manifest.commit(spark, path, ALL, run, _fingerprint(spec))
    for batch in older:
        if batch != ALL:
            manifest.commit(spark, path, batch, None, "")
    manifest.remove_unused(spark, path)
    return report


# The batch of a report that is written at once.
ALL = "all interviews"


def add_batch(df: DataFrame, options: DataFrame, spec: ReportSpec, path: str, batch: str) -> None:
    """Count a batch of interviews into the report under ``path``; one that is there already is replaced,
    without effect on the others. All batches must have the same specification; the dictionary may grow:
    counts are kept by the options' codes, and numbered when the report is read."""
    spark = df.sparkSession
    if any(text != _fingerprint(spec) for _, text in manifest.entries(spark, path).values()):
        raise ValueError("the report has batches of another specification")
    manifest.commit(spark, path, batch, _write_run(df, options, spec, path), _fingerprint(spec))


def remove_batch(spark, path: str, batch: str) -> None:
    if batch not in manifest.entries(spark, path):
        raise ValueError(f"no batch {batch}")
    manifest.commit(spark, path, batch, None, "")


def stored_report(options: DataFrame, spec: ReportSpec, path: str) -> Report:
    """The report of all batches under ``path`` together, from their counts: no interview is read again."""
    spark = options.sparkSession
    found = manifest.entries(spark, path)
    if not found:
        raise ValueError(f"no report under {path}")
    if any(text != _fingerprint(spec) for _, text in found.values()):
        raise ValueError("the report has batches of another specification")
    return _report_of_runs(spark, options, spec, path, sorted(run for run, _ in found.values()))


def refresh_tables(options: DataFrame, spec: ReportSpec, path: str) -> Report:
    """Write the tables of all batches together, in place of those under ``path``."""
    report = stored_report(options, spec, path)
    _write_tables(report, path)
    return report


def _fingerprint(spec: ReportSpec) -> str:
    """What must agree for counts to be added up."""
    return repr((spec.splits, spec.singles, {k: tuple(v) for k, v in spec.multiples.items()}, spec.means, spec.null_weight))


def _write_tables(report: Report, path: str) -> None:
    for name, table in report.tables().items():
        table.write.mode("overwrite").parquet(f"{path}/{name}")


def _write_run(df: DataFrame, options: DataFrame, spec: ReportSpec, path: str) -> str:
    numbers, run = number_splits(options, spec), uuid.uuid4().hex
    counts = _by_code(report_counts(df, spec, numbers), spec, numbers)
    counts.write.parquet(f"{path}/counts/run={run}")
    if spec.means:
        moments = _by_code(report_moments(df, spec, numbers), spec, numbers)
        moments.write.parquet(f"{path}/moments/run={run}")
    return run


def _report_of_runs(spark, options, spec, path, runs) -> Report:
    numbers = number_splits(options, spec)

    def stored(kind: str) -> DataFrame:
        return _by_id(spark.read.parquet(*[f"{path}/{kind}/run={r}" for r in runs]), spec, numbers)

    counts = (
        stored("counts")
        .groupBy("split_no", "split_id", "variable", "counts_codes", "counts_base", "code")
        .agg(F.sum("rows").alias("rows"), F.sum("n").alias("n"), added("n_weighted").alias("n_weighted"))
    )
    means = None
    if spec.means:
        means = report_means(stored("moments").filter(_in_an_option(numbers.unit)), spec, numbers)
    return Report(
        report_frequencies(counts, options, spec, numbers),
        report_bases(counts, spec, numbers),
        report_description(options, spec, numbers.unit, numbers),
        means,
    )


def _by_code(found: DataFrame, spec: ReportSpec, numbers: SplitNumbers) -> DataFrame:
    """Split and option by name in place of their numbers; the option is null for rows in none."""
    names = numbers.table.select(F.col("split_id").alias("of_id"), "option")
    split = F.element_at(F.array(*[F.lit(s.variable) for s in spec.splits]), F.col("split_no"))
    return found.join(names, F.col("split_id") == F.col("of_id"), "left").withColumn("split", split).drop(
        "split_no", "split_id", "of_id")


def _by_id(found: DataFrame, spec: ReportSpec, numbers: SplitNumbers) -> DataFrame:
    """The numbers that split and option have now; options the dictionary no longer has are none."""
    places = F.array(*[F.lit(s.variable) for s in spec.splits])
    numbered = found.withColumn("split_no", F.array_position(places, F.col("split")).cast("int"))
    ids = numbers.table.select(F.col("split").alias("of_split"), F.col("option").alias("of_option"), "split_id")
    same = (F.col("split") == F.col("of_split")) & (F.col("option") == F.col("of_option"))
    none = F.when(F.col("split_no") == 1, F.lit(numbers.overall_id)).otherwise(F.col("split_no") * numbers.unit)
    return (
        numbered.join(ids, same, "left")
        .withColumn("split_id", F.coalesce("split_id", none.cast("bigint")))
        .drop("split", "option", "of_split", "of_option")
    )


def _of_split(per_split: Sequence[Column]) -> Column:
    """The column that belongs to the row's split."""
    return F.element_at(F.array(*per_split), F.col("split_no"))


def _in_an_option(unit: int) -> Column:
    """Tested on a sum, to stay above the grouping like the cell tests."""
    return (F.col("split_id") % unit) * F.col("rows") > 0


def _grid(variables: Sequence[str], numbers: SplitNumbers) -> DataFrame:
    """Every split option with every variable of the spec."""
    names = F.array(*[F.lit(v) for v in variables])
    return numbers.ids().select("*", F.explode(names).alias("variable"))


@dataclass(frozen=True)
class _Packed:
    """A split inside a pack: option = pack // stride % size, 0 for no option. ``codes`` is None for
    a split of many options, which are joined."""

    split_no: int
    variable: str
    codes: tuple[str, ...] | None
    size: int
    stride: int


def _packs(spec: ReportSpec, numbers: SplitNumbers) -> list[list[_Packed]]:
    """Splits gathered in packs of few combinations. The overall split has one
    option that every row is in; it rides on the first pack."""
    most = spec.most_combinations or _MOST_COMBINATIONS
    packs: list[list[_Packed]] = [[]]
    room = most
    for number, split in enumerate(spec.splits[1:], start=2):
        size = numbers.sizes[number] + 1
        if packs[-1] and size > room:
            packs.append([])
            room = most
        stride = 1
        for other in packs[-1]:
            stride *= other.size
        packs[-1].append(_Packed(number, split.variable, numbers.short.get(number), size, stride))
        room //= size
    return packs


def _with_packs(df: DataFrame, packs, numbers: SplitNumbers) -> tuple[DataFrame, dict[str, Column]]:
    """The rows with their pack number and combination, as grouping keys."""
    places = {}
    for packed in (p for pack in packs for p in pack):
        df, places[packed.split_no] = _option_index(df, packed, numbers)
    combos = [
        reduce(
            lambda a, b: a + b,
            [places[p.split_no] * F.lit(p.stride) for p in pack],
            F.lit(0).cast("bigint"),
        )
        for pack in packs
    ]
    if len(packs) == 1:
        return df, {"combo": combos[0]}
    exploded = df.withColumn("_combos", F.array(*combos)).select(
        "*", explode_slots("_combos").alias("_pack", "_combo")
    )
    return exploded, {"pack": F.col("_pack"), "combo": F.col("_combo")}


def _option_index(df: DataFrame, packed: _Packed, numbers: SplitNumbers) -> tuple[DataFrame, Column]:
    """Position of the row's code among the split's options, from 1; else 0.

    Some options are a list of literals; many are a table to join, never on the driver. Options that
    no value of the column's type is written as, such as whole numbers beyond its range, are nobody's.
    """
    kind = code_type(df.schema[packed.variable].dataType)
    native = native_code(df, packed.variable)
    if packed.codes is not None:
        literals = ", ".join(sql_literal(code_value(code, kind), kind) for code in packed.codes)
        position = F.array_position(F.expr(f"array({literals})"), native)
    else:
        name = f"_place_{packed.split_no}"
        value = F.expr(f"try_cast(option as {kind})")
        listed = (
            numbers.table.filter(F.col("split_no") == packed.split_no)
            .select(value.alias(f"{name}_of"), F.col("option_no").cast("bigint").alias(name), "option")
            .filter(text_code(F.col(f"{name}_of"), kind) == F.col("option")).drop("option")
        )
        listed = broadcast_if_bounded(listed, packed.size)
        df = df.join(listed, native == F.col(f"{name}_of"), "left").drop(f"{name}_of")
        position = F.col(name)
    return df, F.coalesce(position, F.lit(0)).cast("bigint")


def _splits_of_packs(packs, unit: int) -> Column:
    """Array of (split_no, split_id) that a counted row belongs to."""
    def splits(pack, with_overall):
        entries = [(1, F.lit(unit + 1))] if with_overall else []
        entries += [
            (
                p.split_no,
                F.lit(unit * p.split_no) + F.expr(f"combo div {p.stride}") % p.size,
            )
            for p in pack
        ]
        return F.array(
            *[F.struct(F.lit(n).alias("split_no"), i.cast("bigint").alias("split_id"))
              for n, i in entries]
        )

    if len(packs) == 1:
        return splits(packs[0], True)
    out = F.when(F.col("pack") == 0, splits(packs[0], True))
    for i, pack in enumerate(packs[1:], start=1):
        out = out.when(F.col("pack") == i, splits(pack, False))
    return out
