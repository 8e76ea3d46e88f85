"""Trimmed weighted means without sorting the data.

Trimming keeps what lies in tiles 1 to 97 of 100, numbers the tiles anew on what is
left and drops the first two. How many rows that is at each end follows from the
number of answers alone, so a trimmed mean needs two cut points per variable: the
last row dropped at the bottom and the last row kept at the top.

A cut point is searched for by rank. While many rows are in question, a quantile
sketch proposes two pivots around the rank, and one counting pass says exactly on
which side, at, or between which of them the cut lies; each round leaves a few
rows in ten thousand. Once few enough rows are left, they are sorted and the cut
is read off. Only those few rows are ever shuffled: everything else is partial
aggregation. A value shared by very many rows is itself a pivot, and the search
goes on among its rows along the tie-breaking columns.

The driver sees a row per variable and round. The input is scanned several
times, one column wide, and must give the same rows every time. Once both cuts of a variable
have bounds, scans ask the source only for answers between them.
"""

from __future__ import annotations

import math
import operator
from collections.abc import Sequence
from dataclasses import dataclass, field
from decimal import ROUND_CEILING, ROUND_FLOOR, Decimal, localcontext
from functools import partial, reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from surveytab.functions.codes import canonical_code, column, literal_code, numeric_answer
from surveytab.functions.frames import (
    literal_rows,
    pick,
    require_columns,
    sql_literal,
    weight_column,
)
from surveytab.operators.means import (
    NO_ANSWER,
    centre_of,
    mean_statistics,
    partial_columns,
)
from surveytab.operators.tally import explode_slots

# Tiles kept of 100, from the top; tiles dropped of 100, from the bottom.
_KEPT_TILES, _DROPPED_TILES = 97, 2

# Bits of a whole number that a double, and with it a quantile sketch, can hold.
_EXACT_BITS = 53


def rows_trimmed(answers: int) -> tuple[int, int]:
    """How many of the smallest and of the largest answers are dropped."""
    per_tile, larger_tiles = divmod(answers, 100)
    top = (100 - _KEPT_TILES) * per_tile + max(0, larger_tiles - _KEPT_TILES)
    per_tile, larger_tiles = divmod(answers - top, 100)
    bottom = _DROPPED_TILES * per_tile + min(_DROPPED_TILES, larger_tiles)
    return bottom, top


def trimmed_means(
    df: DataFrame,
    variables: Sequence[str],
    order_by: Sequence[str],
    weight: str | None = None,
    na_codes: Sequence = NO_ANSWER,
    null_weight: str = "raise",
    sortable: int = 100_000,
    accuracy: int = 10_000,
) -> DataFrame:
    """The eight statistics of each variable after trimming.

    ``order_by`` names number, date or time columns that tell equal answers apart;
    together with the answer they must identify a row wherever a cut falls among
    equal answers. Up to ``sortable`` rows per cut are sorted; ``accuracy`` is that
    of the quantile sketch. Rows without an answer are dropped before trimming.
    """
    moments, centres = _trimmed(
        df, variables, order_by, F.lit(0), 1, weight, na_codes, null_weight, sortable, accuracy
    )
    asked = literal_rows(df.sparkSession, {"variable": "string"}, [[v] for v in variables])
    found = asked.join(
        moments.withColumn("variable", pick(variables, "slot")), "variable", "left"
    ).na.fill(0, ["rows", "rows_weight"])
    centre = centre_of("variable", dict(zip(variables, centres)))
    return found.select("variable", *mean_statistics(centre))


def trimmed_means_by(
    df: DataFrame,
    variables: Sequence[str],
    by: str,
    order_by: Sequence[str],
    weight: str | None = None,
    splits: Sequence | None = None,
    na_codes: Sequence = NO_ANSWER,
    null_weight: str = "raise",
    sortable: int = 100_000,
    accuracy: int = 10_000,
) -> DataFrame:
    """``split, variable`` and the eight statistics: every variable trimmed within each code of ``by``.

    All splits are searched side by side, in as many looks as one needs. ``splits`` are the codes wanted, by
    default all that are found, 10 000 at most: a row per split and variable goes through the driver. Interviews
    without a code, or in no split listed, are left out.
    """
    require_columns(df, [*variables, *order_by, by])
    code = canonical_code(df, by)
    if splits is None:
        rows = df.select(code.alias("c")).filter("c is not null").distinct().limit(_MOST_SPLITS + 1).collect()
        if len(rows) > _MOST_SPLITS:
            raise ValueError(f"{by} has more than {_MOST_SPLITS} codes: list the ones wanted")
        splits = sorted(r["c"] for r in rows)
    codes = list(dict.fromkeys(map(literal_code, splits)))
    if not codes:
        raise ValueError(f"{by} has no codes")
    lookup = F.expr(f"array({', '.join(map(sql_literal, codes))})")
    place = F.array_position(lookup, code).cast("int") - 1
    moments, centres = _trimmed(
        df.filter(place >= 0), variables, order_by, place, len(codes), weight, na_codes, null_weight, sortable, accuracy
    )
    slots = [[i, c, v] for i, (c, v) in enumerate((c, v) for c in codes for v in variables)]
    asked = literal_rows(df.sparkSession, {"slot": "int", "split": "string", "variable": "string"}, slots)
    found = asked.join(moments, "slot", "left").na.fill(0, ["rows", "rows_weight"])
    return found.select("split", "variable", *mean_statistics(pick(centres, "slot", "double")))


_MOST_SPLITS = 10_000


def _trimmed(df, variables, order_by, place, splits, weight, na_codes, null_weight, sortable, accuracy):
    """Moments by slot, and the number that each slot's answers were taken less. A slot is a variable in a
    split; ``place`` tells the split, from 0."""
    require_columns(df, [*variables, *order_by])
    keys = [f"key_{i}" for i in range(len(order_by))]
    answers = F.array(*[numeric_answer(df, v, na_codes) for v in variables])

    def long_rows(cuts: Sequence[_Cut] = ()) -> DataFrame:
        """One row per answer; with ``cuts``, of interviews that these may still fall on."""
        return (
            _near_cuts(df, variables, na_codes, cuts).select(
                weight_column(df, weight, null_weight).alias("weight"),
                *[column(name).alias(key) for name, key in zip(order_by, keys)],
                (place * len(variables)).alias("first"),
                answers.alias("answers"),
            )
            .select("weight", *keys, "first", explode_slots("answers").alias("at", "value"))
            .filter(F.col("value").isNotNull())
            .select("weight", *keys, (F.col("first") + F.col("at")).alias("slot"), "value")
        )

    order = [("value", "double", F.col("value"))]
    for name, key in zip(order_by, keys):
        order += _tie_columns(name, key, df.schema[name].dataType, len(order))
    cuts = _first_look(long_rows(), splits * len(variables), accuracy)
    _search(long_rows, order, cuts, sortable, accuracy)

    # Deviations are taken from a value that the answers kept lie around: their upper end.
    centres = [
        c.point[0] if c.point and math.isfinite(c.point[0]) else 0.0 for c in cuts[1::2]
    ]
    kept = long_rows().filter(_up_to_cut(order, cuts[1::2]) & ~_up_to_cut(order, cuts[0::2]))
    moments = kept.groupBy("slot").agg(
        *partial_columns(F.col("value") - pick(centres, "slot", "double"), F.col("weight"))
    )
    return moments, centres


# A column of the order: its name, its type and how a row's value comes about. It is
# worked out only for rows that earlier columns leave in question.
_Order = list[tuple[str, str, Column]]


@dataclass
class _Cut:
    """A point in the order: ``rank`` rows of the ``size`` in question lie up to it.

    In question are the rows that equal ``point`` in the leading columns and whose
    next column lies strictly between ``low`` and ``high``.
    """

    number: int
    slot: int
    rank: int
    size: int
    point: list = field(default_factory=list)
    low: float | int | None = None
    high: float | int | None = None
    pivots: tuple | None = None

    @property
    def nothing(self) -> bool:
        return not self.point and self.rank == 0

    @property
    def found(self) -> bool:
        no_bounds = self.low is None and self.high is None
        return self.nothing or (bool(self.point) and no_bounds and self.rank == self.size)

    def settle(self, value, below: int, equal: int) -> None:
        """The cut lies among the rows whose next column equals ``value``."""
        self.point.append(value)
        self.rank, self.size = self.rank - below, equal
        self.low = self.high = None

    def narrow(self, low, high, below: int, size: int) -> None:
        self.low = self.low if low is None else low
        self.high = self.high if high is None else high
        self.rank, self.size = self.rank - below, size


def _first_look(long: DataFrame, variables: int, accuracy: int) -> list[_Cut]:
    """Two cuts per variable, from its number of answers, and first pivots for them.

    The same pass gives both: with many answers the shares cut off hardly depend on
    their number, and pivots that miss a cut only cost a round.
    """
    top = _KEPT_TILES / 100
    shares = (top * _DROPPED_TILES / 100, top)
    fractions = [f for share in shares for f in _around(share, accuracy)]
    looked = long.groupBy("slot").agg(
        F.count(F.lit(1)).alias("total"),
        F.percentile_approx("value", fractions, accuracy).alias("at"),
    )
    seen = {r["slot"]: (r["total"], r["at"]) for r in looked.collect()}
    cuts = []
    for slot in range(variables):
        total, at = seen.get(slot, (0, [None] * 4))
        bottom, top = rows_trimmed(total)
        for rank, pivots in ((bottom, at[:2]), (total - top, at[2:])):
            cuts.append(_Cut(len(cuts), slot, rank, total, pivots=tuple(pivots)))
    return cuts


def _around(share: float, accuracy: int) -> tuple[float, float]:
    """Shares on both sides, as far off as the sketch may err, twice over."""
    margin = 2.0 / accuracy
    return max(0.0, share - margin), min(1.0, share + margin)


def _search(long_rows, order: _Order, cuts: list[_Cut], sortable: int, accuracy: int):
    while open_cuts := [c for c in cuts if not c.found]:
        level = min(len(c.point) for c in open_cuts)
        if level == len(order):
            raise ValueError("order_by does not tell the rows at a cut apart")
        here = [c for c in open_cuts if len(c.point) == level]
        before = [(len(c.point), c.size, c.low, c.high, c.rank) for c in here]
        few = [c for c in here if c.size <= sortable]
        many = [c for c in here if c.size > sortable]
        if few:
            _read_off(long_rows(few), order, level, cuts, few)
        if many:
            _count_round(long_rows(many), order, level, cuts, many, accuracy)
        if before == [(len(c.point), c.size, c.low, c.high, c.rank) for c in here]:
            raise RuntimeError("a look at the rows settled nothing: did the input change?")


def _near_cuts(df, variables, na_codes, cuts: Sequence[_Cut]) -> DataFrame:
    """The interviews with an answer that one of the cuts may fall on, if all have bounds. Plain
    comparisons of a column with literals, which the source can use."""
    places: dict[tuple, Column] = {}
    for cut in cuts:
        name = variables[cut.slot % len(variables)]
        if not cut.point and cut.low is None and cut.high is None:
            return df
        bounds = (name, cut.point[0] if cut.point else None, cut.low, cut.high)
        if bounds not in places:
            places[bounds] = _within(df, name, na_codes, *bounds[1:])
    return df.filter(reduce(operator.or_, places.values())) if places else df


def _within(df: DataFrame, name: str, na_codes, point, low, high) -> Column:
    """Is the answer the point, or between the bounds? For whole and decimal numbers the bounds are numbers
    of the column's own type, no narrower than the doubles: the test may let pass a little more."""
    data_type = df.schema[name].dataType
    if isinstance(data_type, (T.DoubleType, T.IntegralType, T.DecimalType)):
        value = column(name)
    else:
        value = numeric_answer(df, name, na_codes)
    if isinstance(data_type, T.IntegralType):
        below, above = _whole_below, _whole_above
    elif isinstance(data_type, T.DecimalType):
        below, above = (partial(f, data_type) for f in (_decimal_below, _decimal_above))
    else:
        if point is not None:
            return value == F.lit(point)
        return (value > F.lit(low) if low is not None else F.lit(True)) & (
            value < F.lit(high) if high is not None else F.lit(True))
    low, high = (point, point) if point is not None else (low, high)
    least = below(low) if low is not None else None
    most = above(high) if high is not None else None
    return (value >= least if least is not None else F.lit(True)) & (
        value <= most if most is not None else F.lit(True))


def _whole_below(bound: float) -> Column | None:
    """A whole number no larger than any that is a double of ``bound`` or more."""
    bound = bound if abs(bound) < 2.0**53 else math.nextafter(bound, -math.inf)
    return F.lit(math.floor(bound)) if abs(bound) < 2.0**63 else None


def _whole_above(bound: float) -> Column | None:
    bound = bound if abs(bound) < 2.0**53 else math.nextafter(bound, math.inf)
    return F.lit(math.ceil(bound)) if abs(bound) < 2.0**63 else None


def _decimal_bound(data_type: T.DecimalType, bound: float, rounding: str) -> Column | None:
    if not math.isfinite(bound):
        return None
    with localcontext() as context:
        context.prec = 400
        value = Decimal(bound).quantize(Decimal(1).scaleb(-data_type.scale), rounding)
    if abs(value) >= Decimal(10) ** (data_type.precision - data_type.scale):
        return None
    return F.expr(f"cast('{value:f}' as decimal({data_type.precision},{data_type.scale}))")


def _decimal_below(data_type: T.DecimalType, bound: float) -> Column | None:
    return _decimal_bound(data_type, math.nextafter(bound, -math.inf), ROUND_FLOOR)


def _decimal_above(data_type: T.DecimalType, bound: float) -> Column | None:
    return _decimal_bound(data_type, math.nextafter(bound, math.inf), ROUND_CEILING)


def _in_question(order, level, cuts, active) -> list[Column]:
    """May the lower, the upper cut of the row's variable still fall on the row?"""
    value, kind = order[level][2], order[level][1]
    numbers = {c.number for c in active}
    out = []
    for side in (0, 1):
        mine = cuts[side::2]
        inside = pick([c.number in numbers for c in mine], "slot", "boolean")
        for i, (_, k, v) in enumerate(order[:level]):
            points = [c.point[i] if len(c.point) > i else None for c in mine]
            inside = inside & F.coalesce(v == pick(points, "slot", k), F.lit(False))
        low = pick([c.low if c.number in numbers else None for c in mine], "slot", kind)
        high = pick([c.high if c.number in numbers else None for c in mine], "slot", kind)
        out.append(inside & (low.isNull() | (value > low)) & (high.isNull() | (value < high)))
    return out


def _read_off(long, order, level, cuts, few) -> None:
    """Sort the few rows left and take the one at the rank."""
    names = [name for name, _, _ in order[level:]]
    lower, upper = _in_question(order, level, cuts, few)
    number = F.col("slot") * 2
    rows = (
        long.filter(lower | upper)
        .withColumn("cut", F.explode(F.array_compact(F.array(
            F.when(lower, number), F.when(upper, number + 1)))))
        .select("cut", *[v.alias(name) for name, _, v in order[level:]])
    )
    # Rows alike in all columns are peers of this frame and share its count.
    upto = Window.partitionBy("cut").orderBy(*names)
    rank = pick([c.rank for c in cuts], "cut", "bigint")
    at_rank = (
        rows.withColumn("upto", F.count(F.lit(1)).over(upto))
        .filter(F.col("upto") >= rank)
        .groupBy("cut")
        .agg(F.min(F.struct("upto", *names)).alias("at"))
    )
    for row in at_rank.collect():
        cut, at = cuts[row["cut"]], row["at"]
        if at["upto"] != cut.rank:
            raise ValueError("order_by does not tell the rows at a cut apart")
        cut.point += [at[name] for name in names]
        cut.size, cut.low, cut.high, cut.pivots = cut.rank, None, None, None


def _count_round(long, order, level, cuts, many, accuracy) -> None:
    """Propose two pivots per cut and count the rows on either side of them, for both cuts of
    a variable side by side."""
    _, kind, value = order[level]
    inside = _in_question(order, level, cuts, many)
    _propose_pivots(long, value, inside, [c for c in many if c.pivots is None], accuracy)
    counts = []
    for side in (0, 1):
        first, second = (
            pick([c.pivots[i] if c in many else None for c in cuts[side::2]], "slot", kind)
            for i in (0, 1)
        )
        parts = {
            "under": value < first,
            "at_first": value == first,
            "between": (value > first) & (value < second),
            "at_second": (value == second) & (second > first),
            "over": value > second,
        }
        counts.append(F.struct(*[
            F.count_if(inside[side] & part).alias(name) for name, part in parts.items()
        ]).alias(f"side_{side}"))
    found = {r["slot"]: r for r in long.groupBy("slot").agg(*counts).collect()}
    for cut in many:
        if cut.slot not in found:
            continue
        r = found[cut.slot][f"side_{cut.number % 2}"]
        a, b = cut.pivots
        cut.pivots = None
        upto_first = r["under"] + r["at_first"]
        upto_second = upto_first + r["between"] + r["at_second"]
        if cut.rank <= r["under"]:
            cut.narrow(None, a, 0, r["under"])
        elif cut.rank <= upto_first:
            cut.settle(a, r["under"], r["at_first"])
        elif cut.rank <= upto_first + r["between"]:
            cut.narrow(a, b, upto_first, r["between"])
        elif cut.rank <= upto_second:
            cut.settle(b, upto_first + r["between"], r["at_second"])
        else:
            cut.narrow(b, None, upto_second, r["over"])


def _propose_pivots(long, value, inside, cuts, accuracy) -> None:
    """Two values per cut that its rank most likely lies between."""
    if not cuts:
        return
    wanted = {c.number: _around(c.rank / c.size, accuracy) for c in cuts}
    fractions = sorted({f for pair in wanted.values() for f in pair})
    sketches = [
        F.percentile_approx(F.when(mine, value), fractions, accuracy).alias(f"side_{side}")
        for side, mine in enumerate(inside)
    ]
    found = {r["slot"]: r for r in long.groupBy("slot").agg(*sketches).collect()}
    for cut in cuts:
        at = found[cut.slot][f"side_{cut.number % 2}"] if cut.slot in found else None
        if at is None:
            raise RuntimeError("a look at the rows settled nothing: did the input change?")
        cut.pivots = tuple(at[fractions.index(f)] for f in wanted[cut.number])


def _up_to_cut(order: _Order, cuts: list[_Cut]) -> Column:
    """True for rows up to their variable's cut; ``cuts`` are in slot order.

    Nearly every row is settled by its value. The tie-breaking columns are compared
    as one struct, which keeps the generated code small.
    """
    (_, kind, value), *ties = order
    # Where a cut ends before the last column, all rows alike so far are up to it.
    last = {"bigint": (1 << 63) - 1, "double": math.inf}

    def tie_struct(cut: _Cut) -> str:
        rest = cut.point[1:] + [last[t] for _, t, _ in ties[max(0, len(cut.point) - 1):]]
        fields = [f"'{name}', {sql_literal(v, t)}" for (name, t, _), v in zip(ties, rest)]
        return f"named_struct({', '.join(fields)})"

    point = pick([c.point[0] if c.point else None for c in cuts], "slot", kind)
    upto = value < point
    if ties:
        structs = ", ".join(tie_struct(c) for c in cuts)
        cut_ties = F.expr(f"element_at(array({structs}), slot + 1)")
        row_ties = F.struct(*[v.alias(name) for name, _, v in ties])
        upto = upto | ((value == point) & (row_ties <= cut_ties))
    else:
        upto = upto | (value == point)
    return F.coalesce(upto, F.lit(False))


def _tie_columns(name: str, key: str, data_type: T.DataType, first: int) -> _Order:
    """A tie-breaking column as numbers that a double can hold."""
    value = F.col(key)
    if isinstance(data_type, T.DateType):
        value, kind = F.unix_date(value), "bigint"
    elif isinstance(data_type, T.TimestampType):
        value, kind = F.unix_micros(value), "bigint"
    elif isinstance(data_type, T.TimestampNTZType):
        since = "timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', {})"
        value, kind = F.expr(since.format(f"`{key}`")), "bigint"
    elif isinstance(data_type, T.DecimalType) and data_type.precision <= 18:
        unscaled = T.DecimalType(min(38, data_type.precision + data_type.scale + 2), 0)
        value, kind = (value * F.lit(10**data_type.scale)).cast(unscaled).cast("bigint"), "bigint"
    elif isinstance(data_type, T.IntegralType):
        kind = "bigint"
    elif isinstance(data_type, (T.FloatType, T.DoubleType)):
        kind = "double"
    else:
        raise ValueError(
            f"cannot order by {name}: use number, date or time columns, "
            "or a hash of it such as xxhash64"
        )
    missing = F.raise_error(F.lit(f"null in the tie-breaking column {name}")).cast(kind)
    value = F.coalesce(value.cast(kind), missing)
    wide = (T.LongType, T.TimestampType, T.TimestampNTZType, T.DecimalType)
    if not isinstance(data_type, wide):
        return [(f"tie_{first}", kind, value)]
    # Two columns with the same order: the leading bits, then the others.
    return [
        (f"tie_{first}", kind, F.shiftright(value, _EXACT_BITS)),
        (f"tie_{first + 1}", kind, value.bitwiseAND(F.lit((1 << _EXACT_BITS) - 1))),
    ]
