"""Several questions counted by one grouping key.

To cross many questions with many others, a row need not be counted once per pair: the codes of
a few questions together, a *pack*, are one key, and from the counted packs the table of every
pair inside them is added up. A question with a short list of options stands in the pack as
the position of its code in that list, packed with the others into one whole number; a
question with many options, or without a list, as the code itself, in a field of its own.

Larger packs mean fewer lines per row and more different keys to keep and shuffle. Which is best goes
by the number of options of the questions: :func:`choose_packs` tries several sizes and takes
the one of least cost.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from math import prod

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from surveytab.functions.codes import (
    BIGINT,
    DOUBLE,
    TEXT,
    code_type,
    code_value,
    in_codes,
    native_code,
    text_code,
)
from surveytab.functions.frames import broadcast_if_bounded, sql_literal
from surveytab.operators.tally import explode_slots

# Options of a question whose positions are packed; a question with more keeps its codes.
MOST_PACKED = 64

# How many different codes a question without a packed list is taken to have.
_OPEN_SIZE = 12

# Combinations of a pack, and packs, at most: both stand in one number.
_MOST_KEYS = 1 << 31

# Rows that a task counts, and how many visits of a line a key costs: to be kept and shuffled,
# and to be added to the table of one pair.
_ROWS_PER_TASK, _KEY_COST, _PAIR_COST = 1 << 20, 8, 6

# Combinations of a pack's one side are tried up to two to this.
_MOST_POWER = 11


@dataclass(frozen=True)
class Question:
    """A column of answers, coded as ``variable`` of the dictionary."""

    column: str
    variable: str
    kind: str
    codes: tuple[str, ...] | None = None

    @property
    def size(self) -> int:
        """Different keys: its options and none, or as many as an open question may have."""
        return _OPEN_SIZE if self.codes is None else len(self.codes) + 1


def listed_codes(options: DataFrame | None, variables: Sequence[str]) -> dict[str, tuple[str, ...]]:
    """The codes of the variables that have no more than MOST_PACKED, in dictionary order. A small job on
    the dictionary; longer lists stay there."""
    if options is None:
        return {}
    codes = (
        options.filter(in_codes(F.col("variable"), variables) & F.col("code").isNotNull())
        .groupBy("variable", "code").agg(F.min("option_id").alias("option_id"))
    )
    few = codes.groupBy("variable").count().filter(F.col("count") <= MOST_PACKED).select("variable")
    rows = codes.join(broadcast_if_bounded(few, len(set(variables))), "variable").collect()
    out: dict[str, list] = {v: [] for v in variables}
    for row in sorted(rows, key=lambda r: (r["option_id"] is None, r["option_id"] or 0, r["code"])):
        out[row["variable"]].append(row["code"])
    return {v: tuple(c) for v, c in out.items() if c}


def questions_of(df: DataFrame, wanted: Sequence[tuple[str, str]], codes: dict[str, tuple[str, ...]]) -> list[Question]:
    """``wanted`` are (column, variable)."""
    return [Question(c, v, code_type(df.schema[c].dataType), codes.get(v)) for c, v in dict.fromkeys(wanted)]


@dataclass(frozen=True)
class Pack:
    """Questions counted together, and the pairs (of their numbers) whose tables are taken from it."""

    members: tuple[int, ...]
    pairs: tuple[tuple[int, int], ...]

    def keys(self, questions: Sequence[Question]) -> int:
        return prod(questions[m].size for m in self.members)


def _blocks(numbers: Sequence[int], questions: Sequence[Question], most: int) -> list[tuple[int, ...]]:
    """The questions in groups of at most ``most`` combinations; one alone may have more."""
    blocks: list[list[int]] = []
    for number in sorted(numbers, key=lambda i: (-questions[i].size, i)):
        for block in blocks:
            if prod(questions[i].size for i in [*block, number]) <= most:
                block.append(number)
                break
        else:
            blocks.append([number])
    return [tuple(b) for b in blocks]


def _pack_by(
    left: list[tuple[int, ...]], right: list[tuple[int, ...]], pairs: Sequence[tuple[int, int]]
) -> list[Pack]:
    block_of = [{i: n for n, b in enumerate(blocks) for i in b} for blocks in (left, right)]
    groups: dict[frozenset, list[tuple[int, int]]] = {}
    for a, b in pairs:
        members = frozenset(left[block_of[0][a]]) | frozenset(right[block_of[1][b]])
        groups.setdefault(members, []).append((a, b))
    return [Pack(tuple(sorted({i for pair in mine for i in pair})), tuple(mine)) for mine in groups.values()]


def cost(packs: Sequence[Pack], questions: Sequence[Question], rows: int = _ROWS_PER_TASK) -> int:
    """Visits of lines in a task: its rows once per pack, and what its keys cost."""
    return sum(
        rows + (_KEY_COST + _PAIR_COST * len(p.pairs)) * min(rows, p.keys(questions)) for p in packs
    )


def choose_packs(
    pairs: Sequence[tuple[int, int]], questions: Sequence[Question], rows: int = _ROWS_PER_TASK
) -> list[Pack]:
    """Packs that hold every pair, of the size that costs least."""
    pairs = list(dict.fromkeys(pairs))
    firsts, seconds = (list(dict.fromkeys(side)) for side in zip(*pairs))
    ways = [
        list(dict.fromkeys(tuple(_blocks(side, questions, 2**power)) for power in range(1, _MOST_POWER)))
        for side in (firsts, seconds)
    ]
    both = set(firsts) == set(seconds)  # blocks of the same questions also serve both orders of a pair
    tried = [
        _pack_by(left, right, pairs) for left in ways[0] for right in ways[1] if left == right or not both
    ]
    return min(tried, key=lambda packs: (cost(packs, questions, rows), len(packs)))


def pack_singly(questions: Sequence[Question], rows: int = _ROWS_PER_TASK) -> list[Pack]:
    """Packs that hold every question once."""
    numbers = range(len(questions))
    tried = [
        [Pack(b, tuple((i, i) for i in b)) for b in _blocks(numbers, questions, 2**power)]
        for power in range(1, 2 * _MOST_POWER)
    ]
    return min(tried, key=lambda packs: (cost(packs, questions, rows), len(packs)))


def _positions(natives: str, questions: Sequence[Question]) -> Column:
    """The places of an array of codes among the options of their questions, from 1; else 0."""
    lists = [
        "array(" + ", ".join(sql_literal(code_value(c, q.kind), q.kind) for c in q.codes) + ")" for q in questions
    ]
    return F.expr(
        f"transform({natives}, (x, i) -> coalesce(array_position(get(array({', '.join(lists)}), i), x), 0L))")


class PackedKeys:
    """The grouping keys of a list of packs: a line per pack, with the fields ``names``, and the way back
    to codes. The number of the pack stands in the upper bits of ``packed``."""

    def __init__(self, df: DataFrame, questions: Sequence[Question], packs: Sequence[Pack]) -> None:
        self.questions, self.packs = list(questions), list(packs)
        self.places: list[dict[int, tuple[int, int]]] = []  # of listed questions: stride, size
        self.fields_of: list[dict[int, str]] = []  # of open questions: the field of their kind
        kinds: dict[str, int] = {BIGINT: 0, DOUBLE: 0, TEXT: 0}
        for pack in packs:
            stride, places, fields, used = 1, {}, {}, dict.fromkeys(kinds, 0)
            for m in pack.members:
                q = self.questions[m]
                if q.codes is None:
                    fields[m] = f"{q.kind}_{used[q.kind]}"
                    used[q.kind] += 1
                else:
                    places[m] = (stride, q.size)
                    stride *= q.size
            if stride > _MOST_KEYS or len(packs) > _MOST_KEYS:
                raise ValueError("too many options to be packed")
            kinds = {k: max(n, used[k]) for k, n in kinds.items()}
            self.places.append(places)
            self.fields_of.append(fields)
        self.open_fields = {f"{k}_{i}": k for k, n in kinds.items() for i in range(n)}
        self.names = ["packed", *self.open_fields]
        self._df = df

    def exploded(self, kept: dict[str, Column]) -> DataFrame:
        """A line per row of the table and pack: ``kept`` and the keys. Every question's position or code is
        worked out once per row, in arrays; the packs are a list that is exploded and tells which of them
        to take. The expressions stay short with any number of packs: long ones are not compiled."""
        at: dict[int, int] = {}
        natives: dict[tuple[bool, str], list[int]] = {}
        for m, q in enumerate(self.questions):
            natives.setdefault((q.codes is not None, q.kind), []).append(m)
        columns, positions = [], []
        for (listed, kind), members in natives.items():
            name = f"{'answers' if listed else 'codes'}_{kind}"
            columns.append(F.array(*[native_code(self._df, self.questions[m].column) for m in members]).alias(name))
            first = len(positions) and sum(len(natives[True, k]) for k, _ in positions)
            at |= {m: first * listed + i for i, m in enumerate(members)}
            if listed:
                positions.append((kind, _positions(name, [self.questions[m] for m in members])))
        placed = F.concat(*[p for _, p in positions]) if positions else F.array().cast("array<bigint>")
        answered = self._df.select(*[c.alias(n) for n, c in kept.items()], *columns).withColumn("positions", placed)
        widest = max(map(len, self.places))
        lines = []
        for number, (places, fields) in enumerate(zip(self.places, self.fields_of)):
            members = [(at[m], stride) for m, (stride, _) in places.items()] + [(-1, 0)] * widest
            numbers = [f"{number * _MOST_KEYS}L", *(f"{i}, {stride}L" for i, stride in members[:widest])]
            owners = {field: at[m] for m, field in fields.items()}
            lines.append(f"({', '.join([*numbers, *(str(owners.get(f, -1)) for f in self.open_fields)])})")
        names = ["base", *(f"{x}{i}" for i in range(widest) for x in ("at", "stride")), *(f"of_{f}" for f in self.open_fields)]
        structs = ", ".join(lines)
        kind = ", ".join(f"{n}: bigint" if n == "base" or n.startswith("stride") else f"{n}: int" for n in names)
        exploded = answered.select("*", explode_slots(
            F.expr(f"cast(array({structs}) as array<struct<{kind}>>)")).alias("_number", "_line"))
        packed = F.col("_line.base")
        for i in range(widest):
            position = F.get("positions", F.col(f"_line.at{i}"))
            packed = packed + F.coalesce(position, F.lit(0).cast("bigint")) * F.col(f"_line.stride{i}")
        fields = [F.get(f"codes_{kind}", F.col(f"_line.of_{f}")).alias(f) for f, kind in self.open_fields.items()]
        return exploded.select(*kept, packed.alias("packed"), *fields)

    def spread(self, counted: DataFrame) -> DataFrame:
        """A row of ``counted`` for every pair of its pack: the number of both questions (``first``,
        ``second``) and their codes as text (``first_code``, ``second_code``)."""
        order = {name: i for i, name in enumerate(self.open_fields)}
        rows = []
        for number, pack in enumerate(self.packs):
            for pair in pack.pairs:
                row = [number, *pair]
                for m in pair:
                    stride, size = self.places[number].get(m, (1, 1))
                    field = self.fields_of[number].get(m)
                    row += [stride, size, -1 if field is None else order[field]]
                rows.append(f"({', '.join(map(str, row))})")
        ways = [f"{side}_{what}" for side in ("first", "second") for what in ("stride", "size", "field")]
        pairs = counted.sparkSession.sql(
            f"SELECT * FROM VALUES {', '.join(rows)} AS t(of_pack, first, second, {', '.join(ways)})")
        pairs = broadcast_if_bounded(pairs, len(rows))
        joined = counted.withColumns({
            "pack": F.expr(f"cast(packed div {_MOST_KEYS}L as int)"), "packed": F.expr(f"packed % {_MOST_KEYS}L"),
        }).join(pairs, F.col("pack") == F.col("of_pack"))
        texts = F.array(*[text_code(F.col(f), kind) for f, kind in self.open_fields.items()], F.lit(None).cast("string"))
        lists = ", ".join(
            "array(" + ", ".join([*map(sql_literal, q.codes or ()), "cast(null as string)"]) + ")" for q in self.questions)
        codes = F.expr(f"array({lists})")

        def code(side: str) -> Column:
            place = F.expr(f"cast(packed div {side}_stride % {side}_size as int)")
            listed = F.get(F.get(codes, F.col(side)), place - 1)
            return F.when(F.col(f"{side}_field") >= 0, F.get(texts, F.col(f"{side}_field"))).otherwise(listed)

        return joined.withColumns({"first_code": code("first"), "second_code": code("second")}).drop(
            "pack", "of_pack", *ways, *self.names)
