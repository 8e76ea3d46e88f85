"""The same queries as plain SQL for DuckDB, written on their own.

They share only the interview projection with the Spark side. Totals, bases, trimming
and variances are spelled out the direct way: window functions, two-step variances
and ``ntile``.
"""

from __future__ import annotations

from workload.inputs import (
    FIRST_OPTION,
    FRACTION,
    MEASURES,
    QUESTIONS,
    REPORT_SPLITS,
    REPORT_WEIGHTS,
    SURVEY_COLUMNS,
    TIE_KEY,
    UNUSED_V1,
    WIDE_COLUMNS,
    WIDE_LISTED,
    WIDE_ROWS,
)

TOTAL, BASE = "1e300::double", "2e300::double"
SURVEY = f"survey as (select {', '.join(SURVEY_COLUMNS)} from lineitem)"
SLOTS = ("v5_1", "v5_2", "v5_3")
MENTIONS = ("v19", "v20", "v21")


def union(parts) -> str:
    return " union all ".join(parts)


_first = " ".join(f"when '{v}' then {n}" for v, n in FIRST_OPTION.items())
_found = union(
    [f"select '{v}' as variable, cast({v} as int) as code from survey" for v in
     ("v1", "v13", "v19", "v20", "v21")]
    + [f"select 'v5', cast({s} as int) from survey" for s in SLOTS]
    + [f"select 'v1', {c}" for c in UNUSED_V1]
)
OPTIONS = f"""options as (
  select distinct cast(case variable {_first} end + code as bigint) as option_id, variable,
    cast(code as varchar) as code, variable || ' option ' || cast(code as varchar) as label
  from ({_found}) where code is not null)"""
QUESTION_ROWS = "questions as (" + union(
    f"select '{v}' as variable, '{n}' as question_number, '{t}' as question_text"
    for v, n, t in QUESTIONS
) + ")"


def pct(part: str, whole: str) -> str:
    return f"round(100.0::double * ({part}) / nullif({whole}, 0), 4)"


# --- frequencies ------------------------------------------------------------------


def answers_cte(kind: str, source: str = "survey", weight: str = "weight", text: bool = False):
    """``answers``: one line per counted answer; ``bases``: one per variable."""
    if kind in ("v5", "G019"):
        columns = SLOTS if kind == "v5" else MENTIONS
        if kind == "v5":
            answers = union(
                f"select 'v5' as variable, cast({c} as varchar) as code, {c} as row_order, "
                f"{weight} as w from {source} where {c} is not null" for c in columns
            )
        else:
            answers = union(
                f"select 'G019' as variable, '{c}' as code, 0 as row_order, {weight} as w "
                f"from {source} where {c} = 1" for c in columns
            )
        answered = f"coalesce({', '.join(columns)}) is not null"
    else:
        answers = (
            f"select '{kind}' as variable, cast({kind} as varchar) as code, "
            f"{0 if text else kind} as row_order, {weight} as w from {source} where {kind} is not null"
        )
        answered = f"{kind} is not null"
    bases = f"""select '{kind}' as variable, count(*) filter (where {answered}) as bn,
        sum({weight}) filter (where {answered}) as bw, count(*) as an, sum({weight}) as aw,
        {str(kind == 'G019').lower()} as over_persons from {source}"""
    return answers, bases


def freq_ctes(kinds, source="survey", weight="weight", texts=()) -> str:
    pairs = [answers_cte(k, source, weight, k in texts) for k in kinds]
    return f"""
answers as ({union(a for a, _ in pairs)}),
bases as ({union(b for _, b in pairs)}),
codes as (select variable, code, min(row_order) as row_order, count(*) as n, sum(w) as nw
  from answers group by variable, code),
wholes as (select b.*, c.cn, c.cw, case when over_persons then bn else cn end as wn,
    case when over_persons then bw else cw end as ww
  from bases b left join
    (select variable, sum(n)::bigint as cn, sum(nw) as cw from codes group by variable) c
    using (variable)),
freq as (
  select variable, code, 'code' as row_kind, cast(row_order as double) as row_order, n,
    cast(nw as double) as n_weighted, {pct('n', 'wn')} as pct, {pct('nw', 'ww')} as pct_weighted
  from codes join wholes using (variable)
  union all
  select variable, 'Total', 'total', {TOTAL}, cn, cw, {pct('cn', 'wn')}, {pct('cw', 'ww')}
  from wholes
  union all
  select variable, 'Base', 'base', {BASE}, case when cn > 0 then bn end,
    case when cn > 0 then bw end, case when cn > 0 then {pct('bn', 'an')} end,
    case when cn > 0 then {pct('bw', 'aw')} end
  from wholes)"""


def freq(kinds, source="survey", weight="weight", extra="") -> str:
    return f"with {SURVEY}, {extra} {freq_ctes(kinds, source, weight)} select * from freq"


EMPTY = "nobody as (select * replace (cast(null as int) as v1) from survey),"
SILENT = "nobody as (select * replace (v19 * 0 as v19, v20 * 0 as v20, v21 * 0 as v21) from survey),"

LABELLED = """
select o.variable, o.code, o.label, 'code' as row_kind,
  case o.code when '-88' then 1e299::double when '-99' then 2e299::double
    else cast(o.option_id as double) end as row_order, f.n, f.n_weighted, f.pct, f.pct_weighted
from options o left join freq f
  on f.variable = o.variable and f.code = o.code and f.row_kind = 'code'
where o.variable = 'v1'
union all
select variable, code, code, row_kind, row_order, n, n_weighted, pct, pct_weighted
from freq where row_kind <> 'code'"""

MENTION_LABELS = """
select f.variable, f.code, coalesce(q.question_text, f.code) as label, f.row_kind, f.row_order,
  f.n, f.n_weighted, f.pct, f.pct_weighted
from freq f left join questions q on q.variable = f.code
union all
select question_number, variable, question_text, 'code', 0.0::double, null, null, null, null
from questions
where question_number = 'G019' and not exists (select 1 from freq where row_kind = 'code')"""

TIDY = """
select c.variable, c.code, c.n, c.n_weighted, c.pct, c.pct_weighted, t.n as total,
  t.n_weighted as total_weighted, b.pct as pct_base, b.pct_weighted as pct_base_weighted
from freq c join freq t on t.variable = c.variable and t.row_kind = 'total'
  join freq b on b.variable = c.variable and b.row_kind = 'base'
where c.row_kind = 'code'"""


def wide_line(measure: str, order: int) -> str:
    cells = ", ".join(
        f"coalesce(max({measure}) filter (where code = '{c}'), 0.0::double) as c_{c.lower()}"
        for c in ("1", "2", "3", "4", "Total", "Base")
    )
    return f"""select variable, '{measure}' as measure, cast({order} as int) as row_order, {cells}
      from freq group by variable"""


def wide_all(measure: str) -> str:
    cells = ", ".join(
        f"coalesce(max({measure}) filter (where {'code' if c.isdigit() else 'row_kind'} = '{c}'), "
        f"0.0::double) as c_{c}" for c in ("1", "2", "3", "4", "5", "total", "base")
    )
    return f"select variable, '{measure}' as measure, {cells} from freq group by variable"


def compare() -> str:
    ctes, selects = [], []
    for split in (1, 2):
        ctes.append(f"part{split} as (select * from survey where v13 = {split})")
        inner = freq_ctes(["v1"], f"part{split}")
        ctes.append(f"freq{split} as (with {inner} select * from freq)")
    for measure in ("n", "n_weighted", "pct", "pct_weighted"):
        zero = "0" if measure == "n" else "0.0::double"
        selects += [f"coalesce(a.{measure}, {zero}) as {measure}_1",
                    f"coalesce(b.{measure}, {zero}) as {measure}_2"]
    return f"""with {SURVEY}, {', '.join(ctes)}
      select coalesce(a.variable, b.variable) as variable, coalesce(a.code, b.code) as code,
        coalesce(a.row_kind, b.row_kind) as row_kind,
        coalesce(a.row_order, b.row_order) as row_order, {', '.join(selects)}
      from freq1 a full join freq2 b on a.variable = b.variable and a.code = b.code
        and a.row_kind = b.row_kind"""


LAYOUT_MAP = f"""with {SURVEY},
counted as (select cast(l_suppkey as varchar) as split, cast(v1 as varchar) as code, 'code' as row_kind,
    count(v1) as n, sum(weight) as w, count(*) as rows from survey group by l_suppkey, v1),
totals as (select split, sum(n) as n, sum(w) filter (where code is not null) as w, sum(rows) as rows from counted group by split),
lines as (
  select c.split, c.code, c.row_kind, c.n, c.w, 100.0::double * c.n / t.n as pct from counted c join totals t using (split)
    where c.code is not null
  union all select split, 'Total', 'total', n, w, 100.0 from totals
  union all select split, 'Base', 'base', n, w, 100.0::double * n / rows from totals)
select 'v1' as variable, code, row_kind, {', '.join(
    f"string_agg(split || '=' || cast(cast({c} as decimal(20,2)) as varchar), ';' order by split) as {name}"
    for c, name in (("n", "n"), ("w", "n_weighted"), ("pct", "pct")))}
from lines group by code, row_kind"""

TEXT_FREQ = union(
    f"""(with codes as (select '{c}' as variable, {c} as code, 'code' as row_kind,
          0.0::double as row_order, count(*) as n, cast(count(*) as double) as n_weighted
        from orders where {c} is not null group by {c}),
      t as (select sum(n)::bigint as cn from codes), a as (select count(*) as an from orders)
      select codes.*, {pct('n', 'cn')} as pct, {pct('n', 'cn')} as pct_weighted from codes, t
      union all select '{c}', 'Total', 'total', {TOTAL}, cn, cast(cn as double), 100.0, 100.0 from t
      union all select '{c}', 'Base', 'base', {BASE}, cn, cast(cn as double), {pct('cn', 'an')},
        {pct('cn', 'an')} from t, a)"""
    for c in ("o_orderstatus", "o_orderpriority")
)

# --- means ------------------------------------------------------------------------


def mean_select(keys: str, rows: str) -> str:
    """The eight statistics per key of ``rows(keys, x, w)``, in two steps."""
    by = f"group by {keys}"
    match = " and ".join(f"r.{k} is not distinct from m.{k}" for k in keys.split(", "))
    out = ", ".join(f"m.{k}" for k in keys.split(", "))
    return f"""
rows_ as ({rows}),
centre as (select {keys}, count(*) as n, sum(w) as nw, avg(x) as a, count(x) as k,
    sum(w) filter (where x is not null) as kw,
    sum(w * x) / nullif(sum(w) filter (where x is not null), 0) as m
  from rows_ {by}),
stats as (select {out}, any_value(m.n) as n, any_value(m.nw) as nw, any_value(m.a) as a,
    any_value(m.m) as mw,
    sqrt(sum((r.x - m.a) * (r.x - m.a)) / nullif(any_value(m.k) - 1, 0)) as sd,
    case when any_value(m.kw) > 1
      then sqrt(sum(r.w * (r.x - m.m) * (r.x - m.m)) / (any_value(m.kw) - 1)) end as sdw
  from centre m join rows_ r on {match} group by {out}),
means as (select {keys}, round(a, 4) as mean, round(mw, 4) as mean_weighted, n,
    cast(nw as double) as n_weighted, round(sd, 4) as sd, round(sdw, 4) as sd_weighted,
    round(sd / sqrt(n), 4) as error, round(sdw / sqrt(n), 4) as error_weighted from stats)"""


def measured(column: str) -> str:
    return f"case when {column} not in (-88, -99) then cast({column} as double) end"


def trimmed(column: str) -> str:
    key = ", ".join(["x", *TIE_KEY])
    rows = f"""select 'VARIABLE' as variable, x, weight as w from (
      select *, ntile(100) over (order by {key}) as second from (
        select * from (
          select *, ntile(100) over (order by {key}) as first from (
            select *, {measured(column)} as x from survey) where x is not null)
        where first <= 97.5)) where second >= 2.5"""
    return rows


def trimmed_parts(parts) -> str:
    """``split, variable, x, w`` left of each (split, variable, condition, answer) after both trimmings."""
    key = ", ".join(["x", *TIE_KEY])
    return union(
        f"""select {split} as split, '{name}' as variable, x, w from (
          select *, ntile(100) over (order by {key}) as second from (
            select * from (
              select *, ntile(100) over (order by {key}) as first from (
                select *, {answer} as x, weight as w from survey where {condition}) where x is not null)
            where first <= 97.5)) where second >= 2.5""" for split, name, condition, answer in parts)


TRIMMED_BY = f"with {SURVEY}, " + mean_select("split, variable", trimmed_parts(
    (f"'{code}'", v, f"v1 = {code}", measured(v)) for code in (1, 2, 3) for v in ("v30m", "v5_1"))) + " select * from means"
TRIMMED_TYPES = f"with {SURVEY}, " + mean_select("variable", "select variable, x, w from (" + trimmed_parts(
    ("null", n, "true", f"cast({sql} as double)") for n, sql in MEASURES) + ")") + " select * from means"

CROSS_ROWS = {
    "v5": union(
        f"select 'v5' as row_variable, '{{0}}' as col_variable, cast({s} as varchar) as row_raw, "
        f"cast({{0}} as varchar) as col_raw, weight as w from survey" for s in SLOTS
    ),
    "single": "select '{1}' as row_variable, '{0}' as col_variable, cast({1} as varchar) as row_raw,"
    " cast({0} as varchar) as col_raw, weight as w from survey",
}


def cross(rows: str, keep: str = "true") -> str:
    return f"""with {SURVEY}, {OPTIONS}, listed as (select * from options where {keep}),
raw as ({rows}),
coded as (select r.row_variable, r.col_variable, a.code as row_code, c.code as col_code,
    a.option_id as row_order, c.option_id as col_order, count(*) as n,
    cast(sum(w) as double) as n_weighted
  from raw r
    left join listed a on a.variable = r.row_variable and a.code = r.row_raw
    left join listed c on c.variable = r.col_variable and c.code = r.col_raw
  group by all)
select *, {pct('n', 'sum(n) over (partition by row_variable, col_variable, col_code)')} as pct,
  {pct('n_weighted', 'sum(n_weighted) over (partition by row_variable, col_variable, col_code)')}
    as pct_weighted
from coded"""


def canonical(sql: str, kind: str) -> str:
    """A code as text: halves and quarters keep their fraction, whole numbers have none."""
    if kind == "double":
        return f"case when {sql} = floor({sql}) then cast(cast({sql} as bigint) as varchar) else cast({sql} as varchar) end"
    return sql if kind == "text" else f"cast({sql} as varchar)"


def many_rows() -> str:
    """A line per interview and pair of the forty questions."""
    def answers(questions):
        return "[" + ", ".join(f"{{'v': '{n}', 'c': {canonical('(' + sql + ')', k)}}}" for n, sql, k in questions) + "]"

    return f"""select r.v as row_variable, c.v as col_variable, r.c as row_raw, c.c as col_raw, w from (
      select c, unnest(row_answers) as r, w from (
        select unnest({answers(WIDE_COLUMNS)}) as c, {answers(WIDE_ROWS)} as row_answers, l_quantity as w from lineitem))"""


WIDE_OPTIONS = "wide_options as (select * from (values " + ", ".join(
    f"({1000 * n + i}::bigint, '{name}', '{code}')"
    for n, (name, _, kind) in enumerate([*WIDE_COLUMNS, *WIDE_ROWS]) for i, code in enumerate(WIDE_LISTED[kind])
) + ") as t(option_id, variable, code))"


def cross_many(listed: bool) -> str:
    keys = "row_variable, col_variable, row_code, col_code" + (", row_order, col_order" if listed else "")
    coded = """raw r left join wide_options a on a.variable = r.row_variable and a.code = r.row_raw
      left join wide_options c on c.variable = r.col_variable and c.code = r.col_raw""" if listed else "raw r"
    select = """a.code as row_code, c.code as col_code, a.option_id as row_order, c.option_id as col_order""" if listed else (
        "row_raw as row_code, col_raw as col_code")
    return f"""with {WIDE_OPTIONS}, raw as (
      select row_variable, col_variable, row_raw, col_raw, count(*) as n, sum(w) as w from ({many_rows()}) group by all),
    coded as (select row_variable, col_variable, {select}, cast(sum(n) as bigint) as n, cast(sum(w) as double) as n_weighted
      from {coded} group by all)
    select {keys}, n, n_weighted,
      {pct('n', 'sum(n) over (partition by row_variable, col_variable, col_code)')} as pct,
      {pct('n_weighted', 'sum(n_weighted) over (partition by row_variable, col_variable, col_code)')} as pct_weighted
    from coded"""


def exact_sum(value: str) -> str:
    """The sum on a grid of 2^-52, by whole numbers of 128 bits, rounded once."""
    units = f"(sum(cast(floor({value}) as hugeint)) * 4503599627370496 + sum(cast(round(({value} - floor({value})) * 4503599627370496) as hugeint)))"
    return f"cast({units} // 4503599627370496 as double) + cast({units} % 4503599627370496 as double) / 4503599627370496"


def fractional() -> str:
    parts = []
    for v in ("v1", "v13"):
        parts += [
            f"""select '{v}' as variable, cast({v} as varchar) as code, 'code' as row_kind, cast({v} as double) as row_order,
              count(*) as n, {exact_sum('w')} as n_weighted from weighed where {v} is not null group by {v}""",
            *[f"select '{v}', '{name}', '{name.lower()}', {order}, count(*), {exact_sum('w')} from weighed where {v} is not null"
              for name, order in (("Total", TOTAL), ("Base", BASE))],
        ]
    # DuckDB has no suffix for doubles.
    weight = FRACTION.replace("weight", "l_quantity").replace("0.1D", "0.1::double").replace("3.7D", "3.7::double")
    columns = ", ".join(c for c in SURVEY_COLUMNS if c.endswith((" as v1", " as v13")))
    return f"with weighed as (select {columns}, {weight} as w from lineitem) {union(parts)}"


def cross_mean(columns, keep="true") -> str:
    rows = union(
        f"""select 'v30m' as mean_variable, '{c}' as col_variable, o.code as col_code,
          o.option_id as col_order, {measured('v30m')} as x, weight as w
        from survey left join listed o
          on o.variable = '{c}' and o.code = cast({c} as varchar)""" for c in columns
    )
    keys = "mean_variable, col_variable, col_code, col_order"
    return f"""with {SURVEY}, {OPTIONS}, listed as (select * from options where {keep}),
      {mean_select(keys, rows)} select * from means"""


# --- the split report -------------------------------------------------------------

_SPLITS = list(enumerate(zip(REPORT_SPLITS, REPORT_WEIGHTS), start=1))
_PLAIN = ", ".join(str(n) for n, (_, w) in _SPLITS if w is None)
SPLITS = f"""
ids as (
  select 101::bigint as split_id, 1 as split_no, 'Geral' as split, '1' as code
  union all
  select cast(100 * s.split_no + row_number() over (partition by s.split order by o.option_id)
    as bigint), s.split_no, s.split, o.code
  from (values {', '.join(f"('{v}', {n})" for n, (v, _) in _SPLITS[1:])}) as s(split, split_no)
    join options o on o.variable = s.split),
members as (
  select i.split_id, i.split_no, s.*, case when i.split_no in ({_PLAIN}) then 1.0 else s.weight end as sw
  from survey s join ids i on i.split = 'Geral'
    {' '.join(f"or (i.split = '{v}' and i.code = cast(s.{v} as varchar))" for _, (v, _) in _SPLITS[1:])})"""


def report_answers(variables) -> str:
    parts = []
    for v in variables:
        for column in SLOTS if v == "v5" else (v,):
            parts.append(
                f"select split_id, '{v}' as variable, cast({column} as varchar) as code, sw "
                f"from members where {column} is not null"
            )
    return union(parts)


def report_freq_ctes(variables) -> str:
    names = ", ".join(f"'{v}'" for v in variables)
    return f"""
report_answers as ({report_answers(variables)}),
counted as (select split_id, variable, code, count(*) as n, sum(sw) as nw
  from report_answers group by all),
filled as (
  select coalesce(c.split_id, d.split_id) as split_id, coalesce(c.variable, d.variable) as variable,
    coalesce(c.code, d.code) as code, coalesce(n, 0) as n, coalesce(nw, 0.0) as nw
  from counted c full join
    (select i.split_id, o.variable, o.code from options o, ids i where o.variable in ({names})) d
    on c.split_id = d.split_id and c.variable = d.variable and c.code = d.code),
report_freq as (
  select split_id, variable, code, n, cast(nw as double) as n_weighted,
    coalesce({pct('n', 'sum(n) over (partition by split_id, variable)')}, 0) as pct,
    coalesce({pct('nw', 'sum(nw) over (partition by split_id, variable)')}, 0) as pct_weighted
  from filled)"""


def report_base_ctes(variables) -> str:
    parts = []
    for v in variables:
        columns = SLOTS if v == "v5" else (v,)
        mentions = " + ".join(f"({c} is not null)::int" for c in columns)
        answered = f"coalesce({', '.join(columns)}) is not null"
        parts.append(
            f"""select i.split_id, i.split_no, '{v}' as variable,
              coalesce(sum({mentions}), 0)::bigint as total,
              coalesce(sum(sw) filter (where {answered}), 0.0) as total_weighted,
              count(*) filter (where {answered}) as respondents
            from ids i left join members m using (split_id) group by 1, 2"""
        )
    return f"""
base_counts as ({union(parts)}),
report_base as (
  select split_id, variable, total, cast(total_weighted as double) as total_weighted,
    {pct('total', '(select count(*) from survey)')} as pct_base,
    {pct('total_weighted', '''case when split_no in (''' + _PLAIN + ''') then (select count(*) from survey)
      else (select sum(weight) from survey) end''')} as pct_base_weighted, respondents
  from base_counts)"""


DESCRIBED = """select split_id, split_no, cast(split_id % 100 as int) as option_no, split,
  case when split = 'Geral' then 'Geral' else code end as option,
  'Todas especificadas em ''variaveis_quero''' as note,
  case when split_no in (PLAIN) then 'Sem Peso' else 'weight' end as weight from ids""".replace("PLAIN", _PLAIN)


def report(ctes: str, select: str) -> str:
    return f"with {SURVEY}, {OPTIONS}, {SPLITS}, {ctes} {select}"


def by_split(select: str, kinds) -> str:
    """Tables of both splits, one under the other, with the split in front."""
    ctes, parts = [], []
    for split in (1, 2):
        ctes.append(f"part{split} as (select * from survey where v13 = {split})")
        ctes.append(f"freq{split} as (with {freq_ctes(kinds, f'part{split}')} select * from freq)")
        body = select.replace(" freq ", f" freq{split} ").replace("from freq)", f"from freq{split})")
        parts.append(f"select '{split}' as split, * from ({body})")
    return f"with {SURVEY}, {OPTIONS}, {QUESTION_ROWS}, {', '.join(ctes)} {union(parts)}"


DAYS = """interviews as (select o_orderkey, cast(strftime(o_orderdate, '%Y%m%d') as bigint) as v70,
    cast(substr(o_orderpriority, 1, 1) as int) as v71, cast(o_orderkey % 7 + 1 as double) as w
  from orders),
days as (select distinct v70 as code from interviews where v70 between 19960101 and 19961231),
ids as (
  select 1001::bigint as split_id, 'Geral' as option, null::bigint as day
  union all
  select 2000 + row_number() over (order by code), cast(code as varchar), code from days),
members as (
  select split_id, option, v71, 1.0::double as w from ids, interviews where day is null
  union all
  select split_id, option, v71, w from ids join interviews on v70 = day)"""

MANY_OPTIONS = f"""with {DAYS},
grid as (select split_id, option, unnest([1, 2, 3, 4, 5]) as code from ids),
counted as (select split_id, v71 as code, count(*) as n, sum(w) as nw from members group by all),
joined as (select g.split_id, g.option, cast(g.code as varchar) as code, coalesce(n, 0) as n,
    coalesce(nw, 0.0)::double as n_weighted
  from grid g left join counted c on c.split_id = g.split_id and c.code = g.code)
select split_id, 'v71' as variable, code, n, n_weighted,
  coalesce({pct('n', 'sum(n) over (partition by split_id)')}, 0) as pct,
  coalesce({pct('n_weighted', 'sum(n_weighted) over (partition by split_id)')}, 0) as pct_weighted,
  option from joined"""

REPORT_MEANS = report(
    mean_select("split_id, variable", f"""select i.split_id, 'v30m' as variable,
      {measured('v30m')} as x, coalesce(sw, 0.0) as w, m.split_id as present
      from ids i left join members m using (split_id)"""),
    """select split_id, variable, mean, mean_weighted,
      case when n_weighted = 0 then 0 else n end as n, n_weighted, sd, sd_weighted, error,
      error_weighted from means""",
)

ORDER_OPTIONS = f"""with lines as (select l_orderkey as v72, l_linenumber as v73, l_quantity as w from lineitem),
grid as (
  select option, code from (select 'Geral' as option union all select cast(o_orderkey as varchar) from orders
      union all select '98765432109876543210'),
    (select unnest([1, 2, 3, 4, 5, 6, 7]) as code)),
counted as (
  select 'Geral' as option, v73 as code, count(*) as n, cast(sum(w) as double) as nw from lines group by all
  union all
  select cast(v72 as varchar), v73, count(*), cast(count(*) as double) from lines group by all),
joined as (select option, cast(code as varchar) as code, coalesce(n, 0) as n, coalesce(nw, 0.0::double) as n_weighted
  from grid left join counted using (option, code))
select 'v73' as variable, code, n, n_weighted,
  coalesce({pct('n', 'sum(n) over (partition by option)')}, 0) as pct,
  coalesce({pct('n_weighted', 'sum(n_weighted) over (partition by option)')}, 0) as pct_weighted, option
from joined"""

ORACLE = {
    "responses_filtered": """select o_orderkey, o_custkey, o_totalprice as weight from orders
      where o_orderstatus = 'F' and o_orderpriority <> '5-LOW'""",
    "responses_text_status": """select o_orderkey, case o_orderstatus when 'F' then '0' else '0.0' end
      as status from orders where o_orderstatus <> 'O'""",
    "open_ended_join": """select d.doc_id as question_key, l.doc_id as answer_key,
      d.lang as questaoaberta_variavel, l.quality as respostaaberta_cod,
      cast(l.toxic as varchar) as respostaaberta_label
      from documents d, labels l where d.doc_id = l.doc_id""",
    "open_ended_hot": """with answers as (
        select case when doc_id % 5 < 3 then 7 else doc_id end as k, doc_id as answer, quality from labels)
      select d.doc_id as question_key, k as answer_key, d.lang as questaoaberta_variavel, answer,
        quality as respostaaberta_cod
      from documents d join answers on d.doc_id = k""",
    "open_ended_dictionary": """select d.doc_id as option_id, d.lang as variable,
      cast(l.quality as varchar) as code, cast(l.toxic as varchar) as label
      from documents d, labels l where d.doc_id = l.doc_id""",
    "latin1_text": """select doc_id, case when not regexp_matches(t, '[^\\x00-\\xFF]') then t end
      as text from (select doc_id, case when doc_id % 10 = 0 then text || '漢' else text end as t
      from documents)""",
    "dictionary_override": """with open as (select s_suppkey as option_id,
        'Brand#' || s_nationkey as variable, cast(s_suppkey as varchar) as code, s_name as label
        from supplier)
      select p_partkey as option_id, p_brand as variable,
        cast(p_partkey as varchar) as code, p_name as label
      from part where p_brand not in (select variable from open)
      union all select * from open""",
    "dictionary_alias": """select distinct * from (
      select p_partkey as option_id, p_brand as variable,
        cast(p_partkey as varchar) as code, p_name as label from part
      union all
      select p_partkey, 'G12MRG', cast(p_partkey as varchar), p_name from part
      where p_brand = 'Brand#12')""",
    "not_in_null_safe": f"""with {SURVEY} select cast(v1 as varchar) as code,
      coalesce(v1 <> 2, true) as kept, coalesce(v1 in (1, 2), false) as listed, count(*) as n,
      sum(weight) as n_weighted from survey group by all""",
    "freq_single": freq(["v1", "v13"]),
    "freq_single_unweighted": freq(["v1", "v13"], weight="1.0::double"),
    "freq_single_empty": freq(["v1"], "nobody", extra=EMPTY),
    "freq_text_codes": TEXT_FREQ,
    "freq_multi": freq(["v5"]),
    "freq_multi_unnamed": f"""with {SURVEY}, {freq_ctes(['v5'])}
      select * replace ('v5mrg' as variable) from freq""",
    "freq_mixed_types": f"""with {SURVEY}, extra as (select *, v5_1::double / 2 as v60,
        case v13 when 1 then 'closed' when 2 then 'open' end as v61 from survey),
      {freq_ctes(['v1', 'v60', 'v61'], 'extra', texts=('v61',))}
      select * replace (case when variable = 'v60' then regexp_replace(code, '\\.0$', '') else code end
        as code) from freq""",
    "freq_fractional_weights": fractional(),
    "freq_large_codes": f"""with {SURVEY}, extra as (select v1 * 3000000000 as v62,
        v5_1::double * 1e15 as v63, v5_1::double * -0.25 as v64, weight from survey),
      {freq_ctes(['v62', 'v63', 'v64'], 'extra')}
      select * replace (case when row_kind <> 'code' then code
        when variable = 'v63' then cast(cast(row_order as bigint) as varchar)
        when variable = 'v64' then regexp_replace(code, '\\.0$', '') else code end as code)
      from freq""",
    "freq_mentioned": freq(["G019"]),
    "freq_mentioned_none": freq(["G019"], "nobody", extra=SILENT),
    "freq_all_kinds": freq(["v1", "v13", "v5", "G019"]),
    "label_coded": f"with {SURVEY}, {OPTIONS}, {freq_ctes(['v1'])} {LABELLED}",
    "label_mentioned": f"with {SURVEY}, {QUESTION_ROWS}, {freq_ctes(['G019'])} {MENTION_LABELS}",
    "label_mentioned_none": f"""with {SURVEY}, {SILENT} {QUESTION_ROWS},
      {freq_ctes(['G019'], 'nobody')} {MENTION_LABELS}""",
    "label_mentioned_from_table": f"""with {SURVEY}, questions as (
        select 'v' || p_partkey as variable, p_name as question_text,
          case when p_partkey between 19 and 21 then 'G019' else 'G000' end as question_number
        from part), {freq_ctes(['G019'])} {MENTION_LABELS}""",
    "label_coded_by": by_split(LABELLED, ["v1"]),
    "label_mentioned_by": by_split(MENTION_LABELS, ["G019"]),
    "layout_wide_all": f"""with {SURVEY}, {freq_ctes(['v1', 'v5_1'])}
      {wide_all('pct_weighted')} union all {wide_all('n_weighted')}""",
    "layout_compare_labelled": f"""with labelled as ({by_split(LABELLED, ["v1"])})
      select variable, code, row_kind, row_order, label, {', '.join(
        f"coalesce(max({m}) filter (where split = '{s}'), 0) as {m}_{s}"
        for m in ("n", "n_weighted", "pct", "pct_weighted") for s in (1, 2))}
      from labelled group by all""",
    "layout_compare_cleaned": f"""select * rename ({', '.join(
        f"{m}_{s} as {m}_{name}" for m in ("n", "n_weighted", "pct", "pct_weighted")
        for s, name in ((1, "ja_fechado_f"), (2, "em_aberto")))}) from ({compare()})""",
    "layout_tidy": f"with {SURVEY}, {freq_ctes(['v1', 'v13'])} {TIDY}",
    "layout_wide": f"""with {SURVEY}, {freq_ctes(['v1'])}
      {wide_line('pct_weighted', 1)} union all {wide_line('n_weighted', 2)}""",
    "layout_map": LAYOUT_MAP,
    "layout_compare": compare(),
    "mean_stats": f"with {SURVEY}, " + mean_select("variable", union(
        f"select '{c}' as variable, {measured(c)} as x, weight as w from survey"
        for c in ("v30m", "v5_1")
    )) + " select * from means",
    "mean_stats_shifted": f"""with {SURVEY}, rows_ as (
        select l_extendedprice + 1e9 as x, l_extendedprice as w from survey),
      centre as (select count(*) as n, 1e9 + avg(w) as a, sum(w) as kw,
          1e9 + sum(w * w) / sum(w) as m from rows_)
      select 'v66' as variable, round(any_value(a), 2) as mean, round(any_value(m), 2) as mean_weighted,
        any_value(n) as n, round(sqrt(sum((x - a) * (x - a)) / (any_value(n) - 1)), 3) as sd,
        round(sqrt(sum(w * (x - m) * (x - m)) / (any_value(kw) - 1)), 3) as sd_weighted
      from rows_, centre""",
    "mean_trimmed": f"with {SURVEY}, "
    + mean_select("variable", trimmed("v30m").replace("VARIABLE", "v30m")) + " select * from means",
    "mean_trimmed_scalable": f"with {SURVEY}, "
    + mean_select("variable", trimmed("v30m").replace("VARIABLE", "v30m")) + " select * from means",
    "mean_trimmed_by": TRIMMED_BY,
    "mean_trimmed_types": TRIMMED_TYPES,
    "mean_trimmed_ties": f"with {SURVEY}, "
    + mean_select("variable", trimmed("weight").replace("VARIABLE", "rating"))
    + " select * from means",
    "cross_single": cross(CROSS_ROWS["single"].format("v1", "v13")),
    "cross_single_outside": cross(
        union([CROSS_ROWS["single"].format("v1", "v13"), CROSS_ROWS["single"].format("v13", "v1")]),
        "option_id not in (102, 201)",
    ),
    "cross_multi": cross(CROSS_ROWS["v5"].format("v1")),
    "cross_many": cross_many(True),
    "cross_many_codes": cross_many(False),
    "cross_many_groups": cross(union(
        [CROSS_ROWS["v5"].format(c) for c in ("v1", "v13", "v19", "v20")]
        + [CROSS_ROWS["single"].format(c, r) for c in ("v1", "v13", "v19", "v20") for r in ("v13", "v21")])),
    "cross_mean": cross_mean(["v1"]),
    "cross_mean_outside": cross_mean(["v1", "v13"], "option_id <> 102"),
    "report_freq_single": report(report_freq_ctes(["v1"]), "select * from report_freq"),
    "report_freq_multi": report(report_freq_ctes(["v5"]), "select * from report_freq"),
    "report_base_single": report(report_base_ctes(["v1"]), "select * from report_base"),
    "report_base_multi": report(report_base_ctes(["v5"]), "select * from report_base"),
    "report_description": report(f"described as ({DESCRIBED})", "select * from described"),
    "report_routed": report(
        "described as (" + DESCRIBED.split("'Todas")[0] + "'FAZER DEPOIS' as note"
        + DESCRIBED.split("as note")[1] + ")", "select * from described"),
    "report_many_options": MANY_OPTIONS,
    "report_written": report(report_freq_ctes(["v1"]), "select * from report_freq"),
    "report_assembled": report(
        report_freq_ctes(["v1", "v13", "v5"]) + "," + report_base_ctes(["v1", "v13", "v5"])
        + f", described as ({DESCRIBED})",
        """select split_id, l.* exclude (split_id), d.split, d.option, d.weight from (
          select 'frequency' as line, *, null as total, null as total_weighted, null as pct_base,
            null as pct_base_weighted, null as respondents from report_freq
          union all
          select 'base', split_id, variable, null, null, null, null, null, total, total_weighted,
            pct_base, pct_base_weighted, respondents from report_base) l
        left join described d using (split_id)""",
    ),
    "report_two_batches": report(
        report_freq_ctes(["v1", "v5"]) + "," + report_base_ctes(["v1", "v5"]),
        """select 'frequency' as line, *, null as total, null as total_weighted, null as pct_base,
            null as pct_base_weighted, null as respondents from report_freq
          union all
          select 'base', split_id, variable, null, null, null, null, null, total, total_weighted,
            pct_base, pct_base_weighted, respondents from report_base"""),
    "report_two_batches_means": REPORT_MEANS,
    "report_order_options": ORDER_OPTIONS,
    "report_means": REPORT_MEANS,
}
