"""Format-preserving pseudonyms for personal numbers, dates and addresses, in column functions.

One pattern finds candidates; each is validated (octets, calendar, number of digits), and a
valid one is replaced by a keyed permutation of its format. A value is a list of places with a radix
each: a digit has 10, an ASCII letter 26 (of its case), an octet 256, a date is one place of 215 and
one of 340 (73 100 days from 1900-01-01). Eight rounds of a Feistel network add to one half of the
places a number drawn from SHA-256 of the key, the kind, the round and the other half, modulo
each radix. That is a permutation of the format. Where only some of its values are valid, the network is
applied again until one is (a cycle walk), which is a permutation of the valid ones: cards keep their first
digit from 2 to 6, or their 34 or 37 and 15 digits, and a Luhn sum of 0; social security numbers
stay in areas that are given out; days after the 12th stay so, and the others too, as it decides how
07/10/1918 is read. So every pseudonym is found again as what it stands for, equal values get equal pseudonyms in all
documents, and different ones never do. Separators stay as they are and do not
count: the same digits written otherwise get the same digits. Numbers that are not valid, such as cards with
another Luhn sum, stay as they are.

The text between the finds is not touched. Everything is Spark SQL; there is no Python
per row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import fresh

ROUNDS = 8
# The network is applied so many times at most. Of the formats here at least four in ten values are valid, so
# the longest walk of 10^13 numbers has some 60 steps.
STEPS = 128
KINDS = ("email", "ip", "date", "phone", "card", "ssn")
_D = "[0-9]"
SSN_AREA = "^(?!000|666|9)"
# A find is not part of a longer word or number.
_LEFT, _RIGHT = r"(?<![\p{L}0-9_@])(?<![0-9][.-])", r"(?![\p{L}0-9_@]|[.-][0-9])"
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,24}",
    "ip": rf"{_D}{{1,3}}(?:\.{_D}{{1,3}}){{3}}",
    "date": rf"{_D}{{4}}-{_D}{{2}}-{_D}{{2}}|{_D}{{4}}/{_D}{{2}}/{_D}{{2}}|{_D}{{2}}/{_D}{{2}}/{_D}{{4}}|{_D}{{2}}\.{_D}{{2}}\.{_D}{{4}}",
    "ssn": rf"{_D}{{3}}-{_D}{{2}}-{_D}{{4}}",
    "card": rf"[2-6]{_D}{{3}}(?:[ -]?{_D}{{4}}){{2}}[ -]?{_D}{{1,7}}|3[47]{_D}{{2}}[ -]?{_D}{{6}}[ -]?{_D}{{5}}",
    "phone": rf"\+{_D}{{1,3}}[ .-]?(?:\({_D}{{1,4}}\)|{_D}{{1,4}})(?:[ .-]?{_D}{{2,4}}){{2,4}}"
    rf"|\({_D}{{3}}\) ?{_D}{{3}}[ .-]{_D}{{4}}|{_D}{{3}}[.-]{_D}{{3}}[.-]{_D}{{4}}",
}
ANY = rf"{_LEFT}(?:" + "|".join(f"(?:{p})" for p in PATTERNS.values()) + rf"){_RIGHT}"


def _whole(kind: str) -> str:
    return f"^(?:{PATTERNS[kind]})$"


def _sql(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _hash_number(parts: str) -> str:
    """48 bits of SHA-256, as a number."""
    return f"cast(conv(substr(sha2(concat_ws('|', {parts}), 256), 1, 12), 16, 10) as bigint)"


def _feistel(values: str, radixes: str, key: str, kind: str) -> str:
    """SQL for the permuted list: ``values`` has a number below each of ``radixes``."""
    half = f"cast(size({radixes}) / 2 as int)"
    other = (
        f"array_join(if(r % 2 = 0, slice(s, {half} + 1, size(s)), slice(s, 1, {half})), ',')"
    )
    shift = _hash_number(f"{_sql(key)}, {kind}, size(s), r, j, {other}")
    return (
        f"aggregate(sequence(0, {ROUNDS - 1}), {values}, (s, r) -> transform(s, (v, j) -> "
        f"if((j < {half}) = (r % 2 = 0), pmod(v + {shift}, element_at({radixes}, j + 1)), v)))"
    )


def _walk(first: str, again: str, valid: str) -> str:
    """SQL for the first valid one of ``first`` and what ``again`` makes of it (``z``) in turn."""
    return f"aggregate(sequence(1, {STEPS}), {first}, (z, step) -> if({valid}, z, {again}))"


def _characters(value: str, key: str, kind: str) -> str:
    """Every ASCII letter and digit of ``value`` permuted within its class; the rest stays."""
    chars = f"split({value}, '')"
    marks = f"filter({chars}, c -> c rlike '^[A-Za-z0-9]$')"
    radix = f"transform({marks}, c -> if(c rlike '[0-9]', 10L, 26L))"
    base = "if(c rlike '[0-9]', 48, if(c rlike '[A-Z]', 65, 97))"
    values = f"transform({marks}, c -> cast(ascii(c) - {base} as bigint))"
    done = _feistel("p.v", "p.r", key, kind)
    place = "length(regexp_replace(substr(p.t, 1, i + 1), '[^A-Za-z0-9]', ''))"
    return (
        "element_at(transform(transform("
        f"array(named_struct('t', {value}, 'v', {values}, 'r', {radix})), "
        f"p -> named_struct('t', p.t, 'd', {done})), "
        f"p -> array_join(transform(split(p.t, ''), (c, i) -> if(c rlike '^[A-Za-z0-9]$', "
        f"chr(element_at(p.d, {place}) + {base}), c)), '')), 1)"
    )


def _luhn(digits: str) -> str:
    """The Luhn sum of all digits, modulo 10; 0 is valid."""
    double = "(length({d}) - 1 - i) % 2 = 1".format(d=digits)
    return (
        f"aggregate(transform(split({digits}, ''), (c, i) -> if({double}, "
        "cast(c as int) * 2 - if(cast(c as int) > 4, 9, 0), cast(c as int))), 0, (a, x) -> a + x) % 10"
    )


def _as_written(value: str, digits: str) -> str:
    """``digits`` in the places of the digits of ``value``."""
    place = f"length(regexp_replace(substr({value}, 1, i + 1), '[^0-9]', ''))"
    return (
        f"array_join(transform(split({value}, ''), (c, i) -> "
        f"if(c rlike '[0-9]', substr({digits}, {place}, 1), c)), '')"
    )


def _let(name: str, value: str, then: str) -> str:
    return f"element_at(transform(array({value}), {name} -> {then}), 1)"


def _card(m: str, key: str) -> str:
    """All digits but the last are permuted, among the cards of their kind; the last makes the Luhn sum 0."""
    body = "substr(q.d, 1, length(q.d) - 1)"
    kind = _sql("card")
    # Fifteen digits after 34 or 37 are a format of their own, in which these two stay.
    short = "concat(substr(q.d, 1, 2), " + _characters("substr(q.d, 3, 12)", key, kind) + ")"
    walked = _walk(
        _characters(body, key, kind), _characters("z", key, kind),
        "z rlike '^[2-6]' and not (length(z) = 14 and z rlike '^3[47]')")
    permuted = f"if(length(q.d) = 15 and q.d rlike '^3[47]', {short}, {walked})"
    last = f"cast(pmod(- ({_luhn('concat(q.b, chr(48))')}), 10) as string)"
    inner = _let("q", f"named_struct('t', q.t, 'd', q.d, 'b', {permuted})", _as_written("q.t", f"concat(q.b, {last})"))
    return _let("q", f"named_struct('t', {m}, 'd', regexp_replace({m}, '[^0-9]', ''))", inner)


def _ssn(m: str, key: str) -> str:
    return _walk(_characters(m, key, _sql("ssn")), _characters("z", key, _sql("ssn")), f"z rlike {_sql(SSN_AREA)}")


def _ip(m: str, key: str) -> str:
    octets = f"transform(split({m}, '[.]'), o -> cast(o as bigint))"
    return f"array_join({_feistel(octets, 'array(256L, 256L, 256L, 256L)', key, _sql('ip'))}, '.')"


DATE_FORMATS = {
    r"^\d{4}-": "yyyy-MM-dd", r"^\d{4}/": "yyyy/MM/dd", r"^\d\d\.": "dd.MM.yyyy",
}
DAYS, DATE_RADIX = 73100, (215, 340)


def _date_format(m: str) -> str:
    known = " ".join(f"when {m} rlike {_sql(p)} then '{f}'" for p, f in DATE_FORMATS.items())
    month_first = f"to_date(try_to_timestamp({m}, 'MM/dd/yyyy')) is not null"
    return f"case {known} when {month_first} then 'MM/dd/yyyy' else 'dd/MM/yyyy' end"


def _day(m: str) -> str:
    """Days from 1900-01-01; null if there is no such day."""
    return f"datediff(to_date(try_to_timestamp({m}, {_date_format(m)})), date'1900-01-01')"


def _date(m: str, key: str) -> str:
    a, b = DATE_RADIX
    pair = f"array(cast(div(q.n, {b}) as bigint), cast(q.n % {b} as bigint))".replace(f"div(q.n, {b})", f"q.n div {b}")
    radixes, kind = f"array({a}L, {b}L)", _sql("date")
    late = f"(day(date_add(date'1900-01-01', cast(z[0] * {b} + z[1] as int))) > 12)"
    done = _walk(
        _feistel(pair, radixes, key, kind), _feistel("z", radixes, key, kind),
        f"{late} = (day(date_add(date'1900-01-01', q.n)) > 12)")
    back = _let("z", done, f"date_format(date_add(date'1900-01-01', cast(z[0] * {b} + z[1] as int)), {_date_format('q.t')})")
    return _let("q", f"named_struct('t', {m}, 'n', {_day(m)})", back)


def _email(m: str, key: str) -> str:
    local = f"substring_index({m}, '@', 1)"
    rest = f"substr({m}, length({local}) + 1)"
    return f"concat({_characters(local, key, f'concat({_sql(chr(101))}, lower({rest}))')}, {rest})"


def _phone(m: str, key: str) -> str:
    """The country code stays; the other digits are permuted."""
    code = f"regexp_extract({m}, '^\\\\+[0-9]{{1,3}}(?=[ .(-])', 0)"
    rest = f"substr({m}, length({code}) + 1)"
    digits = f"regexp_replace({rest}, '[^0-9]', '')"
    permuted = _characters("q.d", key, f"concat('phone', {code.replace(m, 'q.m')})")
    return _let(
        "q", f"named_struct('m', {m}, 'c', {code}, 't', {rest}, 'd', {digits})",
        f"concat(q.c, {_let('w', permuted, _as_written('q.t', 'w'))})",
    )


def kind_of(m: str) -> str:
    """SQL for the kind of a find, null if it is not valid."""
    octets = f"forall(split({m}, '[.]'), o -> cast(o as int) < 256)"
    digits = f"regexp_replace({m}, '[^0-9]', '')"
    n, luhn = f"length({digits})", _let("digits", digits, _luhn("digits"))
    return (
        f"case when {m} rlike {_sql(_whole('email'))} then 'email' "
        f"when {m} rlike {_sql(_whole('ip'))} then if({octets}, 'ip', null) "
        f"when {m} rlike {_sql(_whole('date'))} then if({_day(m)} between 0 and {DAYS - 1}, 'date', null) "
        f"when {m} rlike {_sql(_whole('ssn'))} then if({m} rlike {_sql(SSN_AREA)}, 'ssn', null) "
        f"when {m} rlike {_sql(_whole('card'))} and {n} between 13 and 19 and {luhn} = 0 then 'card' "
        f"when {m} rlike {_sql(_whole('phone'))} and {n} between 7 and 15 then 'phone' end"
    )


def pseudonym(m: str, key: str) -> str:
    """SQL for what stands in the place of the find ``m``; ``m`` itself if it is not valid."""
    return _let("f", f"named_struct('m', {m}, 'k', {kind_of(m)})", (
        f"case f.k when 'email' then {_email('f.m', key)} when 'ip' then {_ip('f.m', key)} "
        f"when 'date' then {_date('f.m', key)} when 'card' then {_card('f.m', key)} "
        f"when 'ssn' then {_ssn('f.m', key)} "
        f"when 'phone' then {_phone('f.m', key)} else f.m end"
    ))


def pseudonymised(documents: DataFrame, key: str) -> tuple[DataFrame, str]:
    """``documents`` with its ``text`` pseudonymised, and a column (named ``kinds``, with
    underscores if there is one) that lists the kinds of what was replaced, in order.

    Null text stays null, with no kinds; other columns, null or not, stay as they are.
    """
    kinds, finds = fresh(documents, "kinds"), fresh(documents, "finds")
    some = F.col("text").rlike("[0-9]|@")
    found = documents.withColumn(
        finds, F.when(some, F.regexp_extract_all("text", F.lit(ANY), F.lit(0))).otherwise(
            F.array().cast("array<string>"))
    )
    put = F.expr(f"transform({finds}, m -> {pseudonym('m', key)})")
    between = F.split("text", ANY, -1)
    whole: Column = F.when(F.size(finds) > 0, F.concat_ws(
        "", F.flatten(F.zip_with(between, F.concat(put, F.array(F.lit(""))), lambda g, p: F.array(g, p)))
    )).otherwise(F.col("text"))
    listed = F.expr(f"filter(transform({finds}, m -> {kind_of('m')}), k -> k is not null)")
    columns = [whole.alias(c) if c == "text" else F.col(f"`{c}`") for c in documents.columns]
    return found.select(*columns, listed.alias(kinds)), kinds
