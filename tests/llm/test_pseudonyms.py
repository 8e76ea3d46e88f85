import hashlib
import itertools
import random
import re
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from surveytab.llm import pseudonyms as P

from .helpers import documents

KEY = "test key"


def feistel(values, radixes, key, kind):
    """The network once more, in Python."""
    s, half = list(values), len(radixes) // 2
    for r in range(P.ROUNDS):
        other = ",".join(str(x) for x in (s[half:] if r % 2 == 0 else s[:half]))
        new = list(s)
        for j in range(len(s)):
            if (j < half) == (r % 2 == 0):
                h = hashlib.sha256("|".join([key, kind, str(len(s)), str(r), str(j), other]).encode()).hexdigest()
                new[j] = (s[j] + int(h[:12], 16)) % radixes[j]
        s = new
    return s


def characters(value, key, kind):
    marks = [c for c in value if re.match("[A-Za-z0-9]", c)]
    base = [48 if c.isdigit() else 65 if c.isupper() else 97 for c in marks]
    done = feistel([ord(c) - b for c, b in zip(marks, base)], [10 if b == 48 else 26 for b in base], key, kind)
    put = iter(chr(b + d) for b, d in zip(base, done))
    return "".join(next(put) if re.match("[A-Za-z0-9]", c) else c for c in value)


def luhn(d):
    return sum(x if i % 2 == 0 else x * 2 - 9 * (x > 4) for i, x in enumerate(map(int, reversed(d)))) % 10


def walk(z, step, valid):
    while not valid(z):
        z = step(z)
    return z


def card(value):
    digits = re.sub(r"\D", "", value)
    step = lambda z: characters(z, KEY, "card")
    if len(digits) == 15 and digits[:2] in ("34", "37"):
        body = digits[:2] + step(digits[2:14])
    else:
        body = walk(step(digits[:-1]), step, lambda z: z[0] in "23456" and not (len(z) == 14 and z[:2] in ("34", "37")))
    put = iter(body + next(c for c in "0123456789" if luhn(body + c) == 0))
    return re.sub(r"\d", lambda m: next(put), value)


def day(value):
    first = date(1900, 1, 1)
    to_day = lambda z: first + timedelta(days=z[0] * 340 + z[1])
    step = lambda z: feistel(z, [215, 340], KEY, "date")
    given = date.fromisoformat(value)
    n = (given - first).days
    return to_day(walk(step([n // 340, n % 340]), step, lambda z: (to_day(z).day > 12) == (given.day > 12))).isoformat()


def ssn(value):
    step = lambda z: characters(z, KEY, "ssn")
    return walk(step(value), step, lambda z: not re.match("000|666|9", z))


def valid_cards(n, start=400000000000000):
    bodies = (str(start + 7919 * i) for i in range(n))
    return [b + next(c for c in "0123456789" if luhn(b + c) == 0) for b in bodies]


def replaced(spark, texts):
    rows = [(i, t, None, None, 0) for i, t in enumerate(texts)]
    found, kinds = P.pseudonymised(documents(spark, rows).coalesce(1), KEY)
    return [(r.text, r[kinds]) for r in sorted(found.collect(), key=lambda r: r.doc_id)]


def test_formats_kinds_and_brute_force(spark):
    texts = [
        "card 4802894133377406, dashed 4802-8941-3337-7406.", "bad sum 4802894133377405 and amex 3782 822463 10005, 378282246310005",
        "on 1999-02-28", "on 28.02.1999 or 1999/02/28", "not a day 1999-02-30, 1899-12-31",
        "ip 55.253.138.97. not 300.1.2.3 nor 1.2.3", "mail Joe.Doe7@mail1.example.com!", "ssn 123-45-6789 x",
        "call +1 (955) 555-8761 or +1 955 555 8761", "abc4802894133377406 1234 12 Version 2.0.", None, "", "é@ü 1",
    ]
    got = replaced(spark, texts)
    text = [t for t, _ in got]
    assert text[0] == f"card {card('4802894133377406')}, dashed {card('4802-8941-3337-7406')}."
    # Only validated numbers are permuted: one with another Luhn sum is no card, and stays.
    amex = card("3782 822463 10005")
    assert text[1] == f"bad sum 4802894133377405 and amex {amex}, {amex.replace(' ', '')}" and amex.startswith("37")
    assert text[2] == f"on {day('1999-02-28')}"
    y, m, d = day("1999-02-28").split("-")
    assert text[3] == f"on {d}.{m}.{y} or {y}/{m}/{d}"
    assert text[4] == texts[4] and got[4][1] == []
    octets = feistel([55, 253, 138, 97], [256] * 4, KEY, "ip")
    assert text[5] == f"ip {'.'.join(map(str, octets))}. not 300.1.2.3 nor 1.2.3"
    assert text[6] == f"mail {characters('Joe.Doe7', KEY, 'e@mail1.example.com')}@mail1.example.com!"
    assert re.fullmatch(r"mail [A-Z][a-z]{2}\.[A-Z][a-z]{2}\d@mail1\.example\.com!", text[6]) and text[6] != texts[6]
    assert text[7] == f"ssn {ssn('123-45-6789')} x"
    a, b = re.fullmatch(r"call (\+1 \(\d{3}\) \d{3}-\d{4}) or (\+1 \d{3} \d{3} \d{4})", text[8]).groups()
    assert re.sub(r"\D", "", a) == re.sub(r"\D", "", b) != "19555558761"
    assert text[9:] == texts[9:]
    assert [k for _, k in got[:4]] == [["card", "card"], ["card", "card"], ["date"], ["date", "date"]]
    assert got[10] == (None, [])


def test_numbers_of_no_social_security_area_stay(spark):
    texts = ["000-45-6789", "id 666-45-6789.", "900-45-6789 and 999-99-9999", "899-45-6789 and 665-45-6789"]
    got = replaced(spark, texts)
    assert got[:3] == [(t, []) for t in texts[:3]] and got[3][1] == ["ssn", "ssn"] and got[3][0] != texts[3]


@pytest.mark.parametrize("make", [
    lambda i: f"10.{i % 7}.0.{i}", lambda i: f"{date(1950, 1, 1) + timedelta(days=i)}", lambda i: f"+49 {30 + i % 5} {5550000 + i}",
    lambda i: f"u{i:03d}@x.org", lambda i: valid_cards(i + 1)[-1],
])
def test_different_values_stay_different_and_equal_ones_equal(spark, make):
    values = [make(i) for i in range(250)]
    got = [t for t, _ in replaced(spark, values + values)]
    assert got[:250] == got[250:] and len(set(got)) == 250
    assert sum(a == b for a, b in zip(got, values)) <= 2


def test_the_network_permutes_a_small_domain():
    done = {tuple(feistel(v, [3, 5, 4], KEY, "x")) for v in itertools.product(range(3), range(5), range(4))}
    assert len(done) == 60


def test_long_text_other_columns_and_empty_table(spark):
    long = "lorem 4802894133377406 ipsum " * 3000
    rows = [(1, long, None, "s", 9), (None, long, None, None, None)]
    table = documents(spark, rows).withColumnRenamed("source", "kinds").withColumnRenamed("lang", "finds")
    found, kinds = P.pseudonymised(table, KEY)
    assert kinds == "kinds_" and found.columns == [*table.columns, "kinds_"]
    for r in found.collect():
        assert r.text == long.replace("4802894133377406", card("4802894133377406")) and len(r[kinds]) == 3000
    assert P.pseudonymised(documents(spark, []), KEY)[0].collect() == []


def test_days_stay_apart_in_every_format_and_are_found_again(spark):
    """All 73 100 days: a pseudonym of a day is read as a day, and no two days have the same in any format."""
    days = spark.sql("select date_add(date'1900-01-01', cast(id as int)) as d from range(73100)")
    formats = ["yyyy-MM-dd", "yyyy/MM/dd", "dd.MM.yyyy", "MM/dd/yyyy"]
    written = [F.date_format("d", f).alias(f"f{i}") for i, f in enumerate(formats)]
    late = F.when(F.dayofmonth("d") > 12, F.date_format("d", "dd/MM/yyyy")).alias("f4")
    values = days.select("d", *written, late)
    done = values.select("d", *[F.expr(P.pseudonym(f"f{i}", KEY)).alias(f"f{i}") for i in range(5)]).cache()
    assert done.agg(*[F.count_distinct(f"f{i}") for i in range(4)]).first() == (73_100,) * 4
    slashes = done.select("f3").union(done.select("f4").filter("f4 is not null"))
    day_of = F.expr(P._day("f3"))
    assert slashes.filter(~day_of.between(0, 73_099) | day_of.isNull()).count() == 0
    # Read as what it is, one day has one pseudonym in all formats.
    same = done.filter(F.expr(f"{P._day('f0')} <> {P._day('f3')} or {P._day('f0')} <> {P._day('f2')} or {P._day('f0')} <> {P._day('f4')}"))
    assert same.count() == 0
    rng = random.Random(2)
    for r in rng.sample(values.select("f0").collect(), 40):
        assert done.filter(F.col("d") == r.f0).first().f0 == day(r.f0)


@pytest.mark.parametrize("kind, make", [
    ("card", lambda n: valid_cards(n)), ("card", lambda n: valid_cards(n, 37000000000000)), ("card", lambda n: valid_cards(n, 520000000000)),
    ("ssn", lambda n: [f"{k:03d}-{k % 97:02d}-{k:04d}" for k in range(1, 900) if k != 666][:n]),
    ("ip", lambda n: [f"10.{i % 256}.{i // 256}.7" for i in range(n)]),
    ("email", lambda n: [f"ab{i}.c-{i % 9}@mail.example.com" for i in range(n)]),
    ("phone", lambda n: [f"+49 {30 + i % 5} {5550000 + i}" for i in range(n)]),
])
def test_pseudonyms_are_found_again_as_the_same_kind(spark, kind, make):
    values = make(600)
    first = replaced(spark, values)
    again = replaced(spark, [t for t, _ in first])
    assert {tuple(k) for _, k in first} == {tuple(k) for _, k in again} == {(kind,)}
    assert len({t for t, _ in first}) == len(values)


def test_clean_numbers_stay(spark):
    wrong = [v[:-1] + str((int(v[-1]) + 1 + i % 9) % 10) for i, v in enumerate(valid_cards(200))]
    assert replaced(spark, wrong) == [(v, []) for v in wrong]
