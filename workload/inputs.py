"""Survey-shaped inputs made from the driver's tables.

``SURVEY_COLUMNS`` is SQL that Spark and DuckDB read alike, so both engines work on
the same interviews.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from surveytab.functions.frames import literal_rows

WEIGHT = "weight"
SLOTS = {"v5": ["v5_1", "v5_2", "v5_3"]}
MENTIONS = {"G019": ["v19", "v20", "v21"]}
TIE_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]

# A weight that is no round number.
FRACTION = "l_extendedprice * (0.1D + weight) / (3.7D + l_linenumber)"

SURVEY_COLUMNS = [
    *TIE_KEY,
    "l_quantity as weight",
    """case when l_linenumber = 7 then null when l_returnflag = 'A' then 1
            when l_returnflag = 'N' then 2 when l_returnflag = 'R' then 3 end as v1""",
    "case l_linestatus when 'F' then 1 when 'O' then 2 end as v13",
    "case when l_linenumber in (6, 7) then null else l_linenumber end as v5_1",
    """case when l_quantity >= 25 and l_linenumber not in (6, 7)
            then cast(l_quantity as int) % 5 + 1 end as v5_2""",
    """case when l_quantity >= 40 and l_linenumber not in (6, 7)
            then cast(l_quantity as int) % 3 + 1 end as v5_3""",
    "case when l_linenumber = 7 then null when l_quantity > 10 then 1 else 0 end as v19",
    "case when l_linenumber = 7 then null when l_returnflag = 'A' then 1 else 0 end as v20",
    """case when l_linenumber = 7 then null
            when l_linestatus = 'O' and l_quantity > 30 then 1 else 0 end as v21""",
    """case when round(l_discount * 100) = 0 then -88.0
            when round(l_discount * 100) = 10 then -99.0
            else l_extendedprice end as v30m""",
]

# Where each variable's option ids start in the dictionary.
FIRST_OPTION = {"v1": 100, "v13": 200, "v5": 300, "v19": 400, "v20": 410, "v21": 420}

# Options of v1 that no interview holds: an unused one and the two for no answer.
UNUSED_V1 = (4, -88, -99)

CODES = {
    "v1": (1, 2, 3, *UNUSED_V1), "v13": (1, 2), "v5": (1, 2, 3, 4, 5),
    "v19": (0, 1), "v20": (0, 1), "v21": (0, 1),
}

# Measures of several types, as SQL for both engines.
MEASURES = [
    ("m1", "cast(floor(l_extendedprice) as int)"),
    ("m2", "l_partkey * 3000000000"),
    ("m3", "cast(l_extendedprice * 3 as decimal(14,2))"),
    ("m4", "case when l_orderkey % 3 = 0 then 1000.5 else l_extendedprice end"),
    ("m5", "cast(l_linenumber % 3 as int)"),
]

# The report's splits and their weights: was it returned, is it a large order, is it open and large.
REPORT_SPLITS = ["Geral", "v20", "v19", "v21"]
REPORT_WEIGHTS = [None, WEIGHT, WEIGHT, None]

QUESTIONS = [
    ("v19", "G019", "Ordered more than ten"),
    ("v20", "G019", "Returned"),
    ("v21", "G019", "Open and large"),
    ("v40", "G040", "Never asked"),
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def survey(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One interview per line item."""
    return table(spark, sf_dir, "lineitem").selectExpr(*SURVEY_COLUMNS)


def survey_options(spark: SparkSession) -> DataFrame:
    """The dictionary of the interviews, written out: their codes and three that none holds."""
    rows = [
        [FIRST_OPTION[v] + code, v, str(code), f"{v} option {code}"]
        for v, codes in CODES.items() for code in codes
    ]
    names = ("option_id", "variable", "code", "label")
    return literal_rows(spark, dict(zip(names, ("bigint", "string", "string", "string"))), rows)


def survey_questions(spark: SparkSession) -> DataFrame:
    """The question texts, written out: four rows."""
    names = ("variable", "question_number", "question_text")
    return literal_rows(spark, dict.fromkeys(names, "string"), QUESTIONS)


def part_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dictionary as long as the part table: brands as questions."""
    return table(spark, sf_dir, "part").selectExpr(
        "p_partkey as opcao_id",
        "p_brand as opcao_variavel",
        "p_partkey as opcao_cod",
        "p_name as opcao_label",
    )


def supplier_open_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open-ended codes for some of those questions: suppliers by nation."""
    return table(spark, sf_dir, "supplier").selectExpr(
        "s_suppkey as opcao_id",
        "concat('Brand#', cast(s_nationkey as string)) as opcao_variavel",
        "s_suppkey as opcao_cod",
        "s_name as opcao_label",
    )


def ship_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ship days of 1996, over 300 of them, as the options of one question."""
    days = table(spark, sf_dir, "orders").filter(
        "o_orderdate >= date'1996-01-01' and o_orderdate < date'1997-01-01'"
    ).selectExpr("cast(date_format(o_orderdate, 'yyyyMMdd') as bigint) as code").distinct()
    return days.selectExpr(
        "code as option_id", "'v70' as variable", "cast(code as string) as code",
        "concat('day ', cast(code as string)) as label",
    )


def ordered_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An interview per order: the day as a code, and the priority's number."""
    return table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey", "cast(date_format(o_orderdate, 'yyyyMMdd') as bigint) as v70",
        "cast(substr(o_orderpriority, 1, 1) as int) as v71", "cast(o_orderkey % 7 + 1 as double) as weight",
    )


def priorities(spark: SparkSession) -> DataFrame:
    rows = [[1_000_000_000 + i, "v71", str(i), f"priority {i}"] for i in range(1, 6)]
    names = ("option_id", "variable", "code", "label")
    return literal_rows(spark, dict(zip(names, ("bigint", "string", "string", "string"))), rows)


# Twenty questions of all types, as SQL for both engines: name, expression, type of the code.
WIDE_COLUMNS = [
    *[(f"c{i}", f"case when l_partkey % {11 + i} = 0 then null else cast(l_partkey % {2 + i % 4} as int) end", "int")
      for i in range(8)],
    *[(f"c{i}", f"cast(l_suppkey % {3 + i % 3} as double) / 2", "double") for i in range(8, 13)],
    *[(f"c{i}", f"concat('answer ', cast(l_orderkey % {2 + i % 3} as varchar(9)))", "text") for i in range(13, 17)],
    ("c17", "l_returnflag", "text"),
    ("c18", "l_linenumber", "int"),
    ("c19", "cast(l_quantity as bigint)", "int"),
]
WIDE_ROWS = [
    *[(f"r{i}", f"cast(l_orderkey % {3 + i % 4} as int)", "int") for i in range(9)],
    *[(f"r{i}", f"case when l_linenumber = {i - 8} then null else cast(l_partkey % {2 + i % 3} as double) * 0.25 end", "double")
      for i in range(9, 14)],
    *[(f"r{i}", f"concat('x', cast(l_suppkey % {2 + i % 4} as varchar(9)))", "text") for i in range(14, 19)],
    ("r19", "l_linestatus", "text"),
]
# Of each question of WIDE_COLUMNS and WIDE_ROWS the dictionary lists these codes and some unused ones.
WIDE_LISTED = {
    "int": [str(i) for i in range(-1, 6)],
    "double": ["0", "0.25", "0.5", "1", "1.5", "9.5"],
    "text": ["answer 0", "answer 1", "x0", "x1", "x2", "A", "R", "F", "O"],
}


def wide_survey(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One interview per line item with forty questions."""
    columns = [f"{sql} as {name}" for name, sql, _ in [*WIDE_COLUMNS, *WIDE_ROWS]]
    return table(spark, sf_dir, "lineitem").selectExpr(*columns, "l_quantity as weight")


def wide_options(spark: SparkSession) -> DataFrame:
    """The dictionary of these questions, written out."""
    rows = [
        [1000 * n + i, name, code, f"{name} {code}"]
        for n, (name, _, kind) in enumerate([*WIDE_COLUMNS, *WIDE_ROWS]) for i, code in enumerate(WIDE_LISTED[kind])
    ]
    names = ("option_id", "variable", "code", "label")
    return literal_rows(spark, dict(zip(names, ("bigint", "string", "string", "string"))), rows)
