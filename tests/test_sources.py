import pytest
from pyspark.sql import functions as F

from surveytab.sources.dictionary import (
    alias_options,
    check_options,
    open_ended_answers,
    open_ended_options,
    options_from,
    override_options,
    questions_from,
)
from surveytab.sources.responses import (
    completed_interviews,
    latin1_text,
    read_table,
    unique_names,
)


def test_completed_interviews(spark):
    df = spark.createDataFrame(
        [(1, 0, "2021"), (2, 1, "2021"), (3, 0, None), (4, None, "2021")],
        "id int, status int, codificacao_abertas_data string",
    )
    assert [r.id for r in completed_interviews(df).collect()] == [1]
    with pytest.raises(ValueError, match="status2"):
        completed_interviews(df, status="status2")


def test_completed_interviews_reach_the_scan(spark, tmp_path):
    path = str(tmp_path / "r")
    spark.range(10).selectExpr(
        "id", "cast(id % 2 as int) as status", "string(id) as codificacao_abertas_data", "id as x"
    ).write.parquet(path)
    df = read_table(spark, path, completed=True).select("id")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(status,0)" in plan and "IsNotNull(codificacao_abertas_data)" in plan
    assert "x:bigint" not in plan.split("ReadSchema")[1]


def test_latin1(spark):
    df = spark.createDataFrame(
        [(1, "São Paulo"), (2, "漢字"), (3, None), (4, "ok\n漢"), (5, "€")], "id int, t string"
    )
    assert [r.t for r in latin1_text(df).orderBy("id").collect()] == [
        "São Paulo", None, None, None, None,
    ]


@pytest.mark.parametrize("format", ["parquet", "json", "csv", "orc"])
def test_read_table(spark, tmp_path, format):
    path = str(tmp_path / format)
    spark.createDataFrame([("a", "1"), ("漢", "2")], "x string, y string").write.format(
        format
    ).option("header", True).save(path)
    options = {"header": True} if format == "csv" else {}
    got = read_table(spark, path, format, **options)
    assert sorted((r.x or "", r.y) for r in got.collect()) == [("", "2"), ("a", "1")]


def test_unique_names(spark):
    df = spark.range(1).selectExpr("id as a", "id as b", "id as a")
    assert unique_names(df).columns == ["a...1", "b", "a...3"]
    assert unique_names(unique_names(df)).columns == ["a...1", "b", "a...3"]


def _options(spark, rows):
    return spark.createDataFrame(
        rows, "opcao_id int, opcao_variavel string, opcao_cod double, opcao_label string"
    )


def test_open_ended_codes_override(spark):
    closed = options_from(
        _options(spark, [(1, "v1", 1.0, "one"), (2, "v2", 1.0, "uno"), (3, "v2", 2.0, "due")])
    )
    questions = spark.createDataFrame(
        [(10, "v2"), (11, "v9")], "questaoaberta_id int, questaoaberta_variavel string"
    )
    answers = spark.createDataFrame(
        [(10, 7, "seven"), (10, 8, "eight"), (99, 1, "lost")],
        "questaoaberta_id int, respostaaberta_cod int, respostaaberta_label string",
    )
    joined = open_ended_answers(questions, answers)
    assert joined.columns[:1] == ["questaoaberta_id...1"] and "questaoaberta_id...3" in joined.columns
    merged = override_options(closed, open_ended_options(joined))
    got = sorted((r.variable, r.code, r.label) for r in merged.collect())
    assert got == [("v1", "1", "one"), ("v2", "7", "seven"), ("v2", "8", "eight")]


def test_override_with_nothing_keeps_all(spark):
    closed = options_from(_options(spark, [(1, "v1", 1.0, "one")]))
    assert override_options(closed, closed.filter("false")).count() == 1


def test_alias(spark):
    closed = options_from(_options(spark, [(1, "fruit", 1.0, "one"), (2, "v2", 1.0, "uno")]))
    aliased = alias_options(closed, "fruit", "any_fruit")
    assert sorted((r.variable, r.code) for r in aliased.collect()) == [
        ("any_fruit", "1"), ("fruit", "1"), ("v2", "1"),
    ]
    assert alias_options(aliased, "fruit", "any_fruit").count() == 3


def test_repeated_codes_are_refused(spark):
    twice = options_from(_options(spark, [(1, "v1", 1.0, "one"), (2, "v1", 1.0, "uno")]))
    with pytest.raises(ValueError, match="v1=1"):
        check_options(twice)
    assert check_options(twice.filter(F.col("option_id") == 1)).count() == 1


def test_questions(spark):
    df = spark.createDataFrame(
        [("v1", "Q1", "Who?", 3)],
        "opcao_variavel string, pergunta_num_quest string, pergunta_enunciado string, extra int",
    )
    assert questions_from(df).first().asDict() == {
        "variable": "v1", "question_number": "Q1", "question_text": "Who?",
    }


def test_text_status(spark):
    df = spark.createDataFrame(
        [(1, "0"), (2, "abc"), (3, None), (4, "0.0"), (5, "1")], "id int, status string"
    ).withColumn("codificacao_abertas_data", F.lit("x"))
    assert [r.id for r in completed_interviews(df).collect()] == [1, 4]


def test_large_option_ids(spark):
    df = spark.sql("select 3000000000L as opcao_id, 'v1' as opcao_variavel, 1 as opcao_cod, 'a' as opcao_label")
    assert options_from(df).first().option_id == 3_000_000_000
