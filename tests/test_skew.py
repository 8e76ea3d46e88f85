"""Joins with heavy keys: the same rows as a plain join, dealt out evenly."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from surveytab.functions.skew import heavy_keys, spread_join
from surveytab.sources.dictionary import open_ended_answers


def rows_of(df):
    return Counter(map(str, df.collect()))


@pytest.fixture(scope="module")
def answers(spark):
    """Sixty in a hundred answers are to question 7; some name no question."""
    return spark.range(20_000, numPartitions=4).selectExpr(
        "case when id % 5 < 3 then 7 when id % 501 = 0 then null else id % 400 end as q", "id as answer")


@pytest.fixture(scope="module")
def questions(spark):
    return spark.range(390).selectExpr("id as q", "concat('v', id) as variable")


@pytest.fixture()
def tasks(spark):
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    for k, v in zip(before, ("16", "false", "-1")):
        spark.conf.set(k, v)
    yield 16
    for k, v in before.items():
        spark.conf.set(k, v)


def test_heavy_keys_are_found(answers):
    assert [(r.key, r.parts >= 16 * 8 * 0.55) for r in heavy_keys(answers, "q", 16).collect()] == [(7, True)]


def test_same_rows_as_a_plain_join(spark, questions, answers, tasks):
    plain = open_ended_answers(questions, answers, "q")
    spread = open_ended_answers(questions, answers, "q", spread_hot=True)
    assert spread.columns == plain.columns == ["q...1", "variable", "q...3", "answer"]
    assert rows_of(spread) == rows_of(plain)
    twice = questions.unionByName(questions.filter("q in (7, 8)"))  # repeated keys, on both sides
    assert rows_of(open_ended_answers(twice, answers, "q", spread_hot=True)) == rows_of(open_ended_answers(twice, answers, "q"))


@pytest.mark.parametrize("kind", ["int", "string", "double", "decimal(12,2)"])
def test_types_that_differ_between_the_sides(questions, answers, tasks, kind):
    other = questions.withColumn("q", F.col("q").cast(kind))
    assert rows_of(open_ended_answers(other, answers, "q", spread_hot=True)) == rows_of(open_ended_answers(other, answers, "q"))


def test_a_heavy_question_does_not_fill_one_task(questions, answers, tasks):
    def longest(df):
        n = sorted(r["count"] for r in df.groupBy(F.spark_partition_id().alias("p")).count().collect())
        return n[-1] / n[len(n) // 2]

    assert longest(open_ended_answers(questions, answers, "q")) > 10
    assert longest(open_ended_answers(questions, answers, "q", spread_hot=True)) < 2


def test_empty_sides(questions, answers):
    assert spread_join(questions, answers.limit(0), 0, 0).count() == 0
    assert spread_join(questions.limit(0), answers, 0, 0).count() == 0
