"""The dictionary of codes and labels, and the question texts.

Options have the columns ``option_id, variable, code, label``; their order is that
of ``option_id`` and codes are canonical text. Questions have ``variable,
question_number, question_text``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from surveytab.functions.codes import canonical_code, column
from surveytab.functions.frames import require_columns
from surveytab.functions.skew import spread_join
from surveytab.sources.responses import unique_names

# The column names of the source tables, in the order
# option_id / variable / code / label and variable / number / text.
OPTION_COLUMNS = ("opcao_id", "opcao_variavel", "opcao_cod", "opcao_label")
OPEN_COLUMNS = (
    "questaoaberta_id", "questaoaberta_variavel", "respostaaberta_cod", "respostaaberta_label",
)
QUESTION_COLUMNS = ("opcao_variavel", "pergunta_num_quest", "pergunta_enunciado")


def options_from(df: DataFrame, columns: Sequence[str] = OPTION_COLUMNS) -> DataFrame:
    """Options of closed questions: four columns, codes made canonical."""
    require_columns(df, columns)
    option_id, variable, code, label = columns
    return df.select(
        column(option_id).cast("bigint").alias("option_id"),
        column(variable).cast("string").alias("variable"),
        canonical_code(df, code).alias("code"),
        column(label).cast("string").alias("label"),
    )


def questions_from(df: DataFrame, columns: Sequence[str] = QUESTION_COLUMNS) -> DataFrame:
    require_columns(df, columns)
    names = ("variable", "question_number", "question_text")
    return df.select(*[column(c).cast("string").alias(n) for c, n in zip(columns, names)])


def open_ended_answers(
    questions: DataFrame, answers: DataFrame, key: str = "questaoaberta_id", spread_hot: bool = False
) -> DataFrame:
    """Every coded open answer with its question, all columns of both sides; the
    key appears on both and gets ``...position`` names. With ``spread_hot``, the answers to a question
    that has very many are dealt out over many tasks (see :func:`spread_join`), at the cost of
    one more scan of the answers' key."""
    require_columns(questions, [key])
    require_columns(answers, [key])
    if spread_hot:
        at = questions.columns.index(key), answers.columns.index(key)
        return unique_names(spread_join(questions, answers, *at))
    q, a = questions.alias("q"), answers.alias("a")
    quoted = "`" + key.replace("`", "``") + "`"
    return unique_names(q.join(a, F.col(f"q.{quoted}") == F.col(f"a.{quoted}"), "inner"))


def open_ended_options(joined: DataFrame, columns: Sequence[str] = OPEN_COLUMNS) -> DataFrame:
    """Codes of open answers as dictionary options, from
    :func:`open_ended_answers`; the first copy of the key is the option id."""
    first = [c for c in joined.columns if c.startswith(f"{columns[0]}...")][:1] or [columns[0]]
    return options_from(joined, [*first, *columns[1:]])


def override_options(options: DataFrame, open_options: DataFrame) -> DataFrame:
    """Variables with open-ended codes take these in place of their options."""
    closed = options.join(open_options.select("variable").distinct(), "variable", "left_anti")
    return closed.unionByName(open_options)


def alias_options(options: DataFrame, source: str, alias: str) -> DataFrame:
    """Give one variable's options to another name as well, as for a group."""
    copied = options.filter(F.col("variable") == source).withColumn("variable", F.lit(alias))
    return options.unionByName(copied).distinct()


def check_options(options: DataFrame) -> DataFrame:
    """The options, unless a variable lists a code twice; runs a small job."""
    repeated = (
        options.groupBy("variable", "code").count().filter("count > 1").limit(5).collect()
    )
    if repeated:
        listed = ", ".join(f"{r['variable']}={r['code']}" for r in repeated)
        raise ValueError(f"codes listed more than once in the dictionary: {listed}")
    return options
