"""Reading interviews and other survey tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from surveytab.functions.codes import TEXT, code_type, column
from surveytab.functions.frames import require_columns
from surveytab.functions.names import repair_names


# The columns of a table of interviews that say which of them count.
STATUS, CODED_AT = "status", "codificacao_abertas_data"


def read_table(
    spark: SparkSession, source: str, format: str = "parquet", completed: bool = False, **options
) -> DataFrame:
    """Any Spark source, with repeated column names told apart and text limited
    to latin-1. For a database pass ``format="jdbc"`` and its options.

    ``completed`` keeps :func:`completed_interviews`. It is applied before text is
    limited, so that the source gets both conditions.
    """
    reader = spark.read.format(format).options(**options)
    df = unique_names(reader.load(source) if source else reader.load())
    return latin1_text(completed_interviews(df) if completed else df)


def completed_interviews(
    df: DataFrame, status: str = STATUS, coded_at: str = CODED_AT
) -> DataFrame:
    """Valid interviews (status 0) whose open answers have been coded. A status that is
    text is compared as a code: what is no number is no 0."""
    require_columns(df, [status, coded_at])
    if code_type(df.schema[status].dataType) == TEXT:
        valid = column(status).try_cast("double") == 0
    else:
        valid = column(status) == 0
    return df.filter(valid & column(coded_at).isNotNull())


def unique_names(df: DataFrame) -> DataFrame:
    """Repeated column names become ``name...position``."""
    names = repair_names(df.columns)
    return df if names == df.columns else df.toDF(*names)


def latin1_text(df: DataFrame) -> DataFrame:
    """Text holding a character outside latin-1 becomes null, as a whole."""
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    if not texts:
        return df
    return df.withColumns(
        {name: F.when(~column(name).rlike(r"[^\x00-\xFF]"), column(name)) for name in texts}
    )
