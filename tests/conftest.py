import pytest

from workload.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session("4")
    # The tests' tables are tiny; fewer tasks make them quicker.
    session.conf.set("spark.sql.shuffle.partitions", 2)
    return session


@pytest.fixture(scope="session")
def interviews(spark):
    """Four interviews; the expected figures were worked out by hand."""
    return spark.createDataFrame(
        [
            (1, 1.0, 1, 1, 2, 1, 0, 10.0),
            (2, 2.0, 2, 1, 1, 1, 1, 20.0),
            (3, 0.5, None, None, None, None, None, -99.0),
            (4, 1.5, 1, 3, None, 0, 0, 30.0),
        ],
        "id int, w double, v1 int, v5_1 int, v5_2 int, v19 int, v20 int, v30m double",
    ).cache()


@pytest.fixture(scope="session")
def options(spark):
    rows = [
        (1, "v1", "1", "one"), (2, "v1", "2", "two"),
        (3, "v5", "1", "a"), (4, "v5", "2", "b"), (5, "v5", "3", "c"),
        (6, "v19", "0", "no"), (7, "v19", "1", "yes"),
    ]
    return spark.createDataFrame(
        rows, "option_id int, variable string, code string, label string"
    ).cache()


def as_dict(df, keys, values, digits=4):
    """{key tuple: value tuple}, floats rounded."""
    def tidy(v):
        return round(v, digits) if isinstance(v, float) else v

    rows = df.collect()
    out = {tuple(r[k] for k in keys): tuple(tidy(r[v]) for v in values) for r in rows}
    assert len(out) == len(rows), "keys are not unique"
    return out
