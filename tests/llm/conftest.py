import pandas as pd
import pytest


@pytest.fixture
def frame(spark):
    """DataFrame from rows and a DDL schema; spread over a few partitions."""

    def make(rows, ddl="doc_id long, text string", parts=3):
        return spark.createDataFrame([tuple(r) for r in rows], ddl).repartition(parts)

    return make


def rows_of(df, *order):
    return sorted((tuple(r) for r in df.select(*order).collect()), key=repr)


@pytest.fixture
def rows():
    return rows_of


PROSE = (
    "the quick brown fox jumps over the lazy dog while seven wizards boxed quietly in the hall and nobody noticed that "
    "the lamp had gone out because the moon was bright enough to read by until the clock struck twelve and everyone left "
    "for home along the river path singing an old song about rain"
)


@pytest.fixture
def prose():
    return PROSE


def frame_of(df):
    return df.toPandas().astype(object).where(lambda x: pd.notna(x), None)
