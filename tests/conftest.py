import sys
from pathlib import Path

import pytest

HERE = Path(__file__).resolve().parent
sys.path[:0] = [str(HERE.parent), str(HERE)]

from alphaloom.core.panel import Panel
from alphaloom.plans.session import session
from helpers import price_frame


@pytest.fixture(scope="session")
def spark():
    s = session(cpus=8, partitions=4)
    yield s
    s.stop()


@pytest.fixture(scope="session")
def prices():
    return price_frame()


@pytest.fixture(scope="session")
def panel(spark, prices):
    df = spark.createDataFrame(prices)
    return Panel(df.withColumn("ts", df.ts.cast("date")), grain="day")
