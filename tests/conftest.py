import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF001 = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from tessera.session import build_session
    s = build_session(master="local[4]", shuffle_partitions=8, extra={"spark.driver.memory": "4g"})
    yield s
    s.stop()


@pytest.fixture(scope="session")
def stats10(spark):
    """Ten rows: B rises with A by groups, C faster; values made for these tests."""
    rows = [(i, 3 * i + (i % 3), 7 * i + 40 - (i % 4), g, "FM"[i % 2]) for i, g in enumerate("XXXYYYZZZZ", 1)]
    return spark.createDataFrame(rows, "A int, B int, C int, Group string, Gender string")


@pytest.fixture(scope="session")
def nulls5(spark):
    """A: mean 6 of the known values; B: mean and median 14; C: text; one null each."""
    rows = [(3.0, None, "k"), (9.0, 8.0, "l"), (None, 12.0, None), (5.0, 16.0, "m"), (7.0, 20.0, "n")]
    return spark.createDataFrame(rows, "A double, B double, C string")


@pytest.fixture(scope="session")
def credit8(spark):
    """Eight rows with a 0/1 target, numbers on regular steps."""
    rows = [(21 + 4 * i, 30000 + 2500 * (i * 3 % 8), 18000 + 1700 * (i * 5 % 8), 0.05 * (i * 3 % 8 + 1), int(i in (2, 5, 6)), "NSEWNSEW"[i])
            for i in range(8)]
    return spark.createDataFrame(rows, "age int, income int, expense int, debt_ratio double, default int, city string")
