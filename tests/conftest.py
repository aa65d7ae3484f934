import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [ROOT, os.path.join(ROOT, "tests")]

from voxloom.schemas import CATALOG_SCHEMA  # noqa: E402
from voxloom.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, shuffle_partitions=4, memory="4g")
    yield session
    session.stop()


# A few well-known rows, and made-up ones for ties and empty splits.
CATALOG_ROWS = [
    ("aba_one", "Abba", "aba", "CI", 1776, 5.03, 1574, 166, 36),
    ("bel_two", "Belo", "bel", "GH", 6908, 20.30, 6038, 441, 429),
    ("cor_tie", "Coro", "cor", "KE", 100, 11.24, 80, 20, 0),
    ("dun_tie", "Duna", "dun", "CI", 100, 11.24, 100, 0, 0),
    ("ewi_few", "Ewi", "ewi", "NG", 20, 0.07, 20, 0, 0),
    ("twi_twi", "Twi", "twi", "GH", 17140, 50.32, 15794, 828, 518),
    ("zul_non", "Zulo", "zul", "XX", 0, 0.0, 0, 0, 0),
]


@pytest.fixture(scope="session")
def catalog(spark):
    return spark.createDataFrame(CATALOG_ROWS, CATALOG_SCHEMA)


def subsets(df):
    return [row.subset for row in df.orderBy("position").collect()]
