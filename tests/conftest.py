import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from rareflow.operators.splits import holdout_split  # noqa: E402
from rareflow.session import local_session, stage_table  # noqa: E402
from rareflow.sources.star import counts_from_orders  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = local_session("8", "tests", spark__sql__shuffle__partitions="4")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def counts(spark):
    return stage_table(counts_from_orders(spark, SMALL))


@pytest.fixture(scope="session")
def split(counts):
    """Half train, a quarter each for validation and test."""
    return stage_table(holdout_split(counts.drop("p_a", "p_b"), 0.25, 1 / 3))
