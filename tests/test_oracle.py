"""Every query against its SQL twin on the smallest tables."""

import pytest

from check_oracle import ROOT, compare, connection
from stackfolio.queries import QUERIES

FOLDER = f"{ROOT}/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connection(FOLDER)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    good, message = compare(spark, con, FOLDER, name)
    assert good, message
