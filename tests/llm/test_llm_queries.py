import os

import pytest

from drydock.llm.queries import ORACLE, QUERIES
from oracle import DATA, connect, same

pytestmark = pytest.mark.skipif(not os.path.exists(DATA), reason="no test tables here")


@pytest.fixture(scope="module")
def con():
    return connect()


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_as_sql(spark, con, name):
    same(QUERIES[name](spark, DATA), con, ORACLE[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_runs(spark, name):
    df = QUERIES[name](spark, DATA)
    got = df.collect()
    assert len(set(map(str, got))) == len(got)
