import pytest

from spindrift.llm.queries import ORACLES, QUERIES
from tests.oracle import both


@pytest.mark.parametrize("name", ORACLES)
def test_equals_sql(spark, name):
    got, want = both(spark, QUERIES[name], ORACLES[name])
    assert got[0] == want[0] and got[1] == want[1]
