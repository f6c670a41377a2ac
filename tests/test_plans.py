"""Every query of the library's own operators against its SQL."""

import pytest

from spindrift.plans import ORACLES, QUERIES
from tests.oracle import both


@pytest.mark.parametrize("name", ORACLES)
def test_equals_sql(spark, name):
    got, want = both(spark, QUERIES[name], ORACLES[name])
    assert got[0] == want[0] and got[1] == want[1]
    assert got[1], "an empty result shows nothing"


def test_every_query_has_sql_or_a_test_here():
    assert set(QUERIES) - set(ORACLES) == {"v16_greedy_dedupe", "u01_embedding_hook", "w08_admission", "w09_session_store", *(n for n in QUERIES if n.startswith(("v11_search_", "v20_similar_")) and n != "v20_similar_search"), "v29_lab_baseline", "v29_lab_no_keyword_filters", "v29_lab_visual_hubness"}
