from __future__ import annotations

import pytest

from silverprint.llm.queries import ORACLES, QUERIES
from tests.parity_check import duck, rows_of

SF_DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, name):
    df = QUERIES[name](spark, SF_DIR)
    result = duck(SF_DIR).execute(ORACLES[name])
    columns = [d[0] for d in result.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows_of(df.columns, df.collect()) == rows_of(columns, result.fetchall())
