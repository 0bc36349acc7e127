import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from compare import connect, difference

from tallyloom.llm.queries import QUERIES, SQL


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, name):
    folder = "/root/testdata/sf0.001"
    rows, problem = difference(spark, connect(folder), name, folder, QUERIES[name], SQL[name])
    assert not problem and rows
