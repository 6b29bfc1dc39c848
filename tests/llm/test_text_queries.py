"""Every text query runs and gives the columns that are asked for."""

import pytest

from tracewright.llm.queries import QUERIES

COLUMNS = {"p1_found": ["run_id", "chat_id"], "p2_found": ["chat_id"], "p3_found": ["log_name", "entry_id", "kind"], "p8_ids": ["doc_id", "ids"], "p9_found": ["doc_id", "eval_id"], "p10_found": ["doc_id"]}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_runs(spark, sf, name):
    df = QUERIES[name](spark, sf)
    assert df.columns == COLUMNS.get(name, df.columns)
    n = df.count()
    assert n == df.distinct().count() and n > 0
