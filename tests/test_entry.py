"""Driver contract: the flagship query runs; every registered query has an oracle."""

import __spark_entry__ as E
from checks.oracles import ORACLES
from ragtables.queries import QUERIES


def test_entry_runs(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) > 0 and df.columns == ["question_id", "rank", "doc_id", "chunk_index", "distance"]


def test_queries_have_oracles():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(E.queries()) and set(ORACLES) <= set(E.oracle_sql()) <= set(E.queries())
    assert all(isinstance(s, str) and s.strip() for s in E.oracle_sql().values())
