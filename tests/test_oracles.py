"""Every query with a DuckDB equivalent gives its rows."""

import pytest

import __spark_entry__ as entry
from talkgrain.plans import registry
from tests.compare import both

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_equals_sql(spark, name):
    have, want = both(spark, SF, registry.QUERIES[name], registry.ORACLE_SQL[name])
    assert have == want


def test_entry_runs(spark):
    assert entry.entry(spark).columns == ["session_id", "folder", "size_bytes"]
