"""Every training-data query with a DuckDB equivalent gives its rows, on a table and on a few odd texts."""

import pytest

from talkgrain.llm.queries import ORACLE_SQL, QUERIES
from tests.compare import both

LICENSE = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"
ODD = [
    None, "", " \t ", "one two", "ONE two", "a b c d e", "a b c d e\x0bf", "é" * 80, "é" * 80, "x" * 250, "y" * 99 + "x" * 120 + "é" * 60,
    "Apache License, MIT license; cc by", "the gnu general public  LICENSE gnu general public license", "licensed under the very apache license version 2 0", LICENSE,
]


ROLES = ["system", "user", "assistant"]


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, name):
    have, want = both(spark, "/root/testdata/sf0.001", QUERIES[name], ORACLE_SQL[name])
    assert have == want


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_odd_texts(spark, name, tmp_path):
    rows = [(i, t, "en", "web", len(t or "")) for i, t in enumerate(ODD)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    turns = [(c, None if t == 3 else t, None if ((c or 0) + t) % 5 == 0 else ROLES[(t + (c or 0) // 40) % 3], ODD[(t * t + (c or 0) // 60) % len(ODD)]) for c in [*range(95, 140), 200, 205, 300, None] for t in range(c % 9 if c else 2)]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    have, want = both(spark, str(tmp_path), QUERIES[name], ORACLE_SQL[name])
    assert have == want
