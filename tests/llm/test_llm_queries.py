"""The registered queries: against their SQL, or whole where SQL has no words for it."""

import pytest

from check_queries import compare, connect
from tracewarden.llm.queries import ORACLES, QUERIES

#: Tested against brute force or held-out accuracy in this folder.
NO_SQL = {"op2_language_id", "op7_minhash_near_dedup", "op10_url_filters", "op12_token_counts"}
TABLES = {"op2_language_id": "documents", "op7_minhash_near_dedup": "documents", "op10_url_filters": "pages", "op12_token_counts": "documents"}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, folder, name):
    from __spark_entry__ import queries

    found = compare(spark, connect(folder), folder, name, queries()[name], ORACLES.get(name))
    if name in NO_SQL:
        rows = spark.read.parquet(f"{folder}/{TABLES[name]}.parquet").count()
        assert found == f"rows only ({rows})"
    else:
        assert found.startswith("ok"), found


def test_entry_knows_all():
    from __spark_entry__ import oracle_sql, queries

    assert set(QUERIES) | {"pipeline"} <= set(queries()) and set(ORACLES) <= set(oracle_sql())
    assert {n.split("_")[0] for n in QUERIES} == {f"op{i}" for i in range(1, 14)}
