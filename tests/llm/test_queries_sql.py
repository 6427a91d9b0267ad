import os

import duckdb
import pytest

from oriscope.llm import queries
from tests.test_registry import TABLES, rows

NEW = [n for n in ("op11_stripes_collocations", "op12_relative_lz", "op13_hirschberg_repair") if n in queries.ORACLE]


@pytest.mark.parametrize("name", NEW)
def test_query_equals_sql(spark, name):
    data = os.environ.get("SQL_TEST_DIR", "/root/testdata/sf0.01")
    con = duckdb.connect(config={"memory_limit": "6GB", "threads": 4})
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    got, want = queries.queries()[name](spark, data).toPandas(), con.execute(queries.ORACLE[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert len(want)
    assert rows(got) == rows(want)
