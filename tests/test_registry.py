import duckdb
import pandas as pd
import pytest

import __spark_entry__
from oriscope.jobs import registry
from oriscope.jobs.steps import Steps

DATA = "/root/testdata/sf0.01"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect(config={"memory_limit": "3GB", "threads": 2})
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def rows(df):
    df = df[sorted(df.columns)]
    plain = lambda x: "" if pd.isna(x) else f"{x:.9g}" if isinstance(x, float) else str(x)
    return sorted(tuple(map(plain, r)) for r in df.astype(object).itertuples(index=False))


@pytest.fixture(scope="module")
def steps(spark):
    """The steps of both forms of the job, each of which the queries then share."""
    return {whole: Steps(spark, DATA, assigned=whole) for whole in (False, True)}


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, duck, steps, name):
    plain = name.removesuffix("_assigned")
    found = registry.STEPS[plain](steps[plain != name]) if plain in registry.STEPS else registry.queries()[name](spark, DATA)
    got, want = found.toPandas(), duck.execute(registry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert len(want)
    assert rows(got) == rows(want)


def test_entry(spark):
    table = __spark_entry__.entry(spark)
    assert table.columns == ["genome_id", "S0", "S1", "S2", "S3"]
    found = table.collect()
    assert found and all(any(x is not None for x in row[1:]) for row in found)


def test_all_sql_has_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
