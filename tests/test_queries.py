"""Every registered query that has SQL against DuckDB on the same tables."""

import duckdb
import pandas as pd
import pytest

from cadenza.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def rows(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)].astype(object)
    return sorted((tuple(None if pd.isna(x) else float(x) if isinstance(x, (int, float)) and not isinstance(x, bool) else x for x in r) for r in df.itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_matches_sql(spark, duck, sf_dir, name):
    got, want = registry.QUERIES[name](spark, sf_dir).toPandas(), duck.sql(registry.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_entry_has_rows(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
