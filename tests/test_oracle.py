"""Registered queries of the engine against their SQL twins on the smallest tables."""

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quernlake import queries as engine
from tests.conftest import DATA

TABLES = "region nation customer supplier part orders lineitem events documents pages".split()
SOME = ["eq_string", "in_list", "eq_numeric", "gt", "ne_compat", "ne_sound", "nin_sound", "is_null", "contains_candidates", "regex_candidates", "and_rows", "regex_rows", "pruned_aggregate", "numeric_stats", "adaptive_promoted", "json_rows", "url_host", "duration_to_ms", "alias_range", "in_subnet", "set_invert"]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS FROM read_parquet('{DATA}/{t}.parquet')")
    return con


def _rows(df):
    df = df[sorted(df.columns)]
    return sorted(tuple("NULL" if pd.isna(x) else str(float(x)) if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x) for x in r) for r in df.itertuples(index=False))


@pytest.mark.parametrize("name", SOME)
def test_query_equals_its_sql(spark, duck, name):
    got = engine.QUERIES[name](spark, DATA).toPandas()
    expected = duck.sql(engine.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(expected.columns) and _rows(got) == _rows(expected)


def test_eq_high_cardinality_of_repeated_names_and_null_keys(spark, tmp_path):
    """More names than an exact path has by its threshold, in more than one row group each, one of them without a key."""
    name = F.format_string("Customer#%09d", F.col("id") % 12000)
    rows = spark.range(36000).select(F.when(F.col("id") < 24000, F.col("id")).alias("c_custkey"), name.alias("c_name"))
    rows.coalesce(1).write.parquet(str(tmp_path / "customer.parquet"))
    got = [r["rg_id"] for r in engine.QUERIES["eq_high_cardinality"](spark, str(tmp_path)).collect()]
    with duckdb.connect() as con:
        con.execute(f"CREATE VIEW customer AS FROM read_parquet('{tmp_path}/customer.parquet/*.parquet')")
        expected = [r[0] for r in con.sql(engine.ORACLE_SQL["eq_high_cardinality"]).fetchall()]
    assert len(got) == len(expected) == 3 and set(got) == set(expected) == {None, 0, 120}


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
