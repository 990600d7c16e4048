"""Every registered query beside its SQL, run by DuckDB over the same tables."""

import math

import duckdb
import pytest

import __spark_entry__

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "null"
    if isinstance(v, bool):
        return str(v)
    return repr(round(float(v), 9)) if isinstance(v, (int, float)) else str(v)


def as_rows(names, rows):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted(tuple(plain(r[k]) for k in order) for r in rows)


@pytest.mark.parametrize("name", sorted(__spark_entry__.oracle_sql()))
def test_query_matches_sql(spark, sf_dir, duck, name):
    out = __spark_entry__.queries()[name](spark, sf_dir)
    own = duck.execute(__spark_entry__.oracle_sql()[name])
    names = [d[0] for d in own.description]
    assert sorted(out.columns) == sorted(names)
    rows = out.collect()
    assert len(rows) > 0
    assert as_rows(out.columns, rows) == as_rows(names, own.fetchall())


def test_entry(spark):
    out = __spark_entry__.entry(spark)
    assert out.count() > 0 and "study" in out.columns


def test_keys_reach_the_scan(spark, sf_dir):
    """The wildcard and the UID list are pushed to the files, and only what is asked for is read."""
    from tessera.queries import find_patient_wildcard

    plan = find_patient_wildcard(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<c_custkey:bigint,c_name:string>" in plan
    prefix = spark.read.parquet(f"{sf_dir}/customer.parquet")
    from pyspark.sql import functions as F

    from tessera.functions.matching import wildcard

    assert "StringStartsWith(c_name,Customer" in prefix.where(wildcard(F.col("c_name"), "Customer*"))._jdf.queryExecution().executedPlan().toString()
