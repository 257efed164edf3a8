"""Every query of the catalogue against its SQL, on the smallest tables."""

import glob
import os

import duckdb
import pytest

import __spark_entry__
from tallyforge.plans import catalogue


def oracle(sql, sf_dir):
    con = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con.execute(sql).fetchdf()


def rows(pdf):
    clean = lambda v: None if v is None or v != v else float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else v
    pdf = pdf[sorted(pdf.columns)].astype(object).where(pdf[sorted(pdf.columns)].notna(), None)
    return sorted(repr(tuple(map(clean, r))) for r in pdf.itertuples(index=False, name=None))


#: Queries that find nothing in the smallest tables.
MAY_BE_EMPTY = {"alerts_list_account"}


def test_bounds_of_the_metering_queries_are_met(sf_dir):
    """The customer that is looked up has line items on both sides of the exact set of dimensions."""
    sql = catalogue.SQL
    exact, three = oracle(sql["usage_dim_and2_of_3_exact_set"], sf_dir), oracle(sql["breakdown_3d"], sf_dir)
    assert (exact["count"] > 0).sum() == 1 and len(three) > 1


def test_each_query_has_sql():
    assert set(catalogue.QUERIES) == set(catalogue.SQL)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query_equals_its_sql(spark, sf_dir, name):
    got, expected = catalogue.QUERIES[name](spark, sf_dir).toPandas(), oracle(catalogue.SQL[name], sf_dir)
    assert len(got) or name in MAY_BE_EMPTY
    assert sorted(got.columns) == sorted(expected.columns)
    assert rows(got) == rows(expected)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(catalogue.QUERIES) <= set(__spark_entry__.queries())
