"""Every registered query against its SQL in DuckDB, on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

from ontolake.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def rows(df):
    def one(v):
        if v is None or v is pd.NA or v is pd.NaT or v != v:
            return ""
        return repr(float(v)) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)

    return sorted(tuple(one(v) for v in r) for r in df[sorted(df.columns)].astype(object).itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_its_sql(spark, duck, name):
    have, want = catalog.QUERIES[name](spark, SF).toPandas(), duck.execute(catalog.ORACLES[name]).df()
    assert sorted(have.columns) == sorted(want.columns)
    assert rows(have) == rows(want)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_query_without_sql_runs(spark, name):
    assert catalog.QUERIES[name](spark, SF).count() > 0


def test_individuals_of_all_kinds_of_axioms(spark):
    from ontolake.plans.projection import Store

    have = {(r["ont_id"], r["node_key"]) for r in catalog.QUERIES["individuals_in_signature"](spark, SF).collect()}
    assert ("schema", "NamedIndividual(<urn:ex:ally>)") in have  # only in SameIndividual
    want = Store(spark, SF).reach(catalog.AXIOM_KINDS).where("node_kind = 'OWLNamedIndividual'").select("ont_id", "node_key").distinct()
    assert have == {(r["ont_id"], r["node_key"]) for r in want.collect()}


def test_entry_points():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
