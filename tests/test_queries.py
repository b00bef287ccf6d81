"""The registered queries of the engine against DuckDB on the smallest tables."""

from __future__ import annotations

import glob
import os

import pytest

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the tables are not here")


def rows(pdf):
    cols = sorted(pdf.columns)
    return cols, sorted(map(tuple, pdf[cols].astype(str).to_numpy().tolist()))


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def names():
    from tessera import queries

    return sorted(queries.QUERIES)


@pytest.mark.parametrize("name", names())
def test_query(spark, duck, name):
    from tessera import queries

    got = queries.QUERIES[name](spark, SF).toPandas()
    if name in queries.ORACLE_SQL:
        assert rows(got) == rows(duck.sql(queries.ORACLE_SQL[name]).df())
    else:
        assert len(got)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 10
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_pruning_and_projection(spark, root):
    """A routed search opens the probed clusters' files only and reads no full vectors for its candidates."""
    import numpy as np

    from tessera.database import Database
    from tessera.operators import search as S
    from tessera.queries import collection

    own = Database(spark, root).create_collection("docs", 64, 32)
    own.insert_batch(collection(spark, SF).select("id", "vector", "metadata"))
    found = S.candidates(own._stored(), np.ones(64), [1, 2])
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "cluster_id" in plan.split("PartitionFilters: [")[1].split("]")[0]
    scan = [x for x in plan.split("ReadSchema: ")[1:]][0].splitlines()[0]
    assert "q:array" in scan and ",v:array" not in scan
