"""Every engine query gives what its SQL says."""

import glob
import os

import duckdb
import pytest

from vecloom.operators import evaluate
from vecloom.queries import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"


def rows(df):
    return sorted(tuple(float(v) if isinstance(v, float) else v for v in r) for r in df.itertuples(index=False))


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, db, name):
    found = QUERIES[name](spark, DATA).toPandas()
    assert len(found)
    if name in ORACLE_SQL:
        wanted = db.execute(ORACLE_SQL[name]).df()
        assert set(found.columns) == set(wanted.columns)
        assert rows(found) == rows(wanted[list(found.columns)])


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_recall_of_queries_from_outside(spark):
    from vecloom.operators import nearest
    from vecloom.queries import held_out

    found = QUERIES["graph_walk_held_out"](spark, DATA).cache()
    pts, queries = held_out(spark, DATA)
    assert not found.join(queries, found["nbr"] == queries["query_id"]).count()
    assert evaluate.recall(found, nearest.exact_knn(queries, pts, 10)).first()["recall"] > 0.9


def test_knn_graph_descent_recall(spark):
    found = QUERIES["knn_graph_descent"](spark, DATA).withColumnRenamed("src", "query_id").cache()
    truth = QUERIES["exact_knn_graph"](spark, DATA).withColumnRenamed("src", "query_id")
    assert {r["count"] for r in found.groupBy("query_id").count().collect()} == {10}
    assert evaluate.recall(found, truth).first()["recall"] > 0.9
