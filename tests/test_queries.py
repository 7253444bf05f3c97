"""Every registered query with SQL gives what DuckDB gives on the same tables."""

import os

import duckdb
import numpy as np
import pytest

SF, LARGE = "/root/testdata/sf0.001", "/root/testdata/sf0.1"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")

from vecspark import queries  # noqa: E402
from vecspark.queries import ORACLE_SQL, QUERIES  # noqa: E402


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def plain(df):
    cell = lambda v: None if v is None or v != v else float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else v
    return sorted((tuple(map(cell, r)) for r in df[sorted(df.columns)].astype(object).itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, db, name):
    got = QUERIES[name](spark, SF).toPandas()
    if name in ORACLE_SQL:
        want = db.sql(ORACLE_SQL[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        want = want.astype(object).where(want.notna(), None)
        got = got.astype(object).where(got.notna(), None)
        assert plain(got) == plain(want)
    else:
        assert len(got) > 0


@pytest.mark.skipif(not os.path.isdir(LARGE), reason="needs the test tables")
@pytest.mark.parametrize("kind", ["pq", "ivf", "hnsw", "diskann"])
def test_recall_of_registered_settings(spark, kind):
    """Against brute force, with what the registered query searches; over queries that the query itself doesn't ask."""
    search = getattr(queries, f"_{kind}")(spark, LARGE) if kind in ("pq", "ivf") else queries._graphs(spark, LARGE, kind == "hnsw")
    own = sorted(spark.read.parquet(f"{LARGE}/embeddings.parquet").select("vec_id", "embedding").collect())
    ids, vectors = [r[0] for r in own], np.array([r[1] for r in own], float)
    asked, found = range(0, len(own), len(own) // 8), 0
    for i in asked:
        want = {ids[j] for j in np.argsort(((vectors - vectors[i]) ** 2).sum(axis=1), kind="stable")[:10]}
        got = [r[0] for r in search(vectors[i].tolist()).collect()]
        assert len(got) == 10
        found += len(want & set(got))
    assert found >= 0.9 * 10 * len(asked)


@pytest.mark.skipif(not os.path.isdir(LARGE), reason="needs the test tables")
def test_membership_of_all_documents(spark):
    got = {r.doc_id: r.present for r in QUERIES["bloom_membership"](spark, LARGE).collect()}
    inside = {r[0] for r in spark.read.parquet(f"{LARGE}/labels.parquet").select("doc_id").collect()}
    others = [i for i in got if i not in inside]
    assert len(got) == spark.read.parquet(f"{LARGE}/documents.parquet").count() and others
    assert all(got[i] for i in inside if i in got) and sum(got[i] for i in others) <= 0.02 * len(others)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 10
    assert set(QUERIES) <= set(__spark_entry__.queries())
