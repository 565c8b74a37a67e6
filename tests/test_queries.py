"""Every query with SQL against DuckDB on the small tables."""

import math
from concurrent.futures import ThreadPoolExecutor

import duckdb
import pytest

from routeloom.jobs.queries import oracle_sql, queries

SF = "/root/testdata/sf0.01"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def canon(rows):
    return sorted(tuple("nan" if isinstance(v, float) and math.isnan(v) else float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v) for v in r) for r in rows)


@pytest.fixture(scope="module")
def results(spark):
    """Columns and rows of every query, four at a time: most of them are many small jobs."""

    def ran(name):
        try:
            df = queries()[name](spark, SF)
            columns = sorted(df.columns)
            return columns, canon(df.select(*columns).collect())
        except Exception as error:
            return error

    with ThreadPoolExecutor(4) as pool:
        return dict(zip(oracle_sql(), pool.map(ran, oracle_sql())))


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_agrees_with_sql(results, db, name):
    if isinstance(results[name], Exception):
        raise results[name]
    columns, got = results[name]
    found = db.sql(oracle_sql()[name])
    assert columns == sorted(found.columns)
    assert len(got) > 0 and got == canon(found.select(*columns).fetchall())


def test_spanning_tree_and_fragments(spark):
    edges = sorted((r["len"], r["i"], r["j"]) for r in queries()["knn_graph_supplier"](spark, SF).collect())
    from routeloom.operators.construct import greedy_fragments, minimum_spanning_tree

    df = spark.createDataFrame([(i, j, n) for n, i, j in edges], "i long, j long, len long")

    def scan(limit):
        parent, degree, out = {}, {}, []

        def root(x):
            while parent.setdefault(x, x) != x:
                x = parent[x]
            return x

        for n, i, j in edges:
            if root(i) != root(j) and degree.get(i, 0) < limit and degree.get(j, 0) < limit:
                parent[root(i)] = root(j)
                degree[i], degree[j] = degree.get(i, 0) + 1, degree.get(j, 0) + 1
                out.append((i, j, n))
        return sorted(out)

    assert sorted(map(tuple, minimum_spanning_tree(df).select("i", "j", "len").collect())) == scan(10**9)
    assert sorted(map(tuple, greedy_fragments(df).select("i", "j", "len").collect())) == scan(2)
