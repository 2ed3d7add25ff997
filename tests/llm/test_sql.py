"""The queries of the ten operators that have SQL, against DuckDB on the smallest tables."""

import math
import os

import duckdb
import numpy as np
import pytest

from beliefmill.llm import queries, vectors

SF = "/root/testdata/sf0.001"
LARGE = "/root/testdata/sf0.1"
TABLES = "documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def plain(v):
    if isinstance(v, float):
        return "null" if math.isnan(v) else repr(v + 0.0)
    return str(v)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_against_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    df = queries.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted("|".join(map(plain, r)) for r in df.select(*columns).collect())
    found = con.execute(queries.oracle_sql()[name])
    names = [c[0] for c in found.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert got == sorted("|".join(plain(r[i]) for i in at) for r in found.fetchall()) and got


def test_vector_recall(spark):
    """The vectors of the largest table, which has hardly a near pair, and a copy of each at cosines of 0.92 to 0.99, against brute force."""
    rows = spark.read.parquet(f"{LARGE}/embeddings.parquet").orderBy("vec_id").collect()
    rng = np.random.default_rng(4)
    x = np.array([r.embedding for r in rows], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    side = rng.standard_normal(x.shape)
    side -= (side * x).sum(1, keepdims=True) * x
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    c = rng.uniform(0.92, 0.99, (len(x), 1))
    x = np.concatenate([x, c * x + np.sqrt(1 - c * c) * side])
    labels = np.array([r.label for r in rows] * 2)
    table = spark.createDataFrame([(i, v.tolist(), int(g)) for i, (v, g) in enumerate(zip(x, labels, strict=True))], "vec_id bigint, embedding array<double>, label int")
    got = {r.vec_id: r.n_links for r in vectors.near_duplicates(table).select("vec_id", "n_links").collect()}
    met = want = 0
    for q in range(len(x)):
        n = int(((x @ x[q] >= 0.93) & (labels == labels[q])).sum()) - 1
        assert got[q] <= n
        met, want = met + got[q], want + n
    assert want > 3000 and met >= 0.995 * want
