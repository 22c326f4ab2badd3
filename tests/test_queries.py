"""Registered queries against their SQL on the smallest tables."""
import os

import pytest

duckdb = pytest.importorskip("duckdb")
from quillspark.plans import oracle, queries  # noqa: E402

SF = os.environ.get("QUILLSPARK_TEST_SF", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in TABLES:
        path = f"{SF}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def plain(v):
    if isinstance(v, bool) or v is None:
        return str(v)
    return f"{float(v):.7g}" if isinstance(v, (int, float)) else str(v)


@pytest.mark.parametrize("name", sorted(oracle.ORACLE_SQL))
def test_same_rows(spark, con, name):
    df = queries.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(tuple(map(plain, r)) for r in df.select(*columns).collect())
    rel = con.execute(oracle.ORACLE_SQL[name])
    names = [c[0] for c in rel.description]
    want = sorted(tuple(plain(r[names.index(c)]) for c in columns) for r in rel.fetchall())
    assert sorted(names) == columns and got == want


def test_every_statement_has_a_query():
    assert set(oracle.ORACLE_SQL) <= set(queries.QUERIES)
