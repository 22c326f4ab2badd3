"""The operators' queries against their SQL on the smallest tables."""
import os

import pytest

duckdb = pytest.importorskip("duckdb")
pytest.importorskip("public_tokenizers")
from quillspark.llm import queries  # noqa: E402

from ..test_queries import SF, con, plain  # noqa: E402, F401

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_same_rows(spark, con, name):  # noqa: F811
    df = queries.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    rel = con.execute(queries.ORACLE_SQL[name])
    names = [c[0] for c in rel.description]
    assert sorted(names) == columns
    got = sorted(tuple(map(plain, r)) for r in df.select(*columns).collect())
    assert got == sorted(tuple(plain(r[names.index(c)]) for c in columns) for r in rel.fetchall())
