"""The queries with SQL give the same rows as DuckDB."""

import duckdb
import pytest

from plumbline.llm import sql
from plumbline.llm.queries import QUERIES
from tests.llm.conftest import DATA


@pytest.mark.parametrize("name", sorted(sql.SQL))
def test_rows_equal(spark, name):
    found = QUERIES[name](spark, DATA)
    columns = sorted(found.columns)
    con = duckdb.connect()
    for t in ("documents", "benchmark", "labels", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    wanted = con.execute(f"SELECT {', '.join(columns)} FROM ({sql.SQL[name]})").fetchall()
    assert sorted(map(str, wanted)) == sorted(str(tuple(r)) for r in found.select(*columns).collect())
