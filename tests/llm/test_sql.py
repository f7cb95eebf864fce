"""What SQL says of the operators' results, on the smallest tables."""

import duckdb
import pytest

from tests.conftest import SF
from tests.test_oracles import plain
from vellum.llm import queries


@pytest.mark.parametrize("name", sorted(n for n in queries.oracles() if n.startswith("sql_")))
def test_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "embeddings", "benchmark"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    df = queries.queries()[name](spark, SF)
    columns = sorted(df.columns)
    cur = con.execute(queries.oracles()[name])
    names = [c[0] for c in cur.description]
    assert sorted(names) == columns
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    assert got == sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in cur.fetchall()), key=repr)
