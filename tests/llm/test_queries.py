import duckdb
import pytest

from quillwork.llm import queries, sql

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(sql.oracle_sql()))
def test_against_sql(spark, name):
    db = duckdb.connect()
    for t in "review business pengxiang_xu_task1 documents benchmark".split():
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    got = queries.queries()[name](spark, DATA)
    want = db.execute(sql.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    assert sorted(columns) == sorted(got.columns)
    assert sorted(map(str, want.fetchall())) == sorted(str(tuple(r)) for r in got.select(*columns).collect())
