"""The operators' SQL on the smallest tables."""

import glob
import os

import duckdb
import pytest

from colloquy.llm import queries as Q

from ..test_queries import plain


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_query_gives_the_rows_of_its_sql(spark, tiny, name):
    con = duckdb.connect()
    for f in glob.glob(f"{tiny}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f).removesuffix('.parquet')} AS SELECT * FROM read_parquet('{f}')")
    cur = con.execute(Q.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    want = sorted((tuple(plain(x) for _, x in sorted(zip(names, row))) for row in cur.fetchall()), key=repr)
    df = Q.queries()[name](spark, tiny)
    assert sorted(df.columns) == sorted(names)
    assert sorted((tuple(plain(r[c]) for c in sorted(names)) for r in df.collect()), key=repr) == want
