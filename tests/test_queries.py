"""Each registered query against its SQL on the smallest tables."""

import datetime
import glob
import os

import duckdb
import pytest

from colloquy import catalog


def plain(v):
    if isinstance(v, float):
        return round(v, 6) + 0.0
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


@pytest.fixture(scope="module")
def con(tiny):
    c = duckdb.connect()
    for f in glob.glob(f"{tiny}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f).removesuffix('.parquet')} AS SELECT * FROM read_parquet('{f}')")
    return c


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_gives_the_rows_of_its_sql(spark, tiny, con, name):
    cur = con.execute(catalog.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    want = sorted((tuple(plain(x) for _, x in sorted(zip(names, row))) for row in cur.fetchall()), key=repr)
    df = catalog.queries()[name](spark, tiny)
    assert sorted(df.columns) == sorted(names)
    got = sorted((tuple(plain(r[c]) for c in sorted(names)) for r in df.collect()), key=repr)
    assert got == want


def test_entry_and_queries_without_sql(spark, tiny):
    import __spark_entry__ as entry

    assert catalog.flagship(spark, tiny).count() > 0
    assert entry.oracle_sql().keys() <= entry.queries().keys()
    packs = catalog.queries()["translation_packs"](spark, tiny)
    assert packs.count() == catalog.queries()["translation_work"](spark, tiny).count()


def test_every_turn_of_a_user_is_asked(spark, tiny):
    """Only one conversation of 100 was."""
    asked = spark.read.parquet(f"{tiny}/conversations.parquet").filter("role = 'user'").count()
    got = catalog.queries()["encoder_comparison"](spark, tiny).filter("document = 'ALL'").select("config", "n_queries").collect()
    assert {r.n_queries for r in got} == {asked} and len(got) == 6
