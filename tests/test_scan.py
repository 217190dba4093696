import random

import pytest
from pyspark.sql import functions as F

from colloquy.operators import scan


def rows_of(n, seed):
    rnd = random.Random(seed)
    return [(rnd.choice([None, "a", "a", "a", "b", "c"]), rnd.randrange(60), k) for k in range(n)]


def in_python(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", r[1], r[2]))


def far(now, was):
    return ~now.k.eqNullSafe(was.k) | (now.t - was.t > 3)


@pytest.fixture(autouse=True)
def apart(spark):
    """Small ranges stay apart."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_numbers_and_runs_over_edges_of_ranges(spark):
    for n, parts in ((0, 3), (1, 3), (200, 1), (200, 7), (5, 40)):
        rows = rows_of(n, n)
        before = spark.conf.get("spark.sql.shuffle.partitions")
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        try:
            df = scan.in_order(spark.createDataFrame(rows, "k string, t int, id long"), ["k", "t", "id"])
            want = in_python(rows)
            assert {r.id: r.no for r in scan.numbered(df, "no").collect()} == {r[2]: i for i, r in enumerate(want)}
            expect, no = {}, 0
            for i, r in enumerate(want):
                begins = i == 0 or want[i - 1][0] != r[0] or r[1] - want[i - 1][1] > 3
                no += begins
                expect[r[2]] = (begins, no)
            got = scan.begun(df, F.struct("k", "t"), far, "new").collect()
            assert {r.id: (r.new, r.new_no) for r in got} == expect
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", before)


def test_a_key_with_most_rows_is_spread(spark):
    df = spark.createDataFrame([("hot" if k % 10 else f"k{k}", 1, k) for k in range(2000)], "k string, t int, id long").repartition(4)
    sizes = [r["count"] for r in scan.in_order(df, ["k", "t"]).groupBy(scan.RANGE).count().collect()]
    assert len(sizes) > 1 and max(sizes) < 1500
