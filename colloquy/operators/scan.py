"""Scans over rows in one global order: what came before a row, running numbers, runs. No key and no task holds them all.

Rows are dealt by ranges of the order, so that even a key with a third of all rows is spread, and stored with their place
(`PLACE`: the range in the upper bits, the row in it in the lower 33). A scan then runs within each range, and one row a range
(its edges and counts, as many as there are tasks) is added up on the driver and sent back.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colloquy.sources.scratch import stored

PLACE = "__place"
RANGE = "__range"
ROW_BITS = 33  # as monotonically_increasing_id has it


def in_order(df: DataFrame, by: list[str | Column], name: str = "in-order") -> DataFrame:
    """df stored in the order of `by`, with PLACE and RANGE. Ties beyond `by` are spread too, in any order."""
    tie = "__tie"
    by = [F.col(c).asc_nulls_first() if isinstance(c, str) else c for c in by]
    rows = df.withColumn(tie, F.monotonically_increasing_id())
    rows = rows.repartitionByRange(*by, tie).sortWithinPartitions(*by, tie).drop(tie)
    rows = rows.withColumn(PLACE, F.monotonically_increasing_id())
    return stored(rows, name).withColumn(RANGE, F.shiftright(PLACE, ROW_BITS))


def _sent(rows: DataFrame, values: list[tuple], columns: str) -> DataFrame:
    """rows with columns that hold one value for each range; values: one row a range."""
    schema = T.StructType([T.StructField(RANGE, T.LongType()), *T.StructType.fromDDL(columns).fields])
    return rows.join(F.broadcast(rows.sparkSession.createDataFrame(values, schema)), RANGE)


def numbered(rows: DataFrame, name: str) -> DataFrame:
    """rows of in_order with their global number: 0, 1, ..."""
    counts = rows.groupBy(RANGE).agg(F.count("*").alias("n")).collect()  # one row a range
    out, sofar = [], 0
    for r in sorted(counts):
        out.append((r[RANGE], sofar))
        sofar += r.n
    return _sent(rows, out, "__before long").withColumn(name, F.col("__before") + F.col(PLACE).bitwiseAND((1 << ROW_BITS) - 1)).drop("__before")


def _own_order() -> Any:
    return Window.partitionBy(RANGE).orderBy(PLACE)


def begun(rows: DataFrame, now: Column, begins: Callable[[Column, Column], Column], name: str, text: str | None = None) -> DataFrame:
    """rows of in_order with `name`: whether begins(now, what it was in the row before) holds, and `name`_no, how often it held so far.
    The first of all rows begins. now: a struct of what is compared, without texts, since the edges of ranges go through the driver.
    text: a column that `now` has a hash of; where the text itself differs from the row before, a row begins too."""
    w = _own_order()
    differs = F.lit(False) if text is None else ~F.col(text).eqNullSafe(F.lag(text).over(w))
    slim = rows.select(RANGE, PLACE, now.alias("now"), *([text] if text else [])).withColumn("before", F.lag("now").over(w)).withColumn("differs", differs)
    inside = F.col("before").isNotNull() & (F.coalesce(begins(F.col("now"), F.col("before")), F.lit(True)) | F.col("differs"))
    edges = slim.groupBy(RANGE).agg(F.min_by("now", PLACE).alias("first"), F.max_by("now", PLACE).alias("last"), F.count_if(inside).alias("n"))
    ends = edges.agg(F.array_sort(F.collect_list(F.struct(RANGE, "first", "last", "n"))).alias("ends"))  # one row, an entry for each range
    first = F.transform("ends", lambda x, i: F.when(i == 0, True).otherwise(F.coalesce(begins(x.first, F.get("ends", i - 1).last), F.lit(True))))
    found = ends.select(F.col(f"ends.{RANGE}").alias("at"), first.alias("first"), F.col("ends.n").alias("n")).first()
    out, sofar = [], 0
    for at, begin, n in zip(found.at, found["first"], found.n, strict=True):
        out.append((at, begin, sofar + begin))
        sofar += begin + n
    got = _sent(rows.withColumn("__now", now), out, "__first boolean, __upto long").withColumn("__was", F.lag("__now").over(w)).withColumn("__differs", differs)
    here = F.when(F.col("__was").isNull(), F.col("__first")).otherwise(F.coalesce(begins(F.col("__now"), F.col("__was")), F.lit(True)) | F.col("__differs"))
    got = got.withColumn(name, here)
    later = F.sum((F.col(name) & F.col("__was").isNotNull()).cast("long")).over(w)
    return got.withColumn(f"{name}_no", F.col("__upto") + later).drop("__now", "__was", "__first", "__upto", "__differs")
