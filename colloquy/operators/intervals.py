"""Unions of intervals and what they leave out."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def union(intervals: DataFrame, key: str, start: str = "start", end: str = "end") -> DataFrame:
    """key, start, end of merged intervals; touching ones merge, ones that aren't numbers or have no length are dropped."""
    number = lambda c: F.expr(f"try_cast({c} as double)")
    rows = intervals.select(key, number(start).alias("start"), number(end).alias("end")).filter("end > start")
    w = Window.partitionBy(key).orderBy("start", "end")
    reach = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("new", F.coalesce((F.col("start") > reach).cast("int"), F.lit(1)))
    return rows.withColumn("island", F.sum("new").over(w)).groupBy(key, "island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("island")


def complement(spans: DataFrame, intervals: DataFrame, key: str, duration: str, least: float = 0.1) -> DataFrame:
    """key, start, end (rounded to 2) of gaps of at least `least`: before, between and after the merged intervals of each row of spans
    (key, duration); with no valid interval the whole of it."""
    merged = union(intervals, key)
    w = Window.partitionBy(key).orderBy("start")
    between = merged.select(key, F.col("end").alias("a"), F.lead("start").over(w).alias("b")).filter("b is not null")
    ends = merged.groupBy(key).agg(F.min("start").alias("first"), F.max("end").alias("last"))
    outer = spans.select(key, F.col(duration).cast("double").alias("d")).join(ends, key, "left")
    head = outer.filter("first is not null").select(key, F.lit(0.0).alias("a"), F.col("first").alias("b"))
    tail = outer.filter("last is not null and d > 0").select(key, F.col("last").alias("a"), F.col("d").alias("b"))
    empty = outer.filter("first is null and d > 0").select(key, F.lit(0.0).alias("start"), F.round("d", 2).alias("end"))
    gaps = between.unionByName(head).unionByName(tail).filter(F.col("b") - F.col("a") >= least)
    return gaps.select(key, F.round("a", 2).alias("start"), F.round("b", 2).alias("end")).unionByName(empty)
