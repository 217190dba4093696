"""Sessions: what one pair wrote without a long gap."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .clean import with_runs


def sessions(df: DataFrame, key: str = "dyad", ts: str = "ts", order: str = "src_row", gap_seconds: float = 3600) -> DataFrame:
    """df with sid: 1, 2, ... in order of key and time, by a scan over all rows in that order; no key's rows are one task's."""
    return with_runs(df, [key], ts, order, gap_seconds).withColumnRenamed("run", "sid").drop("begins")


def mixed_sessions(df: DataFrame, key: str = "dyad") -> DataFrame:
    """Sessions with more than one pair: there must be none."""
    return df.groupBy("sid").agg(F.count_distinct(key).alias("n_keys")).filter("n_keys > 1")


def session_report(df: DataFrame, tokens: str | None = None, budget: int = 512) -> DataFrame:
    """Count, median and largest number of messages; with a token column also its median, 99th percentile, largest sum and sessions over budget."""
    sums = [F.sum(tokens).alias("t")] if tokens else []
    per = df.groupBy("sid").agg(F.count("*").alias("m"), *sums)
    whole = lambda c, p: F.floor(F.percentile(c, p)).cast("long")
    more = [whole("t", 0.5).alias("median_tokens"), whole("t", 0.99).alias("p99_tokens"), F.max("t").alias("max_tokens"), F.count_if(F.col("t") > budget).alias("n_over")] if tokens else []
    return per.agg(F.count("*").alias("n_sessions"), whole("m", 0.5).alias("median_messages"), F.max("m").alias("max_messages"), *more)
