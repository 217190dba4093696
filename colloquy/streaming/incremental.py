"""Jobs that run again on what is new: finished parts are skipped, caches are appended to."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import add

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from colloquy.operators.joins import distinct_texts, join_texts
from colloquy.sources import tables as S
from colloquy.sources.scratch import stored

TASK_ROWS = 20_000  # encoded and sorted by one task
TASK_BYTES = 16 << 20  # of their text


def encode_unfinished(spark: SparkSession, texts: DataFrame, path: str, encode: Callable[[DataFrame], DataFrame], overwrite: bool = False) -> int:
    """Encodes and writes the (model, tag) parts of texts that the table at path lacks, all of them with overwrite; says how many rows that were."""
    try:
        finished = stored(S.read_vectors(spark, path).select("model", "tag").distinct(), "finished")
    except Exception as e:  # no table yet
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
        finished = None
    todo = texts if overwrite or finished is None else S.unfinished(texts, finished, ["model", "tag"])
    strings = [F.octet_length(F.coalesce(F.col(c), F.lit(""))).cast("long") for c, kind in todo.dtypes if kind == "string"]
    n, size = todo.agg(F.count("*"), F.sum(reduce(add, strings))).first()
    if n:
        # A (model, tag) may be most of the table: rows are dealt by ranges, so a task has a bounded part of one, or several small ones.
        parts = max(spark.sparkContext.defaultParallelism, -(-n // TASK_ROWS), -(-(size or 0) // TASK_BYTES))
        S.write_vectors(encode(todo.repartitionByRange(parts, "model", "tag", F.xxhash64(*todo.columns))), path, overwrite)
    return n


def translate_arrivals(bodies: DataFrame, cache_path: str, checkpoint: str, translate: Callable[[DataFrame], DataFrame]) -> StreamingQuery:
    """A stream of bodies: each batch's distinct ones that the cache lacks are translated and added to it: to the log at cache_path, and to
    the table by key beside it, of which a batch reads only the buckets of its bodies. A batch that runs again after a
    failure finds its bodies in the table, or writes them to the log once more, with the same meaning."""
    table = f"{cache_path.rstrip('/')}-by-key"

    def per_batch(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        asked = stored(distinct_texts(batch.selectExpr("body as en").filter("en is not null"), "en"), "asked")
        new = stored(join_texts(asked, "en", S.cached_of(asked, table).select(F.col("en").alias("known")), "known", "left_anti"), "new")
        if not new.isEmpty():
            rows = stored(translate(new).selectExpr(f"cast({number} as long) as seq", "en", "ko"), "translated")
            S.append_cache(rows, cache_path)
            S.add_to_cache(rows, table)
            S.compact_cache(spark, table)

    spark = bodies.sparkSession
    if not S.has_cache(spark, table) and S.exists(spark, cache_path):
        S.add_to_cache(S.read_cache(spark, cache_path), table)  # a log from before there was a table

    return bodies.writeStream.foreachBatch(per_batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
