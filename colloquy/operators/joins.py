"""Joins that send one side to all tasks only if its counted size allows it."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A side of at most this many rows and bytes may be broadcast; beyond it the join shuffles.
BROADCAST_ROWS = 1_000_000
BROADCAST_BYTES = 32 << 20


def text_key(text: Column) -> Column:
    """192 bits and the length of a text: what stands for it where rows are dealt and sorted, however long it is."""
    return F.struct(F.unhex(F.md5(text.cast("binary"))).alias("a"), F.xxhash64(text).alias("b"), F.length(text).alias("n"))


def join_texts(left: DataFrame, a: str, right: DataFrame, b: str, how: str) -> DataFrame:
    """left joined to right where column a of left is column b of right, by the key of the texts, and the texts themselves compared."""
    x, y = left.withColumn("__a", text_key(F.col(a))).alias("__l"), right.withColumn("__b", text_key(F.col(b))).alias("__r")
    # Of one length and key, one begins with the other if they are equal; an equality here would become a key.
    same = (F.col("__a") == F.col("__b")) & F.col(f"__l.{a}").startswith(F.col(f"__r.{b}"))
    return x.join(y, same, how).drop("__a", "__b")


def distinct_texts(df: DataFrame, text: str) -> DataFrame:
    """The distinct texts of a column, dealt and grouped by their keys."""
    return df.groupBy(text_key(F.col(text)).alias("key")).agg(F.collect_set(text).alias("texts")).select(F.explode("texts").alias(text))


def row_bytes(df: DataFrame) -> Column:
    """About how many bytes a row takes."""
    width = [F.lit(8 * len(df.columns)).cast("long")]
    for f in df.schema.fields:
        if isinstance(f.dataType, T.ArrayType):
            width.append(F.size(F.coalesce(F.col(f.name), F.array())).cast("long") * 8)
        elif isinstance(f.dataType, (T.StringType, T.BinaryType)):
            width.append(F.octet_length(F.coalesce(F.col(f.name), F.lit("").cast(f.dataType))).cast("long"))
    return reduce(add, width)


def few(df: DataFrame, limit: int = BROADCAST_ROWS) -> bool:
    """Whether a written table may be sent to all tasks, by its counted rows and bytes."""
    rows, size = df.agg(F.count("*"), F.sum(row_bytes(df))).first()
    return rows <= limit and (size or 0) <= BROADCAST_BYTES


def sized_join(big: DataFrame, small: DataFrame, on: list[str], how: str, limit: int = BROADCAST_ROWS) -> DataFrame:
    """big joined to a written table: broadcast when its counted rows and bytes are few, else a shuffled join that AQE may split."""
    return big.join(F.broadcast(small) if few(small, limit) else small.hint("merge"), on, how)
