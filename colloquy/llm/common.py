"""What the operators of this subpackage share: reading, lineage cuts, joins that stand skew."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import wraps

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.sources.scratch import fresh_path

#: White space that separates words: blank, tab, line feed, vertical tab, form feed, carriage return.
BLANK_RUN = r"[\x20\x09-\x0D]+"

#: Bytes of rows that go to a Python worker at once while a table is written.
ARROW_BYTES = 4 << 20


@contextmanager
def arrow_batches(spark: SparkSession) -> Iterator[None]:
    """Batches of ARROW_BYTES at most, since an executor holds several of them for each core; then what the session had."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key, None)
    spark.conf.set(key, str(ARROW_BYTES))
    try:
        yield
    finally:
        spark.conf.set(key, before) if before is not None else spark.conf.unset(key)


def give_back() -> None:
    """What this process has freed goes back to the system, where its C library can do so."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def frugal(task: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The same function of a task's batches. Workers live on from stage to stage, so at the end it gives back what it has freed."""

    @wraps(task)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from task(batches)
        finally:
            give_back()

    return run


#: Rows of a file when a small table is written that a loop made.
FILE_ROWS = 250_000


def written(df: DataFrame, name: str, rows: int | None = None, path: str | None = None) -> DataFrame:
    """The same rows, read back from a table in the shared folder: lineage ends there. rows: about how many, if known; few go to few files.
    path: of a table that isn't there yet, else a fresh one."""
    path = path or fresh_path(df.sparkSession, name)
    if rows is not None:
        df = df.coalesce(-(-rows // FILE_ROWS) + 1)
    with arrow_batches(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def text_of(column: str = "text") -> Column:
    """The whole text; null counts as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def salted_left_join(big: DataFrame, small: DataFrame, key: str, by: Column, salts: int = 16) -> DataFrame:
    """Left join on one key that may be hot: big's rows of a key are dealt over `salts` tasks by `by`, small's are copied to each."""
    s = "__salt"
    spread = big.withColumn(s, F.pmod(F.xxhash64(by), F.lit(salts)))
    copies = small.withColumn(s, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    return spread.join(copies, [key, s], "left").drop(s)

