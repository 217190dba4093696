"""Tables that a job writes and reads again on its way, in the folder that all executors share. Lineage ends there."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}
_folder: ContextVar[str | None] = ContextVar("folder", default=None)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Where it is unset, a local session gets a folder of this process; a cluster must name one."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if "dir" not in _own:
        _own["dir"] = tempfile.mkdtemp(prefix="colloquy-")
        atexit.register(shutil.rmtree, _own["dir"], ignore_errors=True)
    return _own["dir"]


def tables_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/colloquy-{spark.sparkContext.applicationId}"


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{_folder.get() or tables_dir(spark)}/{name}-{uuid.uuid4().hex}"


def remove_path(spark: SparkSession, path: str) -> None:
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    there.getFileSystem(spark._jsc.hadoopConfiguration()).delete(there, True)


def remove_tables(spark: SparkSession) -> None:
    """Delete all tables that this application has written to the shared folder. For callers that have saved their results."""
    remove_path(spark, tables_dir(spark))


@contextmanager
def within(spark: SparkSession) -> Iterator[None]:
    """What this thread writes here meanwhile goes to a folder of its own, which is removed at the end."""
    path = fresh_path(spark, "within")
    token = _folder.set(path)
    try:
        yield
    finally:
        _folder.reset(token)
        remove_path(spark, path)


#: Of tables whose rows are large: their size is looked at after each few rows, and readers, which take a row group at once, get small ones.
LARGE_ROWS = {"parquet.block.size": 16 << 20, "parquet.page.size.row.check.min": 1, "parquet.page.size.row.check.max": 8}


def stored(df: DataFrame, name: str, large_rows: bool = False) -> DataFrame:
    """The same rows, read back from a table of their own: what stands before it runs once."""
    path = fresh_path(df.sparkSession, name)
    df.write.options(**(LARGE_ROWS if large_rows else {})).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
