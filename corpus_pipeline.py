"""From documents to packed training sequences: five stages, each on what the one before kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
one's docs. All but the last return the columns of documents. The dedup stages and the mix treat every row on its own:
rows without doc_id or that share one get numbers of their own for the stage (`own_ids`). SQL can't express the trained classifier, so there is
no ORACLE_SQL; tests compare the stages with their operators and with brute force.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.llm import exact_dedup, mixing, near_dedup, packing, quality_model
from colloquy.llm.common import read_table, written
from colloquy.operators.joins import sized_join
from colloquy.sources import scratch


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts, learned from docs and the labels."""
    return quality_model.accepted(docs, quality_model.train(docs, read_table(spark, sf_dir, "labels")))


ID = "__doc_id"  # the doc_id as it came, while doc_id tells rows apart


def own_ids(docs: DataFrame) -> DataFrame:
    """docs with a doc_id of its own for each row, and the given one in ID. Where they are given so already, they stay."""
    given = F.col("doc_id").cast("long")
    counts = docs.groupBy(given.alias("doc_id")).agg(F.count("*").alias("n"))
    shared = written(counts.filter("n > 1 or doc_id is null").drop("n"), "shared-ids")
    rows = docs.withColumn(ID, F.col("doc_id")).withColumn("doc_id", given)
    if shared.isEmpty():
        return rows
    low, high = docs.agg(F.min(given), F.max(given)).first()
    free = F.monotonically_increasing_id()
    if low is None or high < 1 << 62:
        new = F.lit((-1 if high is None else high) + 1) + free
    elif low > -(1 << 62):
        new = F.lit(low - 1) - free
    else:
        raise ValueError("doc_id takes up the whole range of long: no numbers are free for rows that share one")
    several = shared.filter("doc_id is not null").withColumn("__shared", F.lit(True))
    rows = sized_join(rows.filter("doc_id is not null"), several, ["doc_id"], "left").unionByName(rows.filter("doc_id is null").withColumn("__shared", F.lit(True)))
    rows = rows.withColumn("doc_id", F.when(F.col("__shared"), new).otherwise(F.col("doc_id"))).drop("__shared")
    return written(rows, "own-ids")  # the numbers hold from here on


def _as_given(rows: DataFrame, columns: list[str]) -> DataFrame:
    return rows.drop("doc_id").withColumnRenamed(ID, "doc_id").select(columns)


def _one_of_each(docs: DataFrame, groups: Callable[[DataFrame], DataFrame], largest: bool) -> DataFrame:
    """One row of each group. groups: doc_id, group of every row. The largest or the least doc_id stays, one that is null only if there is no other."""
    rows = own_ids(docs)
    given = rows.select("doc_id", F.col(ID).cast("long").alias("given"))
    marked = written(groups(rows).select("doc_id", "group"), "groups").join(given, "doc_id")
    best = F.max(F.struct(F.col("given").isNotNull(), "given", "doc_id")) if largest else F.min(F.struct(F.col("given").isNull(), "given", "doc_id"))
    kept = written(marked.groupBy("group").agg(best.alias("best")).select("best.doc_id"), "ids")
    return _as_given(sized_join(rows, kept, ["doc_id"], "left_semi"), docs.columns)


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return _one_of_each(docs, lambda rows: exact_dedup.exact_dedup(rows).withColumnRenamed("keep_id", "group"), largest=True)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that shares four fifths of its five-word shingles."""
    return _one_of_each(docs, lambda rows: near_dedup.near_dedup(rows).withColumnRenamed("component_id", "group"), largest=False)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    rows = own_ids(docs)
    copies = written(mixing.mix(rows).filter("copies > 0").select("doc_id", F.col("copies").cast("int").alias("__copies")), "copies")
    rows = sized_join(rows, copies, ["doc_id"], "inner")
    return _as_given(rows.withColumn("__copies", F.explode(F.sequence(F.lit(1), F.col("__copies")))), docs.columns)


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The packed sequences: their ids, and for each piece in them its document, its place there and in the sequence."""
    import public_tokenizers

    return packing.sequences(docs, public_tokenizers.path("byte_bpe_50k.json"), cached=50_000)  # workers still hold what the stages before left


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_model", good_documents),
    ("exact_dedup", without_copies),
    ("near_dedup", without_near_copies),
    ("mixing", mixed_sources),
    ("packing", packed_sequences),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows, from a table in the shared folder. What the steps of a stage wrote goes when it is done, its rows when the next one is."""
    docs, before = read_table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = scratch.fresh_path(spark, f"stage-{name}")
        with scratch.within(spark):
            docs = written(stage(spark, docs, sf_dir), name, path=path)
        if before is not None:
            scratch.remove_path(spark, before)
        before = path
    return docs


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
