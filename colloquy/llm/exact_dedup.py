"""Exact dedup by content-defined chunk recipes (operator 10).

Each text is cut where a rolling hash of its last bytes hits a mask, so a text's cuts depend on its content
alone. A document becomes its recipe, the ordered list of its chunks' identifiers; long texts do not move.
Only chunks of documents whose recipe occurs again are compared byte by byte (a group-by on identifier and bytes,
combined before the shuffle): an identifier that two different chunks share gets a rank for each, which the
recipes then carry. Equal recipes of verified identifiers are equal texts.

Defined cases: null text counts as empty, and empty texts are equal to each other; a null doc_id never wins
against a number and a group with none but nulls has a null keep_id; rows that repeat doc_id and text count in
group_size and are all kept if theirs is the largest doc_id; an empty table gives no rows; extra columns are
not read, so their names cannot clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from colloquy.operators.joins import sized_join

from .common import frugal, read_table, salted_left_join, text_of, written
from .words import in_slices

GEAR = 16  # bytes that decide about a cut
MEAN = 1024  # bytes between cuts, as a power of two
LONGEST = 16 * MEAN  # where nothing cuts, as in runs of one byte
ODD = np.uint64(0x9E3779B97F4A7C15)  # an odd multiplier
NO_DOC = -(2**63)  # stands for a null doc_id where texts are looked up


def cut_points(data: np.ndarray, mean: int = MEAN) -> np.ndarray:
    """Ends of the chunks of a text's bytes, the last one included."""
    n = len(data)
    if n <= GEAR:
        return np.array([n] if n else [], dtype=np.int64)
    h, step = data.astype(np.uint64) + np.uint64(1), 1
    while step < GEAR:
        h = h[:-step] * ODD + h[step:]
        step *= 2
    h *= ODD
    ends = np.flatnonzero((h >> np.uint64(40)) % np.uint64(mean) == 0) + GEAR
    ends = np.unique(np.append(ends, n))
    begins = np.append(0, ends[:-1])
    if (ends - begins).max() > LONGEST:
        ends = np.unique(np.concatenate([np.append(np.arange(b + LONGEST, e, LONGEST), e) for b, e in zip(begins, ends, strict=True)]))
    return ends


def chunks(data: bytes, mean: int = MEAN) -> list[bytes]:
    ends, begin, out = cut_points(np.frombuffer(data, dtype=np.uint8), mean).tolist(), 0, []
    for end in ends:
        out.append(data[begin:end])
        begin = end
    return out


def recipes(docs: DataFrame, mean: int = MEAN, id_bytes: int = 16) -> DataFrame:
    """doc_id, recipe (its chunks' identifiers one after another), text_sha256."""

    @frugal
    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, texts in in_slices(b.column(1)):
                lists = [b"".join(xxhash.xxh3_128_digest(c)[:id_bytes] for c in chunks(t, mean)) for t in texts]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(first, len(texts)), pa.array(lists, pa.binary()), pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string())], ["doc_id", "recipe", "text_sha256"])

    return docs.select(F.col("doc_id").cast("long"), text_of().alias("text")).mapInArrow(per_batch, "doc_id long, recipe binary, text_sha256 string")


def chunk_rows(docs: DataFrame, mean: int, id_bytes: int) -> DataFrame:
    """key (the recipe before ranks), pos, id and bytes of every chunk."""

    @frugal
    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, texts in in_slices(b.column(1)):
                rows: list[tuple] = []
                for doc, text in zip(b.column(0).slice(first, len(texts)).to_pylist(), texts, strict=True):
                    rows += [(doc, k, xxhash.xxh3_128_digest(c)[:id_bytes], c) for k, c in enumerate(chunks(text, mean))]
                cols = list(zip(*rows, strict=True)) or [[], [], [], []]
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.binary()), pa.array(cols[3], pa.binary())], ["text_sha256", "pos", "id", "chunk"])

    return docs.select("text_sha256", "text").mapInArrow(per_batch, "text_sha256 string, pos int, id binary, chunk binary")


def exact_dedup(docs: DataFrame, mean: int = MEAN, id_bytes: int = 16) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256, n_chunks. id_bytes: of a chunk's identifier."""
    rec = written(recipes(docs, mean, id_bytes), "recipes")
    again = rec.groupBy("recipe").agg(F.count("*").alias("n")).filter("n > 1 and length(recipe) > 0").select("recipe")
    again = written(again, "again")
    # Verify: bytes under one identifier, of every text whose recipe occurs again.
    doc = F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_DOC)).alias("doc")
    wanted = written(sized_join(rec, again, ["recipe"], "left_semi").select(doc, "text_sha256").distinct(), "wanted")
    texts = sized_join(docs.select(doc, text_of().alias("text")), wanted, ["doc"], "inner").filter(F.sha2("text", 256) == F.col("text_sha256"))
    distinct = chunk_rows(texts, mean, id_bytes).groupBy("id", "chunk").agg(F.lit(1).alias("one"))
    shared = written(distinct.withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy("chunk")) - 1).filter("rank > 0").select("id", "chunk", "rank"), "ranks")
    if shared.isEmpty():
        key = rec.withColumn("ranks", F.lit(""))
    else:  # some identifier stands for more than one chunk: say which in the recipes
        ranks = chunk_rows(texts, mean, id_bytes).join(shared, ["id", "chunk"]).groupBy("text_sha256", "pos").agg(F.first("rank").alias("rank"))
        ranks = ranks.groupBy("text_sha256").agg(F.concat_ws(",", F.array_sort(F.collect_list(F.format_string("%09d:%d", "pos", "rank")))).alias("ranks"))
        key = rec.join(ranks, "text_sha256", "left").withColumn("ranks", F.coalesce("ranks", F.lit("")))
    key = key.withColumn("key", F.concat(F.col("recipe"), F.encode("ranks", "UTF-8"))).drop("ranks")
    groups = key.groupBy("key").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size")).filter("group_size > 1")
    out = salted_left_join(key, groups, "key", F.col("doc_id"))
    keep = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    return out.select("doc_id", keep.alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"), F.col("doc_id").eqNullSafe(keep).alias("kept"), "text_sha256", F.expr(f"cast(length(recipe) / {id_bytes} as int)").alias("n_chunks"))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(read_table(spark, sf_dir, "documents")).drop("n_chunks")


ORACLE_SQL = """
SELECT doc_id,
       max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
       count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
"""
