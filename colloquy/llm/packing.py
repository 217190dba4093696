"""Variable-capacity best-fit packing of documents into training sequences (operator 1).

Documents are measured in a tokenizer's ids, an end id included. Several sequence lengths are permitted, each at a
cost (its length and a fixed overhead). A document longer than the longest is cut into pieces. Rows are dealt into shards of about SHARD pieces by a hash; each shard is packed on its
own, in order of falling length: a piece goes to the open bin that it fills best; if none holds it, a bin is opened
of the size whose cost per token it would come to hold is least, judged by the lengths still to come. At the end
each bin is downsized to the least permitted length that holds its contents. A shard is bounded, so are memory and
time of a task; the space lost to sharding is about one bin a shard.

`sequences` gives the packed ids themselves.

Defined cases: null and empty texts have no ids and no piece (a row with a null bin says so); repeated rows are
packed each; equal lengths go by doc_id; a null doc_id is packed as any; an empty table gives no rows; extra columns
are not read.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.operators.joins import sized_join

from .common import read_table, written
from .token_shards import CACHED_WORDS, encoded

LENGTHS = (512, 1024, 2048, 4096)
OVERHEAD = 16  # cost of a sequence besides its length, in tokens
SHARD = 20_000  # pieces packed together
END_ID = 2  # follows each document


def open_size(length: int, later: list[int], lengths: tuple[int, ...], overhead: int) -> int:
    """The permitted length with the least cost per token for a bin that begins with `length`: it is filled up in thought
    with the longest pieces still to come (`later`: their lengths, rising) that fit one after another."""
    best = None
    for size in lengths:
        if size < length:
            continue
        room, end = size - length, len(later)
        while room and end:
            end = bisect_left(later, room + 1, 0, end)
            if end:
                end -= 1
                room -= later[end]
        cost = (size + overhead) / (size - room)
        if best is None or cost < best[0] - 1e-12:
            best = (cost, size)
    return best[1]


def pack(sizes: list[int], lengths: tuple[int, ...] = LENGTHS, overhead: int = OVERHEAD) -> tuple[list[int], list[int], list[int]]:
    """Bin and offset of each piece (sizes fall), and each bin's length after downsizing."""
    rooms: list[tuple[int, int]] = []  # room left and bin, rising
    later = sizes[::-1]
    bins, offsets, filled = [], [], []
    capacity: list[int] = []
    for k, n in enumerate(sizes):
        del later[len(sizes) - 1 - k :]
        at = bisect_left(rooms, (n, -1))
        if at < len(rooms):
            room, b = rooms.pop(at)
        else:
            b = len(capacity)
            capacity.append(open_size(n, later, lengths, overhead))
            filled.append(0)
            room = capacity[b]
        bins.append(b)
        offsets.append(filled[b])
        filled[b] += n
        if room > n:
            insort(rooms, (room - n, b))
    return bins, offsets, [lengths[bisect_left(lengths, f)] for f in filled]


def placed(rows: DataFrame, lengths: tuple[int, ...] = LENGTHS, overhead: int = OVERHEAD, shard: int = SHARD) -> DataFrame:
    """row, doc_id, part, start (of the part in its document), n_tokens, shard, bin, bin_offset, bin_length of rows (row, doc_id, size; a written table)."""
    longest = lengths[-1]
    shards = max(1, -(-(rows.agg(F.sum(F.greatest(F.lit(1), F.ceil(F.col("size") / longest))).alias("n")).first()["n"] or 0) // shard))
    parts = F.posexplode(F.when(F.col("size") > 0, F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(longest).cast("long"))).otherwise(F.array().cast("array<long>")))
    cut = rows.filter("size > 0").select("row", "doc_id", "size", parts.alias("part", "start")).withColumn("n_tokens", F.least(F.lit(longest).cast("long"), F.col("size") - F.col("start")))
    dealt = cut.withColumn("shard", F.pmod(F.xxhash64("row", "part"), F.lit(shards)).cast("int")).drop("size")

    def per_shard(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["n_tokens", "doc_id", "part", "row"], ascending=[False, True, True, True], na_position="first", ignore_index=True)
        bins, offsets, sizes = pack(pdf.n_tokens.tolist(), lengths, overhead)
        return pdf.assign(bin=bins, bin_offset=offsets, bin_length=[sizes[b] for b in bins])

    packed = dealt.groupBy("shard").applyInPandas(per_shard, "row long, doc_id long, part int, start long, n_tokens long, shard int, bin int, bin_offset int, bin_length int")
    empty = rows.filter("size = 0").select("row", "doc_id", F.lit(0).alias("part"), F.lit(0).cast("long").alias("start"), F.lit(0).cast("long").alias("n_tokens"), *[F.lit(None).cast("int").alias(c) for c in ("shard", "bin", "bin_offset", "bin_length")])
    return packed.union(empty)


def best_fit(docs: DataFrame, tokenizer: str, end_id: int | None = END_ID, cached: int = CACHED_WORDS, **how) -> DataFrame:
    """doc_id, part, start, n_tokens, shard, bin, bin_offset, bin_length: where each piece of each document lies. tokenizer: path of its file."""
    return placed(written(encoded(docs, tokenizer, end_id, cached=cached), "sizes"), **how).drop("row")


def sequences(docs: DataFrame, tokenizer: str, end_id: int | None = END_ID, cached: int = CACHED_WORDS, **how) -> DataFrame:
    """shard, bin, bin_length, n_tokens, ids (little-endian, as `encoded` gives them), pieces (bin_offset, doc_id, part, start, n_tokens) of every packed sequence."""
    rows = written(encoded(docs, tokenizer, end_id, keep_ids=True, cached=cached), "encoded")
    pieces = written(placed(rows.select("row", "doc_id", "size"), **how).filter("bin is not null"), "pieces")  # slim: ids move only to their bins
    wide = F.octet_length("ids") / F.col("size")
    piece = F.struct("bin_offset", "doc_id", "part", "start", "n_tokens", F.substring("ids", (F.col("start") * wide + 1).cast("int"), (F.col("n_tokens") * wide).cast("int")).alias("ids"))
    bins = sized_join(rows.select("row", "size", "ids"), pieces, ["row"], "inner").groupBy("shard", "bin", "bin_length").agg(F.array_sort(F.collect_list(piece)).alias("pieces"))
    ids = F.aggregate("pieces", F.lit(b""), lambda got, x: F.concat(got, x.ids))
    total = F.aggregate("pieces", F.lit(0).cast("long"), lambda got, x: got + x.n_tokens)
    return bins.select("shard", "bin", "bin_length", total.alias("n_tokens"), ids.alias("ids"), F.transform("pieces", lambda x: x.dropFields("ids")).alias("pieces"))


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return best_fit(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
