"""Mixing sources to target weights by entropy balancing (operator 6).

Rates r of documents are wanted that stay as near as possible (in entropy, with room between 0 and 2 copies) to one
copy each while every source's rates times sizes add up to its target. The dual of that problem is convex with one
unknown per source: r = 2 / (1 + exp(-tilt * size)), an exponential tilt by size within the copies allowed. Newton
steps find all tilts at once: each step is one aggregation of gradient and curvature over (source, size) cells,
combined before the shuffle; cells, not documents, are read again at each step. Rates then become copies: within a
source, cells in order of falling size round their copies up or down and hand the words left over to the next cell,
so the error left at the end is below the smallest size that still had room. A cell's copies go to its documents in
order of a hash; ranks are counted over salted parts of a cell, so a cell that holds a third of all rows is spread.

Targets: sources in order of code points, null last, weigh 5, 2, 1, 5, 2, 1, ... and share `share` times all words;
none gets above 2 times its own, the excess goes to the others by weight.

Defined cases: null or empty text has size 0 and is taken 0 words (its copies are one); null source is a source of
its own; repeated rows are documents of their own; an empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from colloquy.operators.joins import sized_join

from .common import BLANK_RUN, read_table, text_of, written

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2  # copies of a document
STEPS = 40  # Newton steps at most; about ten are usual
NEAR = 1e-9  # of a target: where Newton stops
STEEPEST = 60.0  # of tilt times the source's mean size
SALTS = 32


def word_count() -> Column:
    return F.size(F.array_remove(F.split(text_of(), BLANK_RUN), "")).cast("long")


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source (in a struct, so that null is a value), size, salt: written, since it is read again."""
    rows = docs.select(F.col("doc_id").cast("long"), F.struct(F.col("source").alias("name")).alias("source"), word_count().alias("size"))
    return written(rows.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")), "sizes")


def targets(cells: DataFrame, weights=WEIGHTS, share: float = SHARE) -> DataFrame:
    """source, source_size, n, target. Sources share by weight up to MOST times their size: the level of the shares is found
    where the sources that stop, in order of the level they stop at, leave just the rest of the words."""
    per = cells.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.sum("n").alias("n"))
    number = F.row_number().over(Window.orderBy(F.col("source.name").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (number % len(weights) + 1).cast("int"))
    rows = per.withColumn("weight", weight).withColumn("top", (MOST * F.col("source_size")).cast("double"))
    by = Window.orderBy(F.col("top") / F.col("weight"), F.col("source.name").asc_nulls_last())
    every = Window.partitionBy()
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("full", F.coalesce(F.sum("top").over(before), F.lit(0.0))).withColumn("open", F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    rows = rows.withColumn("level", (share * F.sum("source_size").over(every) - F.col("full")) / F.col("open"))
    # The first source in this order that its level would not fill sets the level for itself and all after it.
    level = F.min(F.when(F.col("level") * F.col("weight") <= F.col("top"), F.struct(F.col("top") / F.col("weight"), F.col("level").alias("level")))).over(every)["level"]
    return rows.select("source", "source_size", "n", F.coalesce(F.least(F.col("top"), level * F.col("weight")), F.col("top")).alias("target"))


def tilts(cells: DataFrame, goals: DataFrame) -> DataFrame:
    """source, tilt: Newton's solution of the dual. A tilt is of size over the source's mean size; null: all documents take MOST copies."""
    mean = F.greatest(F.col("source_size") / F.col("n"), F.lit(1e-9))
    state = written(goals.select("source", "target", mean.alias("mean"), F.lit(0.0).alias("tilt"), (F.col("target") >= MOST * F.col("source_size")).alias("done")), "tilts")
    for _ in range(STEPS):
        if state.filter("not done").isEmpty():
            break
        x = F.col("size") / F.col("mean")
        r = MOST / (1 + F.exp(-F.col("tilt") * x))
        sums = sized_join(cells, state.filter("not done"), ["source"], "inner").groupBy("source").agg(F.sum(r * x * F.col("n")).alias("got"), F.sum(r * (1 - r / MOST) * x * x * F.col("n")).alias("bend"))
        new = state.join(sums, "source", "left")
        miss = F.col("target") / F.col("mean") - F.col("got")
        step = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), miss / F.greatest(F.col("bend"), F.lit(1e-12))))  # damped: the dual is convex
        tilt = F.greatest(F.lit(-STEEPEST), F.least(F.lit(STEEPEST), F.col("tilt") + step))
        near = (F.abs(miss) <= NEAR * F.col("target") / F.col("mean")) | (tilt == F.col("tilt"))
        state = written(new.select("source", "target", "mean", F.when(F.col("done") | near, F.col("tilt")).otherwise(F.round(tilt, 12)).alias("tilt"), (F.col("done") | F.coalesce(near, F.lit(True))).alias("done")), "tilts")
    return state


def cell_copies(cells: DataFrame, solved: DataFrame, goals: DataFrame) -> DataFrame:
    """source, size, copies: of all documents of a cell together. Words left over pass from cell to cell, one source after another."""
    full = F.col("target") >= MOST * F.col("source_size")
    rate = F.when(full, F.lit(float(MOST))).otherwise(MOST / (1 + F.exp(-F.col("tilt") * F.col("size") / F.col("mean"))))
    rows = sized_join(cells, written(solved.select("source", "tilt", "mean").join(goals.select("source", "target", "source_size"), "source"), "solved"), ["source"], "inner")
    rows = rows.select("source", "size", "n", F.round(rate, 9).alias("rate"))

    def carry(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        source, left = None, 0.0
        for b in batches:
            out = []
            for row in b.itertuples(index=False):
                name = (row.source["name"],)
                if name != source:
                    source, left = name, 0.0
                if row.size == 0:
                    out.append(row.n)
                    continue
                want = row.n * row.rate * row.size + left
                copies = min(MOST * row.n, max(0, int(want / row.size + 0.5)))
                left = want - copies * row.size
                out.append(copies)
            yield b.drop(columns="rate").assign(copies=out)

    return rows.repartition("source").sortWithinPartitions("source", F.desc("size")).mapInPandas(carry, "source struct<name:string>, size long, n long, copies long")


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE) -> DataFrame:
    """doc_id, source (in a struct), size, source_size, target, copies of every document."""
    rows = sized(docs)
    parts = written(rows.groupBy("source", "size", "salt").agg(F.count("*").alias("n")), "cells")
    cells = written(parts.groupBy("source", "size").agg(F.sum("n").alias("n")), "cells")
    goals = written(targets(cells, weights, share), "targets")
    whole = written(cell_copies(cells, tilts(cells, goals), goals).drop("n"), "copies")
    # Copies go to a cell's documents in turn: whole rounds for all, the rest to the first by salt, then by hash.
    cell = Window.partitionBy("source", "size").orderBy("salt")
    plan = parts.withColumn("before", F.sum("n").over(cell) - F.col("n")).withColumn("all", F.sum("n").over(Window.partitionBy("source", "size")))
    plan = plan.join(whole, ["source", "size"]).select("source", "size", "salt", F.floor(F.col("copies") / F.col("all")).alias("rounds"), (F.col("copies") % F.col("all") - F.col("before")).alias("rest"))
    rank = F.row_number().over(Window.partitionBy("source", "size", "salt").orderBy(F.xxhash64("doc_id", F.lit(7)), "doc_id"))
    out = rows.withColumn("rank", rank).join(plan, ["source", "size", "salt"])
    out = out.withColumn("copies", F.col("rounds") + F.when(F.col("rank") <= F.col("rest"), 1).otherwise(0))
    return sized_join(out, goals.select("source", "source_size", "target"), ["source"], "inner").select("doc_id", "source", "size", "source_size", "target", "copies")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mix(read_table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("long").alias("taken"), "copies")
