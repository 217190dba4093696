"""Chunks: sessions cut at utterances into overlapping pieces of bounded size, with the same cuts in each language."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colloquy.functions import text as T
from colloquy.sources.scratch import stored

from . import scan

HEADER_TOKENS = 32
PARTS = 4  # tasks for each core that long sessions are dealt over
Counter = Callable[[Column], Column]
Cutter = Callable[[Column, Column, Column], Column]


def plan_spans(tokens: np.ndarray, budget: int, overlap: int) -> list[tuple[int, int]]:
    """Half-open spans over the sums of token counts: each takes what the budget holds (one item at least), the next begins where
    the overlap is reached, counted back from the end, and at least one item on."""
    sums = np.concatenate([[0], np.cumsum(tokens)])
    spans, start, n = [], 0, len(tokens)
    while start < n:
        end = max(start + 1, int(np.searchsorted(sums, sums[start] + budget, side="right")) - 1)
        spans.append((start, end))
        if end == n:
            break
        start = max(start + 1, min(end, int(np.searchsorted(sums, sums[end] - overlap, side="right")) - 1))
    return spans


def planned(items: DataFrame, key: str, pos: str, tokens: str, budget: int, overlap: int) -> DataFrame:
    """key, part, n_parts, first, last (positions): sessions that the budget holds are one span by an aggregation; only longer ones go to Python."""
    sums = items.groupBy(key).agg(F.sum(tokens).alias("t"), F.min(pos).alias("first"), F.max(pos).alias("last"))
    one = sums.filter((F.col("t") <= budget) | (F.col("first") == F.col("last"))).select(key, F.lit(1).alias("part"), F.lit(1).alias("n_parts"), F.col("first").cast("long"), F.col("last").cast("long"))
    long_ = items.join(sums.filter((F.col("t") > budget) & (F.col("first") < F.col("last"))).select(key), key, "left_semi").select(key, F.col(pos).cast("long").alias("pos"), F.col(tokens).cast("long").alias("tokens"))

    def per_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []  # the session that rows so far have ended in

        def spans_of(session: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, ...]:
            pos, sizes = (np.concatenate(x) for x in zip(*session, strict=True))
            first, end = np.array(plan_spans(sizes, budget, overlap), dtype=np.int64).T
            return np.arange(1, len(first) + 1), np.full(len(first), len(first)), pos[first], pos[end - 1]

        def rows(done: list[tuple]) -> pa.RecordBatch:
            names = pa.array(np.repeat(np.arange(len(done)), [len(x[1][0]) for x in done]))
            columns = [np.concatenate(c) for c in zip(*(x[1] for x in done), strict=True)]
            return pa.RecordBatch.from_arrays([pa.concat_arrays([x[0] for x in done]).take(names), *(pa.array(c.astype(kind)) for c, kind in zip(columns, (np.int32, np.int32, np.int64, np.int64), strict=True))], [key, "part", "n_parts", "first", "last"])

        for b in batches:
            keys, done = b.column(0), []
            pos, sizes = (b.column(i).fill_null(0).to_numpy(zero_copy_only=False) for i in (1, 2))
            code = keys.dictionary_encode().indices.to_numpy(zero_copy_only=False)
            edges = [0, *(np.flatnonzero(np.diff(code)) + 1).tolist(), len(code)] if len(code) else []
            for i, j in zip(edges, edges[1:], strict=False):
                if held and keys[i] != at[0]:
                    done.append((at, spans_of(held)))
                    held = []
                at = keys.slice(i, 1)
                held.append((pos[i:j], sizes[i:j]))
            if done:
                yield rows(done)
        if held:
            yield rows([(at, spans_of(held))])

    kind = dict(items.dtypes)[key]
    # By a fixed number: what is few bytes here, and would be put together for that, is much work. Sessions follow one another in a task, without a call for each.
    parts = PARTS * items.sparkSession.sparkContext.defaultParallelism
    return one.unionByName(long_.repartition(parts, key).sortWithinPartitions(key, "pos").mapInArrow(per_task, f"{key} {kind}, part int, n_parts int, first long, last long"))


def pieces(prefix: Column, body: Column, k: Column) -> Column:
    """A body in k pieces of equal numbers of words, each behind the prefix; an empty piece shows an ellipsis."""
    words = F.array_remove(F.split(body, T.WHITE), "")
    step = F.ceil(F.size(words) / k).cast("int")
    cut = F.transform(F.sequence(F.lit(0), k - 1), lambda i: F.concat(prefix, F.coalesce(F.nullif(F.array_join(F.when(i * step < F.size(words), F.slice(words, i * step + 1, step)).otherwise(F.array().cast("array<string>")), " "), F.lit("")), F.lit("…"))))
    return F.when((k <= 1) | (F.size(words) == 0), F.array(F.concat(prefix, body))).otherwise(cut)


def conversation_chunks(sess: DataFrame, fields: dict[str, str], size: int = 512, overlap: int = 128, basis: str = "en", count: Counter = T.word_count, cut_up: Cutter | None = None) -> DataFrame:
    """corpus, chunk_index, session_id, kind, participants, ts_start, ts_end, n_messages, part, n_parts, n_tokens, src_rows, text.
    sess: sid, dyad, ts, src_row, nick_from and a body column for each corpus in fields. basis: the corpus whose counts cut all, 'max' or 'each'.
    count, cut_up: a text's tokens, and its pieces of equal numbers of them; words unless others are given."""
    cut_up = cut_up or pieces
    if overlap >= size:
        raise ValueError("the overlap must be below the chunk size")
    budget = size - HEADER_TOKENS
    prefix = T.utterance_prefix(F.col("ts"), F.col("nick_from"))
    rows = sess.select("sid", "dyad", "ts", "src_row", prefix.alias("prefix"), F.row_number().over(Window.partitionBy("sid").orderBy("ts", "src_row")).alias("no"), *[F.col(c).alias(f"b_{k}") for k, c in fields.items()])
    rows = rows.select("*", *[count(F.concat("prefix", f"b_{k}")).alias(f"t_{k}") for k in fields])
    largest = F.greatest(*[F.col(f"t_{k}") for k in fields]) if len(fields) > 1 else F.col(f"t_{next(iter(fields))}")
    by = {k: largest if basis == "max" else F.col(f"t_{k if basis == 'each' else basis}") for k in fields}
    cut = {k: cut_up(F.col("prefix"), F.col(f"b_{k}"), F.greatest(F.lit(1), F.ceil(by[k] / budget).cast("int"))) for k in fields}
    if basis == "each":
        lines = None
        for k in fields:
            one = rows.select("sid", "dyad", "ts", "src_row", "no", F.lit(k).alias("corpus"), F.posexplode(cut[k]).alias("piece", "line"))
            lines = one if lines is None else lines.unionByName(one)
        lines = lines.withColumn("tokens", count(F.col("line"))).withColumn("plan", F.col("tokens"))
    else:
        # Pieces of all languages side by side; a body without words in one language is one piece there.
        width = F.greatest(*[F.size(cut[k]) for k in fields]) if len(fields) > 1 else F.size(cut[next(iter(fields))])
        wide = rows.select("sid", "dyad", "ts", "src_row", "no", *[cut[k].alias(f"l_{k}") for k in fields], width.alias("width"))
        wide = wide.select("*", F.explode(F.sequence(F.lit(0), F.col("width") - 1)).alias("piece")).select("sid", "dyad", "ts", "src_row", "no", "piece", *[F.coalesce(F.get(f"l_{k}", F.col("piece")), F.lit("…")).alias(f"l_{k}") for k in fields])
        wide = wide.select("*", *[count(F.col(f"l_{k}")).alias(f"t_{k}") for k in fields])
        wide = wide.withColumn("plan", largest if basis == "max" else F.col(f"t_{basis}"))
        lines = wide.select("sid", "dyad", "ts", "src_row", "no", "piece", "plan", F.explode(F.array(*[F.struct(F.lit(k).alias("corpus"), F.col(f"l_{k}").alias("line"), F.col(f"t_{k}").alias("tokens")) for k in fields])).alias("x")).select("*", "x.*").drop("x")
    lines = lines.withColumn("pos", F.row_number().over(Window.partitionBy("corpus", "sid").orderBy("no", "piece"))).withColumn("plan_key", F.concat_ws("/", F.col("sid"), F.col("corpus")) if basis == "each" else F.col("sid").cast("string"))
    lines = stored(lines, "lines")  # cut once, for the plan and for the texts
    items = lines if basis == "each" else lines.filter(F.col("corpus") == next(iter(fields)))
    plan = planned(items.select("plan_key", "pos", "plan"), "plan_key", "pos", "plan", budget, overlap)
    member = lines.join(plan, "plan_key").filter(F.col("pos").between(F.col("first"), F.col("last")))
    line = F.struct("pos", "line")
    got = member.groupBy("corpus", "sid", "dyad", "part", "n_parts").agg(
        F.min("ts").alias("ts_start"), F.max("ts").alias("ts_end"), F.count_distinct("no").cast("int").alias("n_messages"), (F.sum("tokens") + HEADER_TOKENS).cast("int").alias("n_tokens"),
        F.array_sort(F.collect_list(line)).alias("lines"), F.array_sort(F.collect_set(F.struct("no", "src_row"))).alias("rows"),
    )
    # Dense numbers in a corpus: sessions are numbered by pair and time.
    got = scan.numbered(scan.in_order(got, ["corpus", "sid", "part"], "chunks"), "number")
    got = got.join(F.broadcast(got.groupBy("corpus").agg(F.min("number").alias("begin"))), "corpus")  # one row per corpus
    head = T.chunk_header(F.col("dyad"), F.col("ts_start"), F.col("ts_end"), F.col("part"), F.col("n_parts"))
    return got.select(
        "corpus", (F.col("number") - F.col("begin")).cast("int").alias("chunk_index"), F.col("sid").cast("long").alias("session_id"), F.lit("conversation").alias("kind"), F.split("dyad", r" \| ").alias("participants"),
        "ts_start", "ts_end", "n_messages", F.col("part").cast("int").alias("part"), F.col("n_parts").cast("int").alias("n_parts"), "n_tokens", F.col("rows.src_row").alias("src_rows"),
        F.concat_ws("\n", head, F.array_join("lines.line", "\n")).alias("text"),
    )


def broadcast_chunks(notices: DataFrame, fields: dict[str, str], count: Counter | None = T.word_count) -> DataFrame:
    """One chunk per notice and corpus, numbered 0, 1, ... in source order, sessions -1, -2, ..."""
    rows = scan.numbered(scan.in_order(notices, ["src_row"], "notices"), "no").withColumn("no", F.col("no") + 1).withColumn("who", F.filter("recipients", lambda x: x != ""))
    rows = rows.select("*", F.explode(F.array(*[F.struct(F.lit(k).alias("corpus"), F.col(c).alias("b")) for k, c in fields.items()])).alias("x"))
    text = F.concat(T.notice_header(F.col("nick_from"), F.col("who"), F.col("ts")), F.lit("\n수신: "), F.array_join("who", ", "), F.lit("\n"), F.col("nick_from"), F.lit(": "), F.col("x.b"))
    rows = rows.withColumn("text", text)
    return rows.select(
        "x.corpus", (F.col("no") - 1).cast("int").alias("chunk_index"), (-F.col("no")).cast("long").alias("session_id"), F.lit("broadcast").alias("kind"), F.array("nick_from").alias("participants"), F.col("who").alias("recipients"),
        F.col("ts").alias("ts_start"), F.col("ts").alias("ts_end"), F.size("merged_rows").alias("n_messages"), F.lit(1).alias("part"), F.lit(1).alias("n_parts"),
        (count(F.col("text")) if count else F.lit(None)).cast("int").alias("n_tokens"), F.col("merged_rows").alias("src_rows"), "text",
    )


def all_chunks(conv: DataFrame, notices: DataFrame) -> DataFrame:
    """Conversation chunks, then notices numbered after them."""
    ends = conv.groupBy("corpus").agg(F.count("*").cast("int").alias("n"))
    moved = notices.join(F.broadcast(ends), "corpus", "left").withColumn("chunk_index", F.col("chunk_index") + F.coalesce("n", F.lit(0))).drop("n")  # one row per corpus
    return conv.unionByName(moved, allowMissingColumns=True)


def chunk_report(chunks: DataFrame, size: int = 512) -> DataFrame:
    """Per corpus: chunks by kind; tokens of conversation chunks only."""
    conv = F.col("kind") == "conversation"
    of = F.when(conv, F.col("n_tokens"))
    return chunks.groupBy("corpus").agg(F.count("*").alias("n_chunks"), F.count_if(conv).alias("n_conversation"), F.count_if(~conv).alias("n_broadcast"), F.floor(F.percentile(of, 0.5)).cast("long").alias("median_tokens"), F.max(of).cast("long").alias("max_tokens"), F.count_if(of > size).alias("n_over"))


def uneven_corpora(chunks: DataFrame) -> DataFrame:
    """Corpora whose number of chunks differs from the most common: with shared cuts there are none."""
    n = chunks.groupBy("corpus").agg(F.count("*").alias("n"))
    return n.join(n.agg(F.max("n").alias("most")), F.col("n") < F.col("most")).select("corpus", "n", "most")


def sliding_windows(docs: DataFrame, tokens: Column, size: int = 512, overlap: int = 128, text: Counter = lambda part: F.array_join(part, " ")) -> DataFrame:
    """docs with chunk_index, token_start, token_end, token_count, chunk (by `text`, of its tokens): windows of `size` tokens every size - overlap, the last one the
    first that reaches the end. Their number has a closed form, so rows are made without state."""
    if overlap >= size:
        raise ValueError("the overlap must be below the chunk size")
    step, t = size - overlap, F.col("__t")
    n = F.greatest(F.lit(0), F.ceil((F.size(t) - size) / step)).cast("int")
    # Each row takes its own window only: with the tokens of its whole document a batch of rows would have no bound.
    windows = F.when(F.size(t) > 0, F.transform(F.sequence(F.lit(0), n), lambda i: F.slice(t, i * step + 1, size)))
    rows = docs.withColumn("__t", tokens).select(*docs.columns, F.posexplode(windows).alias("chunk_index", "__part"))
    start, part = F.col("chunk_index") * step, F.col("__part")
    return rows.select(*docs.columns, "chunk_index", start.alias("token_start"), (start + F.size(part)).alias("token_end"), F.size(part).alias("token_count"), text(part).alias("chunk"))
