"""Translation of distinct message bodies with a cache, and texts rebuilt from it."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colloquy.sources.scratch import stored

from .joins import distinct_texts, join_texts

# How lines of chunks and of a model's answers look, and what is not worth translating.
RAW_PREFIXES = ("수신: ", "[대화] ", "[공지] ")
MESSAGE = r"(?d)^(?:(\d{2}:\d{2}) )?([^:]{1,40}): (.*)$"
LETTER = r"[A-Za-zЀ-ӿ가-힣]"
DUMP_HIT = r"https?://|\b\d{1,3}(?:\.\d{1,3}){3}\b|\b[\w.+-]+@[\w-]+\.[\w.]+\b"
NUMBERED = r"(?d)^\s*(\d+)\s*[.)]\s?(.*)$"
THINKING = r"(?s)<think>.*?</think>\s*"

DUMP_CHARS = 400
DUMP_HITS = 3
SOLO_CHARS = 300
PACK_ITEMS = 8
PACK_CHARS = 1200
SHARD_BODIES = 20_000  # bodies that one task sorts and packs

Translate = Callable[[list[str]], list[str]]


def is_noise(body: Column) -> Column:
    """Blank, without a letter, or a long dump of addresses."""
    s = F.trim(F.regexp_replace(body, r"(?U)^\s+|\s+$", ""))
    dump = (F.length(s) > DUMP_CHARS) & (F.size(F.regexp_extract_all(s, F.lit(DUMP_HIT), F.lit(0))) >= DUMP_HITS)
    return (s == "") | ~s.rlike(LETTER) | dump


def lines_of(chunks: DataFrame, ids: list[str], text: str = "text") -> DataFrame:
    """ids, line_no, kind (msg or raw), ts, who, body."""
    rows = chunks.select(*ids, F.posexplode(F.split(text, "\n")).alias("line_no", "line"))
    raw = F.lit(False)
    for p in RAW_PREFIXES:
        raw |= F.col("line").startswith(p)
    message = ~raw & F.col("line").rlike(MESSAGE)
    part = lambda k: F.when(message, F.regexp_extract("line", MESSAGE, k))
    return rows.select(*ids, "line_no", F.when(message, "msg").otherwise("raw").alias("kind"), F.nullif(part(1), F.lit("")).alias("ts"), part(2).alias("who"), F.coalesce(part(3), "line").alias("body"))


def bodies(lines: DataFrame) -> DataFrame:
    """Distinct bodies of messages that aren't blank, with `noise`."""
    rows = lines.filter((F.col("kind") == "msg") & F.col("body").rlike(r"(?U)\S"))
    return distinct_texts(rows, "body").withColumn("noise", is_noise(F.col("body")))


def body_report(lines: DataFrame) -> DataFrame:
    """Messages, distinct bodies, their characters, and the noise among them."""
    distinct = bodies(lines).agg(F.count("*").alias("n_bodies"), F.coalesce(F.sum(F.length("body")), F.lit(0)).alias("n_chars"), F.count_if("noise").alias("n_noise"), F.coalesce(F.sum(F.when(F.col("noise"), F.length("body"))), F.lit(0)).alias("noise_chars"))
    return lines.agg(F.count_if(F.col("kind") == "msg").alias("n_lines")).crossJoin(distinct)  # one row each


def latest(cache: DataFrame, key: str = "en", value: str = "ko", seq: str = "seq") -> DataFrame:
    """One row per key: the value written last."""
    return cache.groupBy(key).agg(F.max_by(value, seq).alias(value))


def work_list(found: DataFrame, cache: DataFrame, translate_noise: bool = False) -> DataFrame:
    """Bodies that are neither cached nor noise."""
    todo = found if translate_noise else found.filter(~F.col("noise"))
    return join_texts(todo.select("body"), "body", cache.select("en"), "en", "left_anti")


def shards_for(todo: DataFrame) -> int:
    return max(1, -(-todo.count() // SHARD_BODIES))


def packs(todo: DataFrame, shards: int, items: int = PACK_ITEMS, chars: int = PACK_CHARS, solo: int = SOLO_CHARS) -> DataFrame:
    """body, shard, pack, no: bodies of a shard in order of length; a pack takes up to `items` bodies and `chars` characters, long ones go alone."""

    def per_shard(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.assign(n=pdf.body.str.len()).sort_values(["n", "body"], ignore_index=True)
        pack, no, held, count, total = [], [], -1, items, 0
        for n in pdf.n:
            if count >= items or total + n > chars or n > solo:
                held, count, total = held + 1, 0, 0
            pack.append(held)
            no.append(count + 1)
            count, total = (items, 0) if n > solo else (count + 1, total + n)
        return pdf.assign(pack=pack, no=no)[["body", "shard", "pack", "no"]]

    dealt = todo.select("body", (F.conv(F.substring(F.md5(F.col("body").cast("binary")), 1, 8), 16, 10).cast("long") % shards).cast("int").alias("shard"))
    return dealt.groupBy("shard").applyInPandas(per_shard, "body string, shard int, pack int, no int")


def parsed_answers(answers: DataFrame, ids: list[str], answer: str = "answer", n: str = "n") -> DataFrame:
    """ids, no, text: numbered lines of an answer; lines without a number go to the item before, a number out of 1..n closes it,
    a number that comes again replaces the text it had."""
    clean = F.trim(F.regexp_replace(F.regexp_replace(answer, THINKING, ""), r"(?U)^\s+|\s+$", ""))
    rows = answers.select(*ids, n, F.posexplode(F.split(clean, "\n")).alias("at", "line"))
    numbered = F.col("line").rlike(NUMBERED)
    rows = rows.withColumn("number", F.when(numbered, F.expr("try_cast(regexp_extract(line, r'^\\s*(\\d+)', 1) as bigint)"))).withColumn("numbered", numbered)
    segment = F.sum(F.col("numbered").cast("int")).over(Window.partitionBy(*ids).orderBy("at"))
    strip = lambda c: F.regexp_replace(c, r"(?U)^\s+|\s+$", "")
    rows = rows.withColumn("segment", segment).withColumn("piece", F.when(numbered, strip(F.regexp_extract("line", NUMBERED, 2))).otherwise(strip(F.col("line"))))
    rows = rows.filter((F.col("segment") > 0) & (F.col("numbered") | (F.col("piece") != "")))
    items = rows.groupBy(*ids, "segment", n).agg(F.max("number").alias("no"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "piece"))), lambda x: x.piece), " ").alias("text"))
    kept = items.filter(F.col("no").between(1, F.col(n)))
    return kept.groupBy(*ids, "no").agg(F.max_by("text", "segment").alias("text"))


def answered(run: Translate, prompts: list[str]) -> list[str]:
    """An answer for each prompt. A batch that fails is halved until the prompt at fault is alone; its answer is empty."""
    try:
        got = run(prompts)
        if len(got) == len(prompts):
            return got
    except Exception:  # the model's own failure, of any kind
        pass
    if len(prompts) == 1:
        return [""]
    half = len(prompts) // 2
    return answered(run, prompts[:half]) + answered(run, prompts[half:])


def translated(todo: DataFrame, translate: Callable[[], Translate], shards: int | None = None) -> DataFrame:
    """body, text. A pack is one prompt; items that its answer lacks are asked for alone, and stay as they are if that fails too.
    What the model says is stored, so each prompt is asked once."""
    per_pack = stored(packs(todo, shards or shards_for(todo)).groupBy("shard", "pack").agg(F.array_sort(F.collect_list(F.struct("no", "body"))).alias("items")), "packs")

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        run = translate()
        for b in batches:
            prompts = ["\n".join(f"{i['no']}. {i['body']}" for i in items) for items in b["items"]]
            yield b[["shard", "pack"]].assign(answer=answered(run, prompts))

    asked = per_pack.select("shard", "pack", "items").mapInPandas(ask, "shard int, pack int, answer string")
    flat = per_pack.select("shard", "pack", F.explode("items").alias("i")).select("shard", "pack", "i.no", "i.body")
    sizes = per_pack.select("shard", "pack", F.size("items").alias("n"))
    got = parsed_answers(asked.join(sizes, ["shard", "pack"]), ["shard", "pack"])
    first = stored(flat.join(got, ["shard", "pack", "no"], "left"), "answers")

    def alone(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        run = translate()
        for b in batches:
            answers = answered(run, [f"1. {x}" for x in b.body])
            yield b[["shard", "pack", "no"]].assign(answer=answers, n=1)

    at = ["shard", "pack", "no"]
    again = first.filter("text is null").select(*at, "body").mapInPandas(alone, "shard int, pack int, no int, answer string, n int").withColumnRenamed("no", "item")
    retried = parsed_answers(again, ["shard", "pack", "item"]).select("shard", "pack", F.col("item").alias("no"), F.col("text").alias("retry"))
    return first.join(retried, at, "left").select("body", F.coalesce("text", "retry", "body").alias("text"))


def rebuilt(lines: DataFrame, cache: DataFrame, ids: list[str]) -> DataFrame:
    """ids, text: each message's body replaced by its translation if there is one, lines in their order."""
    rows = join_texts(lines, "body", cache.select("en", "ko"), "en", "left").drop("en")
    said = F.concat(F.coalesce(F.concat("ts", F.lit(" ")), F.lit("")), "who", F.lit(": "), F.coalesce("ko", "body"))
    rows = rows.withColumn("out", F.when(F.col("kind") == "msg", said).otherwise(F.col("body")))
    return rows.groupBy(*ids).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "out"))), lambda x: x.out), "\n").alias("text"))
