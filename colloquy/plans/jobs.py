"""Whole jobs, each a plan over the operators: clean, chunk, retrieve and evaluate, translate."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from colloquy.functions import text as T
from colloquy.operators import chunks as C
from colloquy.operators import clean as L
from colloquy.operators import encode as E
from colloquy.operators import evaluate as V
from colloquy.operators import retrieve as R
from colloquy.operators import sessions as S
from colloquy.operators import translate as X
from colloquy.operators.joins import sized_join
from colloquy.sources.scratch import fresh_path, stored
from colloquy.sources.tables import read_vectors
from colloquy.streaming.incremental import encode_unfinished

#: Configuration: encoder of questions, encoder of documents, mode.
CONFIGS: dict[str, tuple[str, str, str]] = {
    "aa-dense": ("hash-a", "hash-a", "dense"),
    "aa-sparse": ("hash-a", "hash-a", "sparse"),
    "aa-hybrid": ("hash-a", "hash-a", "hybrid"),
    "ab": ("hash-a", "hash-b", "dense"),
    "ba": ("hash-b", "hash-a", "dense"),
    "bb": ("hash-b", "hash-b", "dense"),
}
SPARSE_ENCODER = "hash-a"


def check_config(question: str, document: str, mode: str) -> None:
    """Sparse scores need the encoder that gives token weights on both sides."""
    if mode != "dense" and (question, document) != (SPARSE_ENCODER, SPARSE_ENCODER):
        raise ValueError(f"{mode} needs {SPARSE_ENCODER} for questions and documents")


def selected(names: list[str]) -> dict[str, tuple[str, str, str]]:
    out = {k: CONFIGS[k] for k in names}
    for config in out.values():
        check_config(*config)
    return out


def kept_at(df: DataFrame, path: str | None) -> DataFrame:
    """df, read back from a table at path if one is given: what stands before it then runs once."""
    if path is None:
        return df
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clean_job(raw: DataFrame, store: str | None = None, tail: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Clean messages and the accounting of rows, both from the one pass that writes the flagged rows: the counts are observed as
    the rows go by. store: where to write them; without it a table of the job's own. tail: of addresses without an at-sign."""
    seen = Observation("accounting")
    flags = L.flagged(raw, tail).observe(seen, *L.counts())
    flags = kept_at(flags, store) if store is not None else stored(flags, "flagged")
    n = seen.get
    return L.kept(flags), raw.sparkSession.createDataFrame([tuple(n.values())], ", ".join(f"{c} long" for c in n))


def chunk_job(clean: DataFrame, gap_seconds: float = 3600, size: int = 512, overlap: int = 128, basis: str = "en", count: Callable[[Column], Column] = T.word_count, cut: Callable[[Column, Column, Column], Column] = C.pieces) -> DataFrame:
    """Chunks of both corpora, notices after conversations. count and cut: of tokens, by words unless a tokenizer is given."""
    fields = {"ru": "body", "en": "body_en"}
    if overlap >= size:
        raise ValueError("the overlap must be below the chunk size")
    sess = stored(S.sessions(clean.filter("kind = 'conversation'"), gap_seconds=gap_seconds), "sessions")
    return C.all_chunks(C.conversation_chunks(sess, fields, size, overlap, basis, count, cut), C.broadcast_chunks(clean.filter("kind = 'broadcast'"), fields, count))


def vectors(texts: DataFrame) -> DataFrame:
    """texts (model, text and more) with embedding, tokens and weights, the last two only where the model gives them; without the text."""
    has = F.when(F.col("model") == SPARSE_ENCODER, F.col("text"))
    return E.sparse_arrays(E.encoded(texts).withColumn("text", has))


def of_models(texts: DataFrame, models: set[str]) -> DataFrame:
    return texts.withColumn("model", F.explode(F.array(*[F.lit(m) for m in sorted(models)])))


def evaluate_job(questions: DataFrame, chunks: DataFrame, configs: list[str], scope: str = "doc", tolerance: int = 0, weight: float = R.WEIGHT, k: int = 10, document: str | None = None, table: str | None = None) -> DataFrame:
    """One row per configuration and question with rank and metrics. questions: qid, tag, corpus, question, qtype, gold; chunks: tag, chunk_index, text.
    document: only questions of documents whose tag begins so; their pools stay whole. table: of vectors by model and tag; what it has
    isn't encoded again, what it lacks is added. Each text is encoded once for each model, whatever the number of configurations,
    and all configurations are searched in one pass, as pools of their own."""
    spark, chosen = chunks.sparkSession, selected(configs)
    if document is not None:
        questions = questions.filter(F.col("tag").startswith(document))
        if questions.isEmpty():
            raise ValueError(f"no document begins with {document!r}")
    path = table or fresh_path(spark, "vectors")
    encode_unfinished(spark, of_models(chunks.select("tag", "chunk_index", "text"), {d for _, d, _ in chosen.values()}), path, vectors)
    docs = read_vectors(spark, path)
    asked = R.question_pools(questions, scope).select("qid", "pool_key", F.col("question").alias("text"))
    asked = stored(vectors(of_models(asked, {q for q, _, _ in chosen.values()})), "question-vectors")
    R.check_dimensions(docs.select("model", "embedding").unionByName(asked.select("model", "embedding")))
    table_of = spark.createDataFrame([(name, *config) for name, config in chosen.items()], "config string, q_model string, d_model string, mode string")
    own = lambda c: F.concat_ws("/", "config", F.col(c))
    used = {
        "embedding": F.when(F.col("mode") != "sparse", F.col("embedding")),
        "tokens": F.when(F.col("mode") != "dense", F.col("tokens")),
        "weights": F.when(F.col("mode") != "dense", F.col("weights")),
    }
    scale = F.when(F.col("mode") == "hybrid", F.lit(weight)).otherwise(F.lit(1.0))
    q = asked.join(F.broadcast(table_of), F.col("model") == F.col("q_model")).withColumns(used)  # a row for each configuration
    q = q.select(own("qid").alias("qid"), own("pool_key").alias("pool_key"), "embedding", "tokens", F.transform("weights", lambda x: x * scale).alias("weights"))
    d = R.pools(docs, scope).join(F.broadcast(table_of), F.col("model") == F.col("d_model")).withColumns(used)
    d = d.select(own("pool_key").alias("pool_key"), "tag", "chunk_index", "embedding", "tokens", "weights")
    d = sized_join(d, stored(q.select("pool_key").distinct(), "pools"), ["pool_key"], "left_semi")  # chunks that no question looks through aren't packed
    top = V.ranked(R.top_k(q, d, k, "hybrid", 1.0), ["qid"]).withColumnRenamed("qid", "__qid")
    each = questions.crossJoin(F.broadcast(table_of.select("config"))).withColumn("__qid", own("qid"))
    return V.query_metrics(each.join(top, "__qid").drop("__qid"), tolerance).withColumn("scope", F.lit(scope))


def translate_job(chunks: DataFrame, ids: list[str], cache: DataFrame, translate: Callable[[], X.Translate], shards: int | None = None, translate_noise: bool = False, keep_original: bool = False, store: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Chunks with translated text, and the new rows of the cache. store: where to write the new rows first; without it, each
    action on either result asks the model again."""
    lines = X.lines_of(chunks, ids)
    known = X.latest(cache)
    new = X.translated(X.work_list(X.bodies(lines), known, translate_noise), translate, shards).select(F.col("body").alias("en"), F.col("text").alias("ko"))
    new = kept_at(new, store)
    text = X.rebuilt(lines, known.select("en", "ko").unionByName(new), ids).withColumnRenamed("text", "__new")
    out = chunks.join(text, ids)
    if keep_original:
        out = out.withColumn("text_en", F.col("text"))
    return out.withColumn("text", F.col("__new")).drop("__new"), new
