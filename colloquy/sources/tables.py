"""Reading and writing the tables of the jobs, always with explicit schemas."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from colloquy.operators.joins import few
from colloquy.sources.scratch import remove_path

RAW = "src_row long, ts timestamp, `from` string, `to` string, body string, body_en string"
CLEAN = "src_row long, ts timestamp, nick_from string, nick_to string, dyad string, body string, body_en string, kind string, recipients array<string>, merged_rows array<long>"
CHUNK = "chunk_index int, session_id long, kind string, participants array<string>, recipients array<string>, ts_start timestamp, ts_end timestamp, n_messages int, part int, n_parts int, n_tokens int, src_rows array<long>, text string"
QA = "source string, embedding_file string, corpora array<struct<tag string, corpus string, embedding_file string>>, qa_pairs array<struct<id string, question string, q_type int, q_type_name string, answer_chunk_indices array<int>, answer_chunk_index int, evidence_id string>>"
CACHE = "seq long, en string, ko string"
TEXT_KEYS = ("text", "content", "body")


def spread(df: DataFrame) -> DataFrame:
    """df on as many partitions as there are cores: the rows of a table of a few splits are dealt out, a larger one stays as it lies."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def csv_records(spark: SparkSession, path: str) -> DataFrame:
    """file, at, no, record: the records of CSV files whose quoted fields may span lines, each file read by as many tasks as it has splits.

    Whether a split begins within quotes is told by the number of quotes in the splits before it: one pass counts them (one row a
    split). In the second pass each task puts its lines together to records from there on. What a split's edge cuts goes on as
    fragments, two a split at most, which are joined in order. The header is the record of no 0 at 0."""
    lines = spark.read.text(path, lineSep="\n").select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"))
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"')))
    splits, inside, n = sorted(lines.groupBy("file", "at").agg(F.sum(quotes).alias("n")).collect()), [], 0
    for before, split in zip([None, *splits], splits, strict=False):
        n = 0 if before is None or before.file != split.file else n + before.n
        if n % 2:
            inside.append((split.file, split.at, True))
    held = spark.createDataFrame(inside, "file string, at long, inside boolean")
    rows = lines.join(F.broadcast(held), ["file", "at"], "left").select("value", "file", "at", F.coalesce("inside", F.lit(False)).alias("inside"))

    def per_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, no, held, within, cut = None, 0, [], False, False
        out: list[tuple] = []

        def done(last: bool) -> None:
            """What is held is a record, or at an edge of the split a fragment: of the record before it (no -1), or of one that goes on."""
            nonlocal no, held, cut
            if held:
                out.append((*key, -1 if cut else no, cut or last, "\n".join(held)))
                no, held, cut = no + (not cut), [], False

        for b in batches:
            odd = pc.count_substring(b.column(0), '"').to_numpy(zero_copy_only=False) % 2
            for value, file, at, inside, turns in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), odd.tolist(), strict=True):
                if (file, at) != key:
                    done(within)
                    key, no, within, cut = (file, at), 0, inside, inside
                held.append(value)
                within ^= bool(turns)
                if not within:
                    done(False)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), (pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.string()), strict=True)], ["file", "at", "no", "cut", "record"])
                out.clear()
        done(within)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), (pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.string()), strict=True)], ["file", "at", "no", "cut", "record"])

    got = rows.mapInArrow(per_task, "file string, at long, no long, cut boolean, record string")
    begins = F.sum((F.col("no") >= 0).cast("int")).over(Window.partitionBy("file").orderBy("at", "no"))  # two rows a split
    parts = got.filter("cut").withColumn("begin", begins).groupBy("file", "begin").agg(F.array_sort(F.collect_list(F.struct("at", "no", "record"))).alias("parts"))
    whole = parts.select("file", F.col("parts")[0]["at"].alias("at"), F.col("parts")[0]["no"].alias("no"), F.array_join("parts.record", "\n").alias("record"))
    return got.filter("not cut").drop("cut").unionByName(whole)


def read_csv_rows(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of CSV files with a header, by position; quotes are doubled within quotes, and fields may span lines."""
    records = csv_records(spark, path).filter("not (at = 0 and no = 0)").withColumn("record", F.regexp_replace("record", r"\r$", "")).filter("record <> ''")
    options = {"quote": '"', "escape": '"', "multiLine": "true"}
    return records.select(F.from_csv("record", F.lit(schema), options).alias("row")).select("row.*")


def read_raw_messages(spark: SparkSession, path: str) -> DataFrame:
    """The header's first, unnamed column is the row id."""
    return read_csv_rows(spark, path, RAW)


def write_clean(df: DataFrame, path: str, overwrite: bool = False) -> None:
    df.write.mode("overwrite" if overwrite else "errorifexists").partitionBy("kind").parquet(path)


def read_clean(spark: SparkSession, path: str, kind: str | None = None) -> DataFrame:
    rows = spark.read.parquet(path)
    return rows.filter(F.col("kind") == kind) if kind else rows


def write_clean_csv(df: DataFrame, path: str) -> None:
    """Lists joined by semicolons, rows in source order (the only global sort)."""
    joined = lambda c: F.array_join(F.col(c).cast("array<string>"), ";").alias(c)
    keep = [c for c in df.columns if c not in ("recipients", "merged_rows")]
    df.select(*keep, joined("recipients"), joined("merged_rows")).orderBy("src_row").write.csv(path, header=True, escape='"', quote='"')


def read_clean_csv(spark: SparkSession, path: str) -> DataFrame:
    flat = CLEAN.replace("array<string>", "string").replace("array<long>", "string")
    rows = spark.read.schema(flat).csv(path, header=True, multiLine=True, escape='"')
    items = lambda c: F.filter(F.split(F.coalesce(c, F.lit("")), ";"), lambda x: x != "")
    return rows.withColumn("recipients", items("recipients")).withColumn("merged_rows", items("merged_rows").cast("array<bigint>"))


def write_chunks(df: DataFrame, path: str) -> None:
    df.write.partitionBy("corpus").json(path, timestampFormat="yyyy-MM-dd'T'HH:mm:ss.SSSSSS")


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """Blank lines are skipped."""
    return spark.read.schema(CHUNK + ", corpus string").json(path, timestampFormat="yyyy-MM-dd'T'HH:mm:ss.SSSSSS").filter("chunk_index is not null")


def write_chunk_metadata(df: DataFrame, path: str, corpus: str) -> None:
    df.filter(F.col("corpus") == corpus).drop("text", "corpus").write.json(path)


def first_of_each(df: DataFrame, n: int, by: str = "tag", order: str = "chunk_index") -> DataFrame:
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(by).orderBy(order))).filter(F.col("__n") <= n).drop("__n")


def questions(files: DataFrame) -> DataFrame:
    """One row per corpus and question from QA records (schema QA and file, the file's name): tag, corpus, source, qid, question, q_type,
    q_type_name, evidence_id, gold. Without corpora the file's name gives the tag."""
    tag = F.regexp_replace(F.element_at(F.split("file", "/"), -1), r"_qa\.json.*$", "")
    own = F.array(F.struct(tag.alias("tag"), F.lit(None).cast("string").alias("corpus"), F.col("embedding_file")))
    rows = files.select(F.coalesce("source", F.element_at(F.split("file", "/"), -1)).alias("source"), F.explode(F.when(F.size("corpora") > 0, F.col("corpora")).otherwise(own)).alias("c"), "qa_pairs")
    rows = rows.select("source", "c.tag", F.coalesce(F.nullif("c.corpus", F.lit("")), F.substring_index("c.tag", "_", -1)).alias("corpus"), F.coalesce(F.nullif("c.embedding_file", F.lit("")), F.concat("c.tag", F.lit("_embeddings.npz"))).alias("vectors"), F.explode("qa_pairs").alias("p"))
    one = F.when(F.col("p.answer_chunk_index").isNotNull(), F.array("p.answer_chunk_index"))
    return rows.select("source", "tag", "corpus", "vectors", F.col("p.id").alias("qid"), "p.question", "p.q_type", "p.q_type_name", "p.evidence_id", F.coalesce("p.answer_chunk_indices", one, F.array().cast("array<int>")).alias("gold"))


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    return questions(spark.read.schema(QA).json(path, multiLine=True).withColumn("file", F.input_file_name()))


def body_of(raw: Column, field: str | None = None) -> Column:
    """A text, or of a JSON object the field asked for, else the first of TEXT_KEYS that isn't blank; null if it has none."""
    keys = (field,) if field else TEXT_KEYS
    found = F.coalesce(*[F.when(F.trim(F.get_json_object(raw, f"$.{k}")) != "", F.get_json_object(raw, f"$.{k}")) for k in keys])
    is_object = F.ltrim(raw).startswith("{") & F.get_json_object(raw, "$").isNotNull()
    return F.when(is_object, found).otherwise(raw)


def read_texts(spark: SparkSession, path: str, field: str | None = None) -> DataFrame:
    """path, text of whole files; bytes that aren't UTF-8 are read as cp949."""

    @F.pandas_udf(StringType())
    def decoded(contents: pd.Series) -> pd.Series:
        def one(b: bytes) -> str:
            try:
                return b.decode("utf-8")
            except UnicodeDecodeError:
                return b.decode("cp949", errors="replace")

        return contents.map(one)

    return spark.read.format("binaryFile").load(path).select("path", body_of(decoded("content"), field).alias("text"))


def write_vectors(df: DataFrame, path: str, overwrite: bool = False) -> None:
    """Partitions of (model, tag); with overwrite only those in df are replaced."""
    if overwrite:
        df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("model", "tag").parquet(path)
    else:
        df.write.mode("append").partitionBy("model", "tag").parquet(path)


def read_vectors(spark: SparkSession, path: str, model: str | None = None) -> DataFrame:
    rows = spark.read.parquet(path)
    return rows.filter(F.col("model") == model) if model else rows


def unfinished(wanted: DataFrame, finished: DataFrame, by: list[str]) -> DataFrame:
    """Rows whose (model, tag) isn't done yet. finished: a written table. Rows don't move where it is small: there may be as few keys as models."""
    done = finished.select(*by).distinct()
    return wanted.join(F.broadcast(done) if few(finished) else done, by, "left_anti")


def write_summary(df: DataFrame, path: str, run_id: str, overwrite: bool = False) -> None:
    """One folder per run; a run that is there is not replaced unless asked."""
    df.coalesce(1).write.mode("overwrite" if overwrite else "errorifexists").csv(f"{path}/run_id={run_id}", header=True)


def write_query_results(df: DataFrame, path: str, run_id: str, overwrite: bool = False) -> None:
    df.write.mode("overwrite" if overwrite else "errorifexists").json(f"{path}/run_id={run_id}")


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    """Lines that aren't valid are dropped."""
    return spark.read.schema(CACHE).json(path, mode="DROPMALFORMED").filter("en is not null and ko is not null")


def append_cache(df: DataFrame, path: str) -> None:
    df.select(F.col("seq").cast("long"), "en", "ko").write.mode("append").json(path)


#: A cache by key: folders gen=N/bucket=B, where a bucket holds the keys of one hash. A generation is what was added at once, or what older ones were
#: compacted to; the row with the largest seq of a key holds.
CACHE_BUCKETS = 64


def cache_bucket(text: Column) -> Column:
    return F.pmod(F.xxhash64(text), F.lit(CACHE_BUCKETS)).cast("int")


def _bucket_folders(spark: SparkSession, path: str) -> list[tuple[int, int, str]]:
    """gen, bucket and path of each folder: as many as generations times buckets."""
    top = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = top.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/gen=*/bucket=*"))
    names = [f.getPath().toString() for f in found or []]
    return [(int(n.split("/gen=")[1].split("/")[0]), int(n.rsplit("=", 1)[1]), n) for n in names]


def has_cache(spark: SparkSession, path: str) -> bool:
    return bool(_bucket_folders(spark, path))


def exists(spark: SparkSession, path: str) -> bool:
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    return there.getFileSystem(spark._jsc.hadoopConfiguration()).exists(there)


def add_to_cache(df: DataFrame, path: str) -> None:
    """New rows (seq, en, ko) as the next generation."""
    gen = 1 + max((g for g, _, _ in _bucket_folders(df.sparkSession, path)), default=-1)
    rows = df.select(F.col("seq").cast("long").alias("seq"), "en", "ko", F.lit(gen).alias("gen"), cache_bucket(F.col("en")).alias("bucket"))
    rows.repartition("bucket").write.mode("append").partitionBy("gen", "bucket").parquet(path)


def cached_of(texts: DataFrame, path: str, text: str = "en") -> DataFrame:
    """seq, en, ko of the buckets that these texts are in; the others are not read."""
    spark = texts.sparkSession
    wanted = {r.bucket for r in texts.select(cache_bucket(F.col(text)).alias("bucket")).distinct().collect()}  # at most CACHE_BUCKETS
    folders = [n for _, b, n in _bucket_folders(spark, path) if b in wanted]
    return spark.read.schema(CACHE).parquet(*folders) if folders else spark.createDataFrame([], CACHE)


def compact_cache(spark: SparkSession, path: str, least: int = 8) -> int:
    """Buckets of `least` generations or more become one generation with the last row of each key; says how many. Older folders go when the
    new one is written; if that is cut short, rows are there twice, which changes no result."""
    folders = _bucket_folders(spark, path)
    of: dict[int, list[str]] = {}
    for _, bucket, name in folders:
        of.setdefault(bucket, []).append(name)
    full = {b: names for b, names in of.items() if len(names) >= least}
    old = [n for names in full.values() for n in names]
    if not old:
        return 0
    rows = spark.read.schema(CACHE).parquet(*old).groupBy("en").agg(F.max(F.struct("seq", "ko")).alias("last"))
    add_to_cache(rows.select("last.seq", "en", "last.ko"), path)
    for name in old:
        remove_path(spark, name)
    return len(full)


