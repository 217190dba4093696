"""Retrieval quality: metrics of a question, means over groups, comparisons of configurations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KS = (5, 10)
METRICS = ("hit@5", "hit@10", "recall@5", "recall@10", "mrr@10", "ndcg@10")


def ranked(top: DataFrame, by: list[str]) -> DataFrame:
    """One row per question with top: its (tag, chunk_index, score) in order of rank, and n_candidates."""
    rows = top.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("rank", "tag", "chunk_index", F.round("score", 4).alias("score")))).alias("top"), F.max("n_candidates").alias("n_candidates"))
    return rows.withColumn("top", F.transform("top", lambda x: F.struct(x.tag.alias("tag"), x.chunk_index.alias("chunk_index"), x.score.alias("score"))))


def query_metrics(rows: DataFrame, tolerance: int = 0, coverage: bool = True) -> DataFrame:
    """rows (tag, gold, top) with rank and METRICS, all within the row. A result hits gold g in the question's own document within
    `tolerance`; each g counts once however often it is met, equal ones in gold count each. coverage=False: recall is hit."""
    met = lambda x, g: (x.tag == F.col("tag")) & (F.abs(x.chunk_index - g) <= tolerance)
    hits = F.transform("top", lambda x: F.exists("gold", lambda g: met(x, g)))
    rank = F.coalesce(F.array_position(hits, True), F.lit(0)).cast("int")
    covered = lambda k: F.size(F.filter("gold", lambda g: F.exists(F.slice("top", 1, k), lambda x: met(x, g))))
    out = rows.withColumn("rank", F.when(rank <= max(KS), rank).otherwise(0))
    hit = {k: ((F.col("rank") > 0) & (F.col("rank") <= k)).cast("double") for k in KS}
    for k in KS:
        out = out.withColumn(f"hit@{k}", hit[k]).withColumn(f"recall@{k}", covered(k) / F.least(F.size("gold"), F.lit(k)) if coverage else hit[k])
    zero = lambda c: F.when(F.col("rank") > 0, c).otherwise(0.0)
    return out.withColumn("mrr@10", zero(1 / F.col("rank"))).withColumn("ndcg@10", zero(1 / F.log2(F.col("rank") + 1)))


def bad_gold(questions: DataFrame, sizes: DataFrame) -> DataFrame:
    """Questions without gold, or with gold outside 0 .. n_chunks - 1 of their document."""
    rows = questions.join(sizes.select("tag", "n_chunks"), "tag", "left")
    outside = F.exists("gold", lambda g: (g < 0) | (g >= F.coalesce("n_chunks", F.lit(0))))
    return rows.filter(F.coalesce(F.size("gold") <= 0, F.lit(True)) | outside)


def check_gold(questions: DataFrame, sizes: DataFrame) -> DataFrame:
    """questions, or an error that names the first bad ones."""
    bad = bad_gold(questions, sizes).select("tag", "qid").limit(5).collect()
    if bad:
        raise ValueError(f"gold chunks are missing or out of range: {[tuple(r) for r in bad]}")
    return questions


def means(rows: DataFrame, axes: dict[str, list[str]], keys: tuple[str, ...] = ("config",), metrics: tuple[str, ...] = METRICS) -> DataFrame:
    """Means of metrics rounded to 4 over all axes in one pass of grouping sets: group_kind, the axis columns (null where an axis does
    not use them), n_queries, scope (the single one or 'mixed'). An axis on a column leaves out rows where it is empty or null."""
    columns = list(dict.fromkeys(c for cols in axes.values() for c in cols))
    clean = rows.select(*keys, *[F.nullif(F.col(c).cast("string"), F.lit("")).alias(c) for c in columns], *[F.col(f"`{m}`") for m in metrics], (F.col("scope") if "scope" in rows.columns else F.lit(None).cast("string")).alias("__scope"))
    sets = [[F.col(c) for c in (*keys, *cols)] for cols in axes.values()]
    bit = {c: len(columns) - 1 - i for i, c in enumerate(columns)}
    id_of = {kind: sum(1 << bit[c] for c in columns if c not in cols) for kind, cols in axes.items()}
    got = clean.groupingSets(sets, *keys, *columns).agg(
        F.grouping_id().alias("gid"), F.count("*").alias("n_queries"), *[F.round(F.avg(f"`{m}`"), 4).alias(m) for m in metrics],
        F.when(F.min("__scope") == F.max("__scope"), F.min("__scope")).otherwise("mixed").alias("scope"),
    )
    kind = F.lit(None).cast("string")
    for name, gid in id_of.items():
        used = F.lit(True)
        for c in axes[name]:
            used &= F.col(c).isNotNull()
        kind = F.when((F.col("gid") == gid) & used, name).otherwise(kind)
    return got.withColumn("group_kind", kind).filter("group_kind is not null").drop("gid")


def roll_up(rows: DataFrame, keys: tuple[str, ...] = ("config",)) -> DataFrame:
    """The standard axes: document, question type, both, Korean or other corpora, all."""
    named = rows.withColumn("language_group", F.when(F.col("corpus") == "ko", "ALL(한국어)").otherwise("ALL(다국어)"))
    axes = {"document": ["tag"], "q_type": ["qtype"], "document_q_type": ["tag", "qtype"], "language_group": ["language_group"], "overall": []}
    got = means(named, axes, keys)
    name = F.when(F.col("group_kind") == "document", F.col("tag")).when(F.col("group_kind") == "q_type", F.concat(F.lit("QTYPE("), "qtype", F.lit(")"))).when(F.col("group_kind") == "document_q_type", F.concat_ws(" / ", "tag", "qtype")).when(F.col("group_kind") == "language_group", F.col("language_group")).otherwise("ALL")
    kind = F.when(F.col("group_kind") == "language_group", "overall").otherwise(F.col("group_kind"))
    return got.select(*keys, kind.alias("group_kind"), name.alias("document"), "n_queries", *[F.col(f"`{m}`") for m in METRICS])


def long_metrics(summary: DataFrame, group: str = "ALL") -> DataFrame:
    rows = summary.filter(F.col("document") == group)
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("no"), F.lit(m).alias("metric"), F.col(f"`{m}`").alias("value")) for i, m in enumerate(METRICS)]))
    return rows.select("config", each.alias("x")).select("config", "x.*")


def compare(summary: DataFrame, configs: list[str], group: str = "ALL") -> DataFrame:
    """Rows: metrics; columns: configurations."""
    return long_metrics(summary, group).groupBy("no", "metric").pivot("config", configs).agg(F.first("value")).orderBy("no").drop("no")


def matrix(summary: DataFrame, configs: list[str], kind: str, metric: str = "ndcg@10", sort_by: str | None = None) -> DataFrame:
    """Rows: groups; columns: configurations; best first by one of them, groups it lacks last."""
    rows = summary.filter(F.col("group_kind") == kind)
    got = rows.groupBy("document").pivot("config", configs).agg(F.first(F.col(f"`{metric}`")))
    sizes = rows.groupBy("document").agg(F.max("n_queries").alias("n_queries"))
    return got.join(sizes, "document").select("document", "n_queries", *[F.col(f"`{c}`") for c in configs]).orderBy(F.coalesce(F.col(f"`{sort_by or configs[0]}`"), F.lit(-1.0)).desc(), "document")


def best_config(summary: DataFrame, configs: list[str], group: str = "ALL") -> DataFrame:
    """The configuration with the largest value of each metric; the first in the given order on ties."""
    order = F.create_map(*[F.lit(x) for i, c in enumerate(configs) for x in (c, i)])[F.col("config")]
    return long_metrics(summary, group).groupBy("metric").agg(F.max_by("config", F.struct("value", -order)).alias("config"), F.max("value").alias("value"))


def misses(rows: DataFrame, n: int = 20, beyond: int = 3) -> DataFrame:
    """Questions missed or below rank `beyond`: misses first, then by rising rank; their three first results."""
    bad = rows.filter((F.col("rank") == 0) | (F.col("rank") > beyond))
    return bad.orderBy((F.col("rank") == 0).desc(), "rank", "qid").limit(n).select("qid", "tag", "rank", "gold", F.slice("top", 1, 3).alias("top3"))


def task_difference(rows: DataFrame, evidence: str, answer: str, metric: str = "ndcg@10") -> DataFrame:
    """Per configuration: means of both tasks side by side, answer less evidence."""
    of = lambda t: F.round(F.avg(F.when(F.col("task") == t, F.col(f"`{metric}`"))), 4)
    got = rows.groupBy("config").agg(of(evidence).alias("evidence"), of(answer).alias("answer"))
    return got.filter("evidence is not null and answer is not null").withColumn("difference", F.round(F.col("answer") - F.col("evidence"), 4))


def documents_of(summary: DataFrame, config: str, metric: str = "ndcg@10") -> DataFrame:
    """One configuration's documents, best first."""
    return summary.filter((F.col("config") == config) & (F.col("group_kind") == "document")).orderBy(F.desc(F.col(f"`{metric}`")), "document")


