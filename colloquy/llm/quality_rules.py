"""Adaptive quality rules per language and source (operator 4), DataFrame functions only.

Features of a whole text come from array functions in its own row, without a shuffle: an 8-word window is hashed to
64 bits, a text with a repeated hash has its windows sorted by hash, and the words under repeated windows are
counted. Thresholds come from log-bucket quantile sketches (a count per bucket whose bounds grow by a fixed ratio,
so relative error is bounded): counts of two sketches add, rows combine before the shuffle, and the sketch of a
group is small however many rows it holds. A group with few rows takes the merged sketch of its language, then of
all. A metric fails beyond the quartiles by SPREADS times their distance. Features join the thresholds to give the
verdict.

Defined cases: a null text has no words and fails; null lang or source are groups of their own; repeated rows are
judged alike, each counts in the sketches; an empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from colloquy.operators.joins import sized_join

from .common import BLANK_RUN, read_table, text_of, written

WINDOW = 8
SYMBOLS = "#*$%&|<>"

ACCURACY = 0.02  # of a sketch's quantiles, relative
LEAST_ROWS = 100  # of a group with thresholds of its own
SPREADS = 4.0
#: Metric: the least distance of the quartiles that counts, and if low values fail too.
METRICS = {"mean_word": (0.25, True), "symbols": (0.05, False), "dup_lines": (0.05, False), "capitals": (0.02, False), "repeats": (0.05, False)}


def let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.transform(F.array(value), body)[0]


def repeated_words(hashes: Column) -> Column:
    """Words under windows whose hash occurs twice or more: positions of such windows, each adding what the one before leaves."""
    pairs = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("p"))))

    def places(s: Column) -> Column:
        same = lambda x, j: (x.h == F.get(s, j - 1).h) | (x.h == F.get(s, j + 1).h)
        return F.array_sort(F.transform(F.filter(s, lambda x, j: F.coalesce(same(x, j), F.get(s, j - 1).h == x.h, F.get(s, j + 1).h == x.h)), lambda x: x.p))

    def covered(p: Column) -> Column:
        return F.aggregate(F.transform(p, lambda x, j: F.least(F.lit(WINDOW), F.coalesce(x - F.get(p, j - 1), F.lit(WINDOW)))), F.lit(0), lambda a, b: a + b)

    return let(pairs, lambda s: let(places(s), covered))


def joined(hashes: str, step: int) -> Column:
    """Hashes of windows twice as long as `step` words, from those of windows of `step` words."""
    return F.zip_with(F.slice(hashes, 1, F.greatest(F.size(hashes) - step, F.lit(0))), F.slice(hashes, step + 1, F.size(hashes)), lambda a, b: F.xxhash64(a, b))


def features(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_upper, n_repeat_words."""
    only = lambda what: F.length(F.regexp_replace("text", f"[^{what}]+", "")).cast("long")
    rows = docs.select("doc_id", "lang", "source", text_of().alias("text"))
    rows = rows.withColumn("words", F.array_remove(F.split("text", BLANK_RUN), "")).withColumn("lines", F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    rows = rows.select(
        "doc_id", "lang", "source",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        only(SYMBOLS).alias("n_symbols"),
        only("A-Z").alias("n_upper"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.transform("words", lambda w: F.xxhash64(w)).alias("hashes"),
    )
    for step in (1, 2, 4):
        rows = rows.withColumn("hashes", joined("hashes", step))
    again = F.size("hashes") > F.size(F.array_distinct("hashes"))
    return rows.withColumn("n_repeat_words", F.when(again, repeated_words(F.col("hashes"))).otherwise(0).cast("long")).drop("hashes")


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def metrics() -> dict[str, Column]:
    per = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1))
    return {"mean_word": per("word_chars", "n_words"), "symbols": per("n_symbols", "n_words"), "dup_lines": per("n_dup_lines", "n_lines"), "capitals": per("n_upper", "word_chars"), "repeats": per("n_repeat_words", "n_words")}


def sketches(feats: DataFrame, accuracy: float = ACCURACY) -> DataFrame:
    """lang, source, metric, bucket, n: of documents that the base rules pass. Bucket null holds zeros."""
    ratio = F.lit((1 + accuracy) / (1 - accuracy))
    values = F.explode(F.array(*[F.struct(F.lit(k).alias("metric"), v.alias("value")) for k, v in metrics().items()])).alias("m")
    bucket = F.when(F.col("m.value") > 0, F.ceil(F.round(F.ln("m.value") / F.ln(ratio), 6))).alias("bucket")
    return feats.filter(~base_failed()).select("lang", "source", values).groupBy("lang", "source", F.col("m.metric").alias("metric"), bucket).agg(F.count("*").alias("n"))


def quartiles(sketch: DataFrame, by: list[str], accuracy: float = ACCURACY) -> DataFrame:
    """n, q25 and q75 of each metric and group, from merged sketches."""
    ratio = (1 + accuracy) / (1 - accuracy)
    merged = sketch.groupBy(*by, "metric", "bucket").agg(F.sum("n").alias("n"))
    w = Window.partitionBy(*by, "metric")
    value = F.when(F.col("bucket").isNull(), 0.0).otherwise(2 * F.pow(F.lit(ratio), F.col("bucket")) / (ratio + 1))
    run = merged.select(*by, "metric", value.alias("value"), F.sum("n").over(w.orderBy(F.col("bucket").asc_nulls_first())).alias("upto"), F.sum("n").over(w).alias("all"))
    at = lambda q: F.min(F.when(F.col("upto") >= q * F.col("all"), F.col("value")))
    return run.groupBy(*by, "metric").agg(F.max("all").alias("n"), at(0.25).alias("q25"), at(0.75).alias("q75"))


def thresholds(sketch: DataFrame, least_rows: int = LEAST_ROWS, spreads: float = SPREADS) -> DataFrame:
    """One row per lang and source: lo_ and hi_ of every metric."""
    own, lang, every = (quartiles(sketch, by) for by in (["lang", "source"], ["lang"], []))
    alias = lambda df, p: df.select(*[F.col(c).alias(f"{p}_{c}") for c in df.columns])
    a, b, c = alias(own, "a"), alias(lang, "b"), alias(every, "c")
    rows = a.join(b, F.col("a_lang").eqNullSafe(F.col("b_lang")) & (F.col("a_metric") == F.col("b_metric"))).join(c, F.col("a_metric") == F.col("c_metric"))
    pick = lambda q: F.when(F.col("a_n") >= least_rows, F.col(f"a_{q}")).when(F.col("b_n") >= least_rows, F.col(f"b_{q}")).otherwise(F.col(f"c_{q}"))
    rows = rows.select(F.col("a_lang").alias("lang"), F.col("a_source").alias("source"), F.col("a_metric").alias("metric"), pick("q25").alias("q25"), pick("q75").alias("q75"))
    least = F.create_map(*[F.lit(x) for k, (d, _) in METRICS.items() for x in (k, d)])
    room = spreads * F.greatest(F.col("q75") - F.col("q25"), least[F.col("metric")])
    of = lambda k, v: F.max(F.when(F.col("metric") == k, v))
    return rows.groupBy("lang", "source").agg(*[of(k, F.col("q25") - room).alias(f"lo_{k}") for k in METRICS], *[of(k, F.col("q75") + room).alias(f"hi_{k}") for k in METRICS])


def judge(feats: DataFrame, limits: DataFrame) -> DataFrame:
    """The features with base_failed and kept."""
    key = lambda c: F.struct(F.col(c).alias("v"))  # noqa: E731  null is a value inside a struct
    left = feats.withColumn("group", F.struct(key("lang"), key("source")))
    right = written(limits.withColumn("group", F.struct(key("lang"), key("source"))).drop("lang", "source"), "limits")
    rows = sized_join(left, right, ["group"], "left")
    inside = F.lit(True)
    for k, v in metrics().items():
        inside = inside & (v <= F.col(f"hi_{k}")) & ((v >= F.col(f"lo_{k}")) if METRICS[k][1] else F.lit(True))
    return rows.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & F.coalesce(inside, F.lit(False)))


def quality_rules(docs: DataFrame, least_rows: int = LEAST_ROWS, spreads: float = SPREADS) -> DataFrame:
    feats = written(features(docs), "features")
    return judge(feats, thresholds(sketches(feats), least_rows, spreads))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality_rules(read_table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _sql() -> str:
    ratio = (1 + ACCURACY) / (1 - ACCURACY)
    values = {"mean_word": ("word_chars", "n_words"), "symbols": ("n_symbols", "n_words"), "dup_lines": ("n_dup_lines", "n_lines"), "capitals": ("n_upper", "word_chars"), "repeats": ("n_repeat_words", "n_words")}
    of = {k: f"{a} / greatest({b}, 1)::DOUBLE" for k, (a, b) in values.items()}
    level = lambda name, by: f"""{name}_run AS (SELECT {by} metric, CASE WHEN bucket IS NULL THEN 0 ELSE 2 * pow({ratio!r}, bucket) / ({ratio!r} + 1) END AS v,
        sum(n) OVER (PARTITION BY {by} metric ORDER BY bucket NULLS FIRST) AS upto, sum(n) OVER (PARTITION BY {by} metric) AS every FROM (SELECT {by} metric, bucket, sum(n) AS n FROM sketch GROUP BY ALL)),
      {name} AS (SELECT {by} metric, max(every) AS n, min(v) FILTER (upto >= 0.25 * every) AS q25, min(v) FILTER (upto >= 0.75 * every) AS q75 FROM {name}_run GROUP BY ALL)"""  # noqa: E731
    pick = lambda q: f"CASE WHEN a.n >= {LEAST_ROWS} THEN a.{q} WHEN b.n >= {LEAST_ROWS} THEN b.{q} ELSE c.{q} END AS {q}"
    ok = " AND ".join(f"m_{k} <= hi_{k}" + (f" AND m_{k} >= lo_{k}" if low else "") for k, (_, low) in METRICS.items())
    least = " ".join(f"WHEN '{k}' THEN {d}" for k, (d, _) in METRICS.items())
    return rf"""
    WITH t AS (SELECT doc_id, lang, source, coalesce(text, '') AS text FROM documents),
      w AS (SELECT *, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM t),
      win AS (SELECT doc_id, i, array_to_string(words[i:i + 7], ' ') AS win FROM (SELECT doc_id, words, unnest(range(1, len(words) - 6)) AS i FROM w WHERE len(words) >= 8)),
      dup AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, win) AS n FROM win) WHERE n > 1),
      rep AS (SELECT doc_id, sum(least(8, coalesce(i - before, 8))) AS n_repeat_words FROM (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM dup) GROUP BY doc_id),
      f AS (SELECT doc_id, lang, source, len(words)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
        length(regexp_replace(text, '[^A-Z]', '', 'g')) AS n_upper, len(lines)::BIGINT AS n_lines, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
        FROM w LEFT JOIN rep USING (doc_id)),
      g AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, {", ".join(f"{v} AS m_{k}" for k, v in of.items())} FROM f),
      m AS ({" UNION ALL ".join(f"SELECT lang, source, '{k}' AS metric, m_{k} AS v FROM g WHERE NOT base_failed" for k in METRICS)}),
      sketch AS (SELECT lang, source, metric, CASE WHEN v > 0 THEN ceil(round(ln(v) / ln({ratio!r}), 6)) END AS bucket, count(*) AS n FROM m GROUP BY ALL),
      {level("own", "lang, source,")}, {level("ofl", "lang,")}, {level("alls", "")},
      q AS (SELECT a.lang, a.source, a.metric, {pick("q25")}, {pick("q75")} FROM own a JOIN ofl b ON a.lang IS NOT DISTINCT FROM b.lang AND a.metric = b.metric JOIN alls c ON a.metric = c.metric),
      r AS (SELECT *, {SPREADS} * greatest(q75 - q25, CASE metric {least} END) AS room FROM q),
      l AS (SELECT lang, source, {", ".join(f"max(q25 - room) FILTER (metric = '{k}') AS lo_{k}, max(q75 + room) FILTER (metric = '{k}') AS hi_{k}" for k in METRICS)} FROM r GROUP BY ALL)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND coalesce({ok}, false) AS kept
    FROM g LEFT JOIN l ON g.lang IS NOT DISTINCT FROM l.lang AND g.source IS NOT DISTINCT FROM l.source
    """


ORACLE_SQL = _sql()
