"""Gold labels: evidence blocks of documents, the chunks they overlap, and questions about them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colloquy.functions import text as T

# An evidence id, what parts a labelled list, and the letters of cases.
EVIDENCE_ID = r"\b([A-T]-\d{3})\b"
LIST_SPLIT = r"\s*[,、·]\s*"
LETTERS = "ABCDEFGHIJKLMNOPQRST"
MOST_GOLD = 8
HEAD_CHARS = 1600


def block_spans(docs: DataFrame, tag: str = "tag", text: str = "text", pattern: str = EVIDENCE_ID) -> DataFrame:
    """tag, block, char_start, char_end: a block begins where its id first occurs and ends where the next one begins, or the text."""
    ids = F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)))
    rows = docs.select(tag, text, F.explode(ids).alias("block"))
    # Where the id first stands as a word: the length of what a lazy match leaves before it.
    before = F.call_function("regexp_extract", F.col(text), F.concat(F.lit(r"(?s)^(.*?)\b"), "block", F.lit(r"\b")), F.lit(1))
    rows = rows.select(tag, "block", F.length(before).alias("char_start"), F.length(text).alias("n"))
    return rows.withColumn("char_end", F.coalesce(F.lead("char_start").over(Window.partitionBy(tag).orderBy("char_start")), "n")).drop("n")


def token_spans(spans: DataFrame, docs: DataFrame, tag: str = "tag", text: str = "text", count: Callable[[Column], Column] = T.word_count) -> DataFrame:
    """spans with tok_start and tok_end: token counts of the segments between block edges, added up."""
    cuts = spans.select(tag, F.explode(F.array("char_start", "char_end")).alias("at")).union(spans.select(tag, F.lit(0).alias("at"))).distinct()
    w = Window.partitionBy(tag).orderBy("at")
    segments = cuts.withColumn("to", F.lead("at").over(w)).join(docs.select(tag, text), tag)
    n = count(F.substring(F.col(text), F.col("at") + 1, F.coalesce("to", F.col("at")) - F.col("at")))
    upto = segments.select(tag, "at", n.alias("n")).withColumn("tok", F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).drop("n")
    first = upto.select(tag, F.col("at").alias("char_start"), F.col("tok").alias("tok_start"))
    last = upto.select(tag, F.col("at").alias("char_end"), F.col("tok").alias("tok_end"))
    return spans.join(first, [tag, "char_start"]).join(last, [tag, "char_end"])


def overlapping(blocks: DataFrame, chunks: DataFrame, tag: str = "tag", bucket: int = 4096) -> DataFrame:
    """tag, block, chunk_index of chunks with token_start < tok_end and token_end > tok_start. Both sides are dealt into buckets of the
    token axis, so that long documents don't pair everything; a pair is kept in the bucket where its overlap begins."""
    over = lambda a, b: F.explode(F.sequence(F.floor(a / bucket), F.floor(F.greatest(b - 1, a) / bucket)))
    left = blocks.withColumn("b", over(F.col("tok_start"), F.col("tok_end")))
    right = chunks.select(tag, "chunk_index", "token_start", "token_end").withColumn("b", over(F.col("token_start"), F.col("token_end")))
    begins = F.floor(F.greatest("token_start", "tok_start") / bucket)
    pairs = left.join(right, [tag, "b"]).filter((F.col("token_start") < F.col("tok_end")) & (F.col("token_end") > F.col("tok_start")) & (F.col("b") == begins))
    return pairs.select(tag, "block", "chunk_index")


def gold(blocks: DataFrame, chunks: DataFrame, tag: str = "tag", most: int = MOST_GOLD) -> DataFrame:
    """tag, block, gold (chunk indices), status: ok, missing (no chunk) or too_many."""
    got = overlapping(blocks, chunks, tag).groupBy(tag, "block").agg(F.array_sort(F.collect_list("chunk_index")).alias("gold"))
    rows = blocks.select(tag, "block").join(got, [tag, "block"], "left").withColumn("gold", F.coalesce("gold", F.array().cast("array<int>")))
    return rows.withColumn("status", F.when(F.size("gold") == 0, "missing").when(F.size("gold") > most, "too_many").otherwise("ok"))


def labelled(head: Column, label: Column) -> Column:
    """The rest of the line after the label and a colon; empty without one."""
    return F.coalesce(F.trim(F.call_function("regexp_extract", head, F.concat(F.lit(r"(?d)\Q"), F.coalesce(label, F.lit("\0")), F.lit(r"\E\s*[:：]\s*([^\n]+)")), F.lit(1))), F.lit(""))


def profiles(docs: DataFrame, spans: DataFrame, labels: DataFrame) -> DataFrame:
    """tag, case_no, people, orgs, places, charge of each case, from the text before its first block. labels: tag, people, orgs, places,
    keywords, charge (a null label is not looked for)."""
    rows = spans.filter(F.col("block").endswith("-001")).join(docs.select("tag", "text"), "tag").join(labels.select("tag", *[F.col(c).alias(f"l_{c}") for c in ("people", "orgs", "places", "keywords", "charge")]), "tag", "left")
    begin = F.greatest(F.lit(0), F.col("char_start") - HEAD_CHARS)
    rows = rows.withColumn("head", F.substring(F.col("text"), begin + 1, F.col("char_start") - begin))
    items = lambda c: F.filter(F.transform(F.split(labelled(F.col("head"), F.col(f"l_{c}")), LIST_SPLIT), lambda x: F.trim(x)), lambda x: x != "")
    rows = rows.select("tag", F.instr(F.lit(LETTERS), F.substring("block", 1, 1)).alias("case_no"), *[items(c).alias(c) for c in ("people", "orgs", "places", "keywords")], labelled(F.col("head"), F.col("l_charge")).alias("charge"))
    first_full = lambda *cs: F.coalesce(*[F.when(F.size(c) > 0, c) for c in cs], F.array().cast("array<string>"))
    return rows.select("tag", "case_no", "people", first_full(F.col("orgs"), F.slice("keywords", 1, 3), F.col("people")).alias("orgs"), first_full(F.col("places"), F.slice("keywords", 1, 4), F.col("people")).alias("places"), "charge")


def cyclic(values: Column, i: Column, default: str) -> Column:
    return F.when(F.size(values) > 0, F.get(values, F.pmod(i, F.size(values)))).otherwise(F.lit(default))


def questions(cases: DataFrame, templates: DataFrame, defaults: dict[str, str], suffix: str = "") -> DataFrame:
    """tag, case_no, block_no, question, turn: each template filled from the case. templates: no (0, 1, ...), block_no, text with
    places such as {people:0}; turn is its place after the list is turned by case_no - 1."""
    n = templates.count()
    rows = cases.crossJoin(F.broadcast(templates))  # a fixed list of templates for each case
    text = F.col("text")
    for kind, default in defaults.items():
        for i in range(4):
            text = F.replace(text, F.lit(f"{{{kind}:{i}}}"), cyclic(F.col(kind), F.lit(i), default))
    turn = F.pmod(F.col("no") - F.pmod(F.col("case_no") - 1, F.lit(n)), F.lit(n))
    return rows.select("tag", "case_no", "charge", "block_no", F.concat(text, F.lit(suffix)).alias("question"), turn.alias("turn"))


def first_accepted(rows: DataFrame, per_case: int) -> DataFrame:
    """The first per_case rows of each case by turn, with qid tag-NNN in order of case and turn. rows: only accepted ones."""
    kept = rows.withColumn("made", F.row_number().over(Window.partitionBy("tag", "case_no").orderBy("turn"))).filter(F.col("made") <= per_case)
    seq = F.row_number().over(Window.partitionBy("tag").orderBy("case_no", "made"))
    return kept.withColumn("qid", F.concat("tag", F.lit("-"), F.format_string("%03d", seq))).drop("made")


def told_apart(rows: DataFrame, form: tuple[str, str] = ("", " 혐의 사건의 "), by: tuple[str, ...] = ("tag", "question")) -> DataFrame:
    """Questions that occur twice in a document get the charge of their case before them, if it has one."""
    twice = (F.count("*").over(Window.partitionBy(*by)) > 1) & (F.coalesce("charge", F.lit("")) != "")
    return rows.withColumn("disambiguated", twice).withColumn("question", F.when(twice, F.concat(F.lit(form[0]), "charge", F.lit(form[1]), "question")).otherwise(F.col("question")))


def build_report(rows: DataFrame, statuses: DataFrame) -> DataFrame:
    """Per document: questions, with one and with more gold chunks, mean gold, blocks missing and with too many, questions told apart."""
    made = rows.groupBy("tag").agg(F.count("*").alias("n_questions"), F.count_if(F.size("gold") == 1).alias("n_one"), F.count_if(F.size("gold") >= 2).alias("n_more"), F.avg(F.size("gold")).alias("mean_gold"), F.count_if("disambiguated").alias("n_disambiguated"))
    lost = statuses.groupBy("tag").agg(F.count_if(F.col("status") == "missing").alias("n_missing"), F.count_if(F.col("status") == "too_many").alias("n_too_many"))
    return made.join(lost, "tag", "full").na.fill(0)
