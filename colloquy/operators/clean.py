"""From raw two-language messages to one clean row per message, with mass-sent notices folded."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy.functions import text as T
from colloquy.sources.scratch import stored

from . import scan
from .joins import row_bytes, sized_join, text_key

MIRROR_SECONDS = 10
NOTICE_GAP_SECONDS = 600
NOTICE_RECEIVERS = 5
PART_BYTES = 128 << 20  # of the lists that rows take, in one part of them


def micros(ts: Column) -> Column:
    """Microseconds since 1970, of timestamps with or without a time zone (the session's is UTC)."""
    return F.unix_micros(ts.cast("timestamp"))


def seconds_between(later: Column, earlier: Column) -> Column:
    return (micros(later) - micros(earlier)) / 1e6


def _keyed(df: DataFrame, keys: list[str], text: str | None) -> tuple[DataFrame, list[str]]:
    """df, and the columns to deal it by: a text goes by its key; scans compare the texts themselves besides."""
    if text is None:
        return df, keys
    return df.withColumn("__body", text_key(F.col(text))), [*keys, "__body"]


def first_of_mirrored(df: DataFrame, keys: list[str], ts: str, order: str, seconds: int = MIRROR_SECONDS, text: str | None = None) -> DataFrame:
    """df with `mirrored`: another row of the same keys, and the same text if one is named, came before it, by `order`, in the same
    bucket of time. A scan over all rows in order of keys, bucket and `order`."""
    rows, by = _keyed(df, keys, text)
    rows = scan.in_order(rows.withColumn("__bucket", F.floor(micros(F.col(ts)) / (seconds * 1_000_000))), [*by, "__bucket", order], "mirrored")
    got = scan.begun(rows, F.struct(*by, "__bucket"), lambda now, was: ~now.eqNullSafe(was), "__new", text=text)
    return got.withColumn("mirrored", ~F.col("__new")).select(*df.columns, "mirrored")


def with_runs(df: DataFrame, keys: list[str], ts: str, order: str, gap_seconds: float, text: str | None = None) -> DataFrame:
    """df with `run`: 1, 2, ... over all rows in order of keys and time; another key, or a gap above gap_seconds, begins a new one; and
    `begins`, whether a row is the first of its run. A key with a third of all rows is spread like any other."""
    rows, by = _keyed(df, keys, text)
    rows = scan.in_order(rows, [*by, ts, order], "runs")

    def begins(now: Column, was: Column) -> Column:
        same = now.keys.eqNullSafe(was.keys)
        return ~same | F.coalesce((now.at - was.at) / 1e6 > gap_seconds, F.lit(True))

    got = scan.begun(rows, F.struct(F.struct(*by).alias("keys"), micros(F.col(ts)).alias("at")), begins, "begins", text=text)
    return got.select(*df.columns, F.col("begins_no").alias("run"), "begins")


def _with_lists(runs: DataFrame, per: DataFrame) -> DataFrame:
    """runs with the lists of their run, null where it has none. per: run, n (its rows) and its lists. All rows of a run take its lists, so they become far
    more than was read. They are dealt by that: a run's rows over as many slots as have PART_BYTES of lists each, and a slot's rows lie together, since
    writers hold many rows and keep a value once only where it stands in a row."""
    size = F.col("n") * row_bytes(per.drop("n"))
    total = per.agg(F.sum(size)).first()[0] or 0
    if total <= PART_BYTES:
        return sized_join(runs, per.drop("n"), ["run"], "left")
    parts = max(-(-total // PART_BYTES), int(runs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    slots = stored(per.select("run", F.ceil(size / PART_BYTES).alias("__slots")), "slots")
    place = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.coalesce("__slots", F.lit(parts)))
    rows = sized_join(runs, slots, ["run"], "left").withColumn("__slot", place).drop("__slots")
    copies = per.drop("n").join(slots, "run").withColumn("__slot", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__slots") - 1))).drop("__slots")
    by = ["run", "__slot"]
    return rows.repartition(parts, *by).join(copies.repartition(parts, *by).hint("merge"), by, "left").drop("__slot")


def folded_notices(df: DataFrame, keys: list[str], receiver: str, ts: str, order: str, gap_seconds: float = NOTICE_GAP_SECONDS, least: int = NOTICE_RECEIVERS, text: str | None = None, shown: Callable[[Column], Column] = lambda c: c) -> DataFrame:
    """df with kind, recipients, merged_rows and `folded`: in a run that reaches `least` receivers all rows but the earliest fold into it.
    shown: what rows have of the two lists; it is made once for each run, since each row of a run takes its whole lists."""
    runs = stored(with_runs(df, keys, ts, order, gap_seconds, text), "notice-runs")
    many = runs.groupBy("run").agg(F.count_distinct(receiver).alias("n")).filter(F.col("n") >= least).select("run")
    lists = runs.join(many, "run", "left_semi").groupBy("run").agg(F.count("*").alias("n"), F.array_sort(F.collect_set(receiver)).alias("recipients"), F.array_sort(F.collect_list(order)).alias("merged_rows"))
    per = stored(lists.select("run", "n", shown(F.col("recipients")).alias("recipients"), shown(F.col("merged_rows")).alias("merged_rows")), "notices")
    rows = _with_lists(runs, per)
    mass = F.col("recipients").isNotNull()
    none = lambda c, kind: F.coalesce(c, shown(F.array().cast(kind)))
    return rows.select(
        *df.columns,
        F.when(mass, "broadcast").otherwise("conversation").alias("kind"),
        none("recipients", "array<string>").alias("recipients"),
        none("merged_rows", "array<bigint>").alias("merged_rows"),
        (mass & ~F.col("begins")).alias("folded"),
    )


def prepared(raw: DataFrame, tail: str | None = None) -> DataFrame:
    """raw: src_row, ts, from, to, body, body_en. One projection: clean bodies, names, pair, and why a row goes. tail: of addresses without an at-sign."""
    name = lambda c: T.nickname(F.col(c), tail)
    rows = raw.select("src_row", "ts", name("from").alias("nick_from"), name("to").alias("nick_to"), T.clean_body(F.col("body")).alias("body"), T.clean_body(F.col("body_en")).alias("body_en"), T.is_group_room(F.col("from"), F.col("to")).alias("room"))
    empty = (F.col("body") == "") | (F.col("body_en") == "")
    return rows.withColumn("dyad", T.pair_key(F.col("nick_from"), F.col("nick_to"))).withColumn("step", F.when(F.col("room"), "room").when(empty, "empty").otherwise("kept")).drop("room")


def flagged(raw: DataFrame, tail: str | None = None) -> DataFrame:
    """Every row with its step: room, empty, mirrored, folded or kept; later steps see only what earlier ones kept. The input is
    read and decoded once, into a table."""
    rows = stored(prepared(raw, tail), "prepared")
    live = stored(first_of_mirrored(rows.filter("step = 'kept'"), ["dyad"], "ts", "src_row", text="body"), "live")
    notices = folded_notices(live.filter(~F.col("mirrored")).drop("mirrored"), ["nick_from"], "nick_to", "ts", "src_row", text="body")
    notices = notices.withColumn("step", F.when(F.col("folded"), "folded").otherwise("kept")).drop("folded")
    gone = rows.filter("step <> 'kept'").unionByName(live.filter("mirrored").withColumn("step", F.lit("mirrored")).drop("mirrored"))
    return notices.unionByName(gone, allowMissingColumns=True)


def clean(raw: DataFrame, tail: str | None = None) -> DataFrame:
    return kept(flagged(raw, tail))


def kept(flags: DataFrame) -> DataFrame:
    """The clean messages among flagged rows."""
    rows = flags.filter("step = 'kept'")
    return rows.select("src_row", "ts", "nick_from", "nick_to", "dyad", "body", "body_en", "kind", "recipients", "merged_rows")


def counts() -> list[Column]:
    """How many flagged rows each step took and what is left."""
    step, kind = F.col("step"), F.col("kind")
    took = [F.count_if(step == s).alias(f"n_{s}") for s in ("room", "empty", "mirrored", "folded")]
    return [F.count(F.lit(1)).alias("n_input"), *took, *(F.count_if((step == "kept") & (kind == k)).alias(f"n_{k}") for k in ("conversation", "broadcast"))]


def accounting(flags: DataFrame) -> DataFrame:
    """One row: how many rows each step took and what is left."""
    return flags.agg(*counts())


def profile(raw: DataFrame, sender: str = "from", receiver: str = "to") -> DataFrame:
    """Messages, distinct accounts and distinct pairs."""
    accounts = raw.select(F.explode(F.array(sender, receiver)).alias("account")).agg(F.count_distinct("account").alias("n_accounts"))
    return raw.agg(F.count("*").alias("n_messages"), F.count_distinct(T.pair_key(F.col(sender), F.col(receiver))).alias("n_pairs")).crossJoin(accounts)
