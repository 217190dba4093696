"""Text columns of message logs: entities, notices, white space, names, lines and headers."""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# A transport's notice line in two languages.
NOTICE_LINE = r"(?imud)^[ \t]*(?:\[\d{2}:\d{2}:\d{2}\][ \t]*)?\*\*\*.*?(?:message was not sent|сообщение не было отправлено).*?$\n?"
WHITE = r"(?U)[\s\x1c-\x1f]+"


@F.pandas_udf(StringType())
def _unescape(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: html.unescape(html.unescape(t)) if t is not None else None)


def unescaped(c: Column) -> Column:
    """Character references replaced twice, so that &amp;#39; becomes an apostrophe. Only texts that hold a & leave the JVM."""
    has = c.contains("&")
    return F.when(has, _unescape(F.when(has, c))).otherwise(c)


def without_notices(c: Column, pattern: str = NOTICE_LINE) -> Column:
    return F.regexp_replace(c, pattern, "")


def one_line(c: Column) -> Column:
    """Every run of white space as one blank, none at the ends."""
    return F.trim(F.regexp_replace(c, WHITE, " "))


def clean_body(c: Column) -> Column:
    """Null counts as empty."""
    return one_line(without_notices(unescaped(F.coalesce(c, F.lit("")))))


def nickname(address: Column, tail: str | None = None) -> Column:
    """What stands before the first at-sign; without one, the address without its tail (a pattern that the caller knows), unless nothing is left."""
    strip = lambda c: F.regexp_replace(c, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")
    a = strip(F.regexp_replace(strip(F.coalesce(address, F.lit(""))), ">+$", ""))
    rest = a if tail is None else strip(F.regexp_replace(a, tail, ""))
    return F.when(F.instr(a, "@") > 0, strip(F.substring_index(a, "@", 1))).when(rest == "", a).otherwise(rest)


def is_group_room(sender: Column, receiver: Column, word: str = "conference") -> Column:
    has = lambda c: F.lower(F.coalesce(c, F.lit(""))).contains(word)
    return has(sender) | has(receiver)


def pair_key(a: Column, b: Column) -> Column:
    """The same for both directions: the lesser name first."""
    return F.concat_ws(" | ", F.least(a, b), F.greatest(a, b))


def utterance_prefix(ts: Column, nick: Column) -> Column:
    return F.concat(F.date_format(ts, "HH:mm"), F.lit(" "), nick, F.lit(": "))


def chunk_header(pair: Column, first: Column, last: Column, part: Column, parts: Column) -> Column:
    """Fixed format of a chunk's first line: pair, date or dates, times, and the part if there are several."""
    d0, d1 = F.date_format(first, "yyyy-MM-dd"), F.date_format(last, "yyyy-MM-dd")
    days = F.when(d0 == d1, d0).otherwise(F.concat(d0, F.lit("~"), F.date_format(last, "MM-dd")))
    tail = F.when(parts > 1, F.concat(F.lit(" ("), part, F.lit("/"), parts, F.lit(")"))).otherwise("")
    return F.concat(F.lit("[대화] "), pair, F.lit(" | "), days, F.lit(" "), F.date_format(first, "HH:mm"), F.lit("~"), F.date_format(last, "HH:mm"), tail)


def notice_header(sender: Column, receivers: Column, ts: Column) -> Column:
    return F.concat(F.lit("[공지] "), sender, F.lit(" -> "), F.size(receivers), F.lit("명 | "), F.date_format(ts, "yyyy-MM-dd HH:mm"))


def word_count(c: Column) -> Column:
    """The default token count: runs without white space."""
    return F.size(F.array_remove(F.split(c, WHITE), ""))


def corpus_of(tag: Column) -> Column:
    return F.substring_index(tag, "_", -1)


def question_type(number: Column, name: Column, names: dict[int, str] | None = None) -> Column:
    """'<n> <name>'; null or 0 gives an empty label, a missing name is looked up."""
    known = F.create_map(*[F.lit(x) for kv in (names or {}).items() for x in kv])[number] if names else F.lit(None).cast("string")
    label = F.trim(F.concat_ws(" ", number.cast("string"), F.coalesce(F.nullif(name, F.lit("")), known, F.lit(""))))
    return F.when(F.coalesce(number, F.lit(0)) == 0, "").otherwise(label)


def language_of(tag: Column, prefixes: tuple[str, ...]) -> Column:
    """The longest of the prefixes that the tag begins with, else '?'."""
    out = F.lit("?")
    for p in sorted(prefixes, key=len):
        out = F.when(tag.startswith(p), p).otherwise(out)
    return out


def task_of(tag: Column, part: str, then: str, otherwise: str) -> Column:
    return F.when(tag.contains(part), then).otherwise(otherwise)


def evidence_type(evidence_id: Column, names: dict[int, str]) -> Column:
    """By the number after the first dash, as in A-008; empty if there is none or no name for it."""
    number = F.regexp_extract(F.coalesce(evidence_id, F.lit("")), r"^[^-]*-\s*\+?(\d{1,9})\s*(?:-|$)", 1)
    known = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    return F.coalesce(known[F.nullif(number, F.lit("")).cast("int")], F.lit(""))


def oversize(tokens: Column, limit: int, slack: int = 0) -> Column:
    return F.coalesce(tokens, F.lit(0)) > limit + slack
