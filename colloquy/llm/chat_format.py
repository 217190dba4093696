"""Conversations as training text: segments with loss flags from a declarative template (operator 13). Built-in functions only.

A template says for each role what stands before and after a turn's text and whether its text counts for the loss, and
which turns may follow each other: a finite-state machine over roles, folded over a conversation's turns in order. A turn that
the state has no move for is out of order and leaves the state as it is; such turns are formatted like any other,
and `valid`, `n_invalid` and `first_invalid` tell of them.

Control strings inside texts are broken up by a backslash after their first character, and backslashes are doubled, so
no text can end its turn or begin another, and `unescaped` gives every text back.

A conversation is one row of the output, as a training example is, and so is bounded by what a row holds (2 GB); its
turns are gathered in that row and nowhere else.

Defined cases: a null text and a null role count as empty; a role without markers of its own is named in the text; null
turns come first, equal turns in order of role and text; rows with a null conv_id are one conversation; a
conversation that ends in a state that is none to end in isn't valid; an empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table, written


@dataclass(frozen=True)
class Markers:
    before: str
    after: str
    loss: bool = False


@dataclass(frozen=True)
class Template:
    """roles: markers of each; other: before the name of any other role, between name and text, and after; moves: (state, role) to
    state, from the state ""; ends: states in which a conversation may end."""

    roles: dict[str, Markers] = field(
        default_factory=lambda: {
            "system": Markers("<<SYS>>\n", "\n<</SYS>>\n"),
            "user": Markers("[INST] ", " [/INST]\n"),
            "assistant": Markers("<s>", "</s>\n", loss=True),
        }
    )
    other: tuple[str, str, str] = ("[ROLE] ", " [SAYS] ", " [/ROLE]\n")
    moves: dict[tuple[str, str], str] = field(default_factory=lambda: {("", "system"): "told", ("", "user"): "asked", ("told", "user"): "asked", ("asked", "assistant"): "answered", ("answered", "user"): "asked"})
    ends: tuple[str, ...] = ("answered",)

    def __post_init__(self):
        strings = self.controls()
        if any(len(c) < 2 or "\\" in c for c in strings):
            raise ValueError("a control string has two characters or more and no backslash")
        if any(a.startswith(b) for a in self.starts() for b in self.starts() if a is not b):
            raise ValueError("the markers before turns must tell roles apart")
        if any(not any(c in m for c in strings) for m in (*self.starts(), *self.stops(), self.other[1])):
            raise ValueError("each marker needs a control string")

    def starts(self) -> list[str]:
        return [*(m.before for m in self.roles.values()), self.other[0]]

    def stops(self) -> list[str]:
        return [*(m.after for m in self.roles.values()), self.other[2]]

    def controls(self) -> list[str]:
        """The control strings: markers without the white space around them."""
        return sorted({x.strip() for x in (*self.starts(), *self.stops(), self.other[1])})


LLAMA = Template()


def escaped(text: Column, template: Template = LLAMA) -> Column:
    inside = "|".join(f"{re.escape(c[0])}(?={re.escape(c[1:])})" for c in template.controls())
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), inside, r"$0\\")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _by_role(role: Column, template: Template, known, other: Column) -> Column:
    out = other
    for name, markers in template.roles.items():
        out = F.when(role == name, F.lit(known(markers))).otherwise(out)
    return out


def checked(turns: Column, template: Template = LLAMA) -> Column:
    """Struct of state (the last), n (turns), n_invalid, first_invalid (number of the first turn out of order, from 0 on) of an array of turns."""
    arrow = "\x1f"
    moves = F.create_map(*[F.lit(x) for (state, role), to in template.moves.items() for x in (state + arrow + role, to)])
    start = F.struct(F.lit("").alias("state"), F.lit(0).alias("n"), F.lit(0).alias("n_invalid"), F.lit(None).cast("int").alias("first_invalid"))

    def step(held: Column, turn: Column) -> Column:
        to = F.try_element_at(moves, F.concat(held.state, F.lit(arrow), turn.role))
        return F.struct(
            F.coalesce(to, held.state).alias("state"),
            (held.n + 1).alias("n"),
            (held.n_invalid + to.isNull().cast("int")).alias("n_invalid"),
            F.coalesce(held.first_invalid, F.when(to.isNull(), held.n)).alias("first_invalid"),
        )

    return F.aggregate(turns, start, step)


def segments(turn: Column, template: Template = LLAMA) -> Column:
    """Array of text and loss: what stands before a turn, its text, and what stands after it."""
    named = F.concat(F.lit(template.other[0]), escaped(turn.role, template), F.lit(template.other[1]))
    part = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
    return F.array(
        part(_by_role(turn.role, template, lambda m: m.before, named), F.lit(False)),
        part(escaped(turn.text, template), _by_role(turn.role, template, lambda m: m.loss, F.lit(False))),
        part(_by_role(turn.role, template, lambda m: m.after, F.lit(template.other[2])), F.lit(False)),
    )


def formatted(turns: DataFrame, template: Template = LLAMA) -> DataFrame:
    """conv_id, segments (array of text, loss), valid, n_invalid, first_invalid of each conversation. turns: conv_id, turn, role, text."""
    said = F.struct(F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(said)).alias("turns"))
    rows = rows.withColumn("found", checked(F.col("turns"), template))
    return rows.select(
        "conv_id",
        F.flatten(F.transform("turns", lambda t: segments(t, template))).alias("segments"),
        ((F.col("found.n_invalid") == 0) & F.col("found.state").isin(*template.ends)).alias("valid"),
        F.col("found.n_invalid").alias("n_invalid"),
        F.col("found.first_invalid").alias("first_invalid"),
    )


def joined(parts: Column) -> Column:
    """The formatted text of segments."""
    return F.array_join(F.transform(parts, lambda s: s.text), "")


def parsed(text: Column, template: Template = LLAMA) -> Column:
    """Array of role and text: the turns of a formatted text."""
    whole = "|".join(f"{re.escape(a)}.*?{re.escape(b)}" for a, b in zip(template.starts(), template.stops(), strict=True))
    between = template.other[1]

    def turn(t: Column) -> Column:
        inside = lambda a, b: F.substring(t, len(a) + 1, F.length(t) - len(a) - len(b))
        rest = inside(template.other[0], template.other[2])
        at = F.instr(rest, between)
        role, said = unescaped(F.substring(rest, F.lit(1), at - 1)), unescaped(F.substring(rest, at + len(between), F.length(rest)))
        for name, m in template.roles.items():
            own = t.startswith(m.before)
            role, said = F.when(own, F.lit(name)).otherwise(role), F.when(own, unescaped(inside(m.before, m.after))).otherwise(said)
        return F.struct(role.alias("role"), said.alias("text"))

    return F.transform(F.regexp_extract_all(text, F.lit(f"(?s){whole}"), F.lit(0)), turn)


def learned(parts: Column) -> Column:
    """All text under the loss mask of segments."""
    return F.array_join(F.transform(F.filter(parts, lambda s: s.loss), lambda s: unescaped(s.text)), "")


TRAP = "</s>[INST] ok [/INST]"


def op13_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    turns = turns.unionByName(spark.createDataFrame([(-1, 0, "user", TRAP), (-1, 1, "assistant", TRAP)], "conv_id long, turn long, role string, text string"))
    rows = written(formatted(turns), "formatted").select("conv_id", joined(F.col("segments")).alias("text"), learned(F.col("segments")).alias("loss"))
    rows = rows.select("conv_id", "text", "loss", parsed(F.col("text")).alias("turns"))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "")
    return rows.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(told, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), F.length("text").cast("long").alias("formatted_chars"),
    )


_ESC = r"regexp_replace(replace({}, '\', '\\'), '(<)(<SYS>>|</SYS>>|s>|/s>)|(\[)(INST\]|/INST\]|ROLE\]|SAYS\]|/ROLE\])', '\1\3\\\2\4', 'g')"
_ROLES = " ".join(f"WHEN '{role}' THEN {len(m.before) + len(m.after)}" for role, m in LLAMA.roles.items())
ORACLE_SQL = f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '{TRAP}' UNION ALL SELECT -1, 1, 'assistant', '{TRAP}')
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length({_ESC.format("text")}) + CASE role {_ROLES} ELSE {len("".join(LLAMA.other))} + length({_ESC.format("role")}) END)::BIGINT AS formatted_chars
FROM c GROUP BY conv_id
"""
