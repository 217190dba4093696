"""Personal data by anchor expansion (operator 3).

One Aho-Corasick pass over a text finds anchors: at-signs, plus signs, digits, schemes and words that announce an
account. From each anchor a local parser moves to the boundaries of what may stand there and validates it; text
away from anchors is never looked at again. Kinds email, ip, card and phone give the leftmost non-overlapping
matches of the fixed patterns below; url and account are added by the method. Spans are code points, end exclusive.

Defined cases: null or empty text has no spans; digit runs of any length are read once (a part of an address is
compared without leading zeros, not as a number); repeated rows are read each; an empty table gives no rows; extra
columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import frugal, read_table, text_of

# The kinds in their order, what may stand in each, the schemes and the cues.
KINDS = ("email", "ip", "card", "phone", "url", "account")
BASE = KINDS[:4]
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
DIGITS = re.compile(r"[0-9]++")
QUAD = re.compile(r"([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9]([\x20().0-9-]++)")
SCHEMES = ("http://", "https://", "ftp://")
URL = re.compile(r"[^\s\"'<>()\[\]{}|\\^`]++")
URL_TAIL = ".,;:!?*$%&#"
CUES = ("account", "acct", "iban", "passport", "konto", "compte", "cuenta", "customer id", "user id")
ACCOUNT = re.compile(r"(?:\s*+(?:number|no|nr|id)\b\.?)?\s*+[:=#]?\s*+([A-Za-z]{0,4}+[0-9](?:[\x20-]?[A-Za-z0-9])*+)")
IBAN = re.compile(r"[A-Za-z]{2}[0-9]{2}[A-Za-z0-9]{11,30}")
PART = re.compile(r"[A-Za-z0-9]++")
NUMBER = re.compile(r"[A-Za-z0-9-]++(?:\x20[0-9]++(?:-[0-9]++)*+(?!-?[A-Za-z]))*+")  # one run, and groups of digits that follow
LONGEST_ID = 34
IBAN_LENGTHS = {
    **dict.fromkeys(("NO",), 15), **dict.fromkeys(("BE",), 16), **dict.fromkeys(("DK", "FO", "FI", "GL", "NL", "SD", "FK"), 18), **dict.fromkeys(("MK", "SI"), 19),
    **dict.fromkeys(("AT", "BA", "EE", "KZ", "LT", "LU", "XK", "MN"), 20), **dict.fromkeys(("HR", "LV", "LI", "CH"), 21), **dict.fromkeys(("BH", "BG", "CR", "GE", "DE", "IE", "ME", "RS", "GB", "VA"), 22),
    **dict.fromkeys(("TL", "GI", "IQ", "IL", "AE", "OM", "SO"), 23), **dict.fromkeys(("AD", "CZ", "MD", "PK", "RO", "SA", "SK", "ES", "SE", "TN", "VG"), 24), **dict.fromkeys(("PT", "ST", "LY"), 25), **dict.fromkeys(("IS", "TR"), 26),
    **dict.fromkeys(("FR", "GR", "IT", "MC", "MR", "SM", "BI", "DJ"), 27), **dict.fromkeys(("AL", "AZ", "BY", "CY", "DO", "GT", "HU", "LB", "NI", "PL", "SV", "HN"), 28), **dict.fromkeys(("BR", "EG", "PS", "QA", "UA"), 29),
    **dict.fromkeys(("JO", "KW", "MU", "YE"), 30), **dict.fromkeys(("MT", "SC"), 31), "LC": 32, "RU": 33,
}


@cache
def anchors() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for kind, words in (("@", ["@"]), ("+", ["+"]), ("0", list("0123456789")), ("scheme", SCHEMES), ("cue", CUES)):
        for w in {v for word in words for v in (word, word.upper(), word.capitalize())}:
            found.add_word(w, (kind, len(w)))
    found.make_automaton()
    return found


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) << (k & 1)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _iban(value: str) -> bool:
    flat = value.replace(" ", "").replace("-", "").upper()
    return bool(IBAN.fullmatch(flat)) and int("".join(str(int(c, 36)) for c in flat[4:] + flat[:4])) % 97 == 1


def _ends(value: str) -> list[tuple[int, int]]:
    """Letters and digits up to the end of each group, and where it ends, up to LONGEST_ID of them."""
    out, n = [], 0
    for m in PART.finditer(value):
        n += len(m[0])
        if n > LONGEST_ID:
            break
        out.append((n, m.end()))
    return out


def _iban_end(value: str) -> int:
    """Where an IBAN that value begins with ends; 0 without one. It ends with a group: at its country's length, else the last that fits."""
    fixed = IBAN_LENGTHS.get(value[:2].upper())
    return next((end for n, end in reversed(_ends(value)) if n == (fixed or n) and _iban(value[:end])), 0)


def _number_end(value: str) -> int:
    """Where the number that value begins with ends; 0 if it has fewer than five digits or its first run is too long."""
    run = NUMBER.match(value)[0]
    first = len(run.partition(" ")[0])
    end = first if first <= LONGEST_ID else 0
    for n, e in _ends(run):
        if e > first and run[e : e + 1] in ("", " "):
            end = e
    return end if sum("0" <= c <= "9" for c in run[:end]) >= 5 else 0


def _account(text: str, end: int) -> tuple[int, int] | None:
    if end < len(text) and text[end].isalnum() and not text[end].isdigit():
        return None  # the cue is part of a longer word
    m = ACCOUNT.match(text, end)
    if not m:
        return None
    value, start = m[1], m.start(1)
    size = _iban_end(value) or _number_end(value)
    return (start, start + size) if size else None


def spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's number, end), in that order."""
    out: list[tuple[int, int, int]] = []
    done = [0] * len(KINDS)  # where the last match of a kind ended
    for at, (what, size) in anchors().iter(text):
        if what == "0":
            if at >= done[1]:
                m = QUAD.match(text, at)
                done[1] = m.end() if m else DIGITS.match(text, at).end()
                if m and all(len(p := g.lstrip("0")) < 3 or (len(p) == 3 and p <= "255") for g in m.groups()):
                    out.append((at, 1, m.end()))
            if at >= done[2]:
                m = CARD.match(text, at)
                done[2] = m.end() if m else at + 1
                if m and m.end() - at >= 14 and 14 <= len(d := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(d):
                    out.append((at, 2, m.end()))
        elif what == "@":
            start = at
            while start > done[0] and text[start - 1] in LOCAL:
                start -= 1
            if start < at and (m := DOMAIN.match(text, at + 1)):
                done[0] = m.end()
                out.append((start, 0, m.end()))
        elif what == "+":
            m = PHONE.match(text, at)
            rest = m[1].rstrip(" ().-") if m else ""
            if len(rest) >= 2:
                if 10 <= 1 + sum("0" <= c <= "9" for c in rest) <= 15:
                    out.append((at, 3, at + 2 + len(rest)))
        elif what == "scheme":
            start = at - size + 1
            if start >= done[4] and not (start and text[start - 1].isalnum()) and (m := URL.match(text, at + 1)):
                body = m[0].rstrip(URL_TAIL)
                if DOMAIN.match(body.rpartition("@")[2] if "@" in body.partition("/")[0] else body):
                    done[4] = at + 1 + len(body)
                    out.append((start, 4, done[4]))
        elif not (at >= size and text[at - size].isalnum()) and (got := _account(text, at + 1)) and got[0] >= done[5]:
            done[5] = got[1]
            out.append((got[0], 5, got[1]))
    return sorted(out)


def personal_data(docs: DataFrame) -> DataFrame:
    """doc_id, spans (kind, start, end) of every document."""
    kind = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.string()), ("end", pa.int32())]))

    @frugal
    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [[{"start": s, "kind": KINDS[k], "end": e} for s, k, e in spans(t)] if t else [] for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, kind)], ["doc_id", "spans"])

    return docs.select(F.col("doc_id").cast("long"), text_of().alias("text")).mapInArrow(per_batch, "doc_id long, spans array<struct<start int, kind string, end int>>")


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = personal_data(read_table(spark, sf_dir, "documents"))
    only = lambda *kinds: F.filter("spans", lambda s: s.kind.isin(*kinds))
    text = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s.kind, s.start, s.end)), ",")
    counts = [F.size(only(k)).cast("long").alias(f"n_{k}") for k in BASE]
    return found.select("doc_id", *counts, F.sha2(text(only(*BASE)), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"))
