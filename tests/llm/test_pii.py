import hashlib
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from colloquy.llm import pii

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def brute(text):
    out = []
    for k, (kind, p) in enumerate(PATTERNS.items()):
        for m in re.finditer(p, text or ""):
            digits = re.sub(r"[^0-9]", "", m[0])
            ok = {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else False, "card": 14 <= len(digits) <= 19 and pii.luhn(digits), "phone": 10 <= len(digits) <= 15}[kind]
            if ok:
                out.append((m.start(), k, m.end()))
    return sorted(out)


def base(text):
    return [s for s in pii.spans(text) if s[1] < 4]


@given(st.text(alphabet=st.sampled_from("a@.+-_% 0123456789()é"), max_size=60))
@settings(max_examples=1500, deadline=None)
def test_base_spans_are_those_of_the_patterns(text):
    assert base(text) == brute(text)


@given(st.lists(st.sampled_from(["4111 1111-1111 1111", "1.2.3.4", "300.1.1.1", "+1 (743) 555-3824", "a.b@c.example", "@", ".", "5.6", " ", "4785380592391139", "+", "x"]), max_size=12))
@settings(max_examples=500, deadline=None)
def test_base_spans_of_pieces_put_together(parts):
    text = "".join(parts)
    assert base(text) == brute(text)


def test_added_spans():
    text = "see https://a.example/x?y=1. Account number: 12345678 or IBAN DE89 3704 0044 0532 0130 00, accounting 55555"
    got = [(pii.KINDS[k], text[s:e]) for s, k, e in pii.spans(text) if k >= 4]
    assert got == [("url", "https://a.example/x?y=1"), ("account", "12345678"), ("account", "DE89 3704 0044 0532 0130 00")]
    assert pii.spans("my account of 3 days is on no list, no user id here") == []


def test_query_rows(spark, tiny):
    import duckdb

    want = {r[0]: r[1] for r in duckdb.sql(f"SELECT doc_id, text FROM '{tiny}/documents.parquet'").fetchall()}
    got = pii.op3_pii(spark, tiny).collect()
    assert len(got) == len(want)
    for r in got:
        spans = brute(want[r.doc_id])
        joined = ",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in spans)
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[1] == k for s in spans) for k in range(4)]


def test_nulls_long_texts_and_empty_tables(spark):
    rows = [(1, None), (None, ""), (2, "9" * 300_000), (3, "1." * 100_000), (3, "x@y.z " * 20_000)]
    got = pii.personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert [len(r.spans) for r in sorted(got, key=lambda r: len(r.spans))] == [0, 0, 0, 20_000, 25_000]
    assert pii.personal_data(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_grouped_accounts_before_other_words():
    def account(text):
        return [text[s:e] for s, k, e in pii.spans(text) if pii.KINDS[k] == "account"]

    assert account("iban: DE89 3704 0044 0532 0130 00 was used") == ["DE89 3704 0044 0532 0130 00"]
    assert account("my IBAN GB29 NWBK 6016 1331 9268 19 and then some words") == ["GB29 NWBK 6016 1331 9268 19"]
    assert account("IBAN DE89370400440532013000 is 5 years old") == ["DE89370400440532013000"]
    assert account("iban NO93 8601 1117 947 12 days") == ["NO93 8601 1117 947"]
    assert account("account number 1234 5678 90 was closed") == ["1234 5678 90"]
    assert account("account 12-34 56-78 90") == ["12-34 56-78 90"]
    assert account("account 12345678 was closed 3 days ago") == ["12345678"]
    assert account("account number 1234 was closed") == []
    assert account("account " + "1" * 35 + " 22222") == []
    assert account("account " + "1234 " * 20) == [("1234 " * 8).strip()]
