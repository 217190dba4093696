import datetime

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from colloquy.operators import chunks as C
from colloquy.operators import clean as L
from colloquy.operators import sessions as S
from colloquy.plans import jobs as J

RAW = "src_row long, t double, `from` string, `to` string, body string, body_en string"


def raw(spark, rows):
    return spark.createDataFrame(rows, RAW).withColumn("ts", F.timestamp_micros((F.col("t") * 1e6).cast("long"))).drop("t")


def test_cleaning_steps_and_accounting(spark):
    rows = [(1, 100.0, "a@h", "b@h", "hi", "hi"), (2, 100.016, "b@h", "a@h", "hi", "hi"), (3, 109.99, "a@h", "b@h", "edge", "e"), (4, 110.006, "b@h", "a@h", "edge", "e"), (5, 5.0, "room@Conference.h", "a@h", "x", "x"), (6, 6.0, "a@h", "b@h", " ", "x"), (7, 7.0, "a@h", "b@h", None, "x")]
    rows += [(10 + k, 1000.0 + 600 * k, "boss@h", f"u{k}@h", "meeting", "meeting") for k in range(5)]
    rows += [(20 + k, 1000.0 + k, "boss@h", f"u{k}@h", "four only", "f") for k in range(4)]
    rows += [(30 + k, 1000.0 + 600.000001 * k, "boss@h", f"u{k}@h", "apart", "f") for k in range(5)]
    flags = L.flagged(raw(spark, rows))
    n = L.accounting(flags).first()
    assert n.asDict() == dict(n_input=len(rows), n_room=1, n_empty=2, n_mirrored=1, n_folded=4, n_conversation=3 + 4 + 5, n_broadcast=1)
    clean = {r.src_row: r for r in L.clean(raw(spark, rows)).collect()}
    assert clean[10].kind == "broadcast" and clean[10].recipients == [f"u{k}" for k in range(5)] and clean[10].merged_rows == [10, 11, 12, 13, 14]
    assert 2 not in clean and {3, 4} <= clean.keys() and clean[20].recipients == []
    assert clean[1].dyad == "a | b"


def test_sessions(spark):
    rows = [(1, 0.0), (2, 3600.0), (3, 7200.000001), (4, 7201.0)]
    df = spark.createDataFrame([(k, t, "x | y") for k, t in rows] + [(9, 50.0, "a | b")], "src_row long, t double, dyad string").withColumn("ts", F.timestamp_micros((F.col("t") * 1e6).cast("long")))
    got = S.sessions(df)
    assert {r.src_row: r.sid for r in got.collect()} == {9: 1, 1: 2, 2: 2, 3: 3, 4: 3}
    assert S.mixed_sessions(got).count() == 0
    r = S.session_report(got).first()
    assert (r.n_sessions, r.median_messages, r.max_messages) == (3, 2, 2)


@pytest.mark.parametrize("tokens, spans", [([100, 200, 100], [(0, 3)]), ([300, 100, 100, 300], [(0, 2), (1, 3), (2, 4)]), ([200, 200, 150, 200], [(0, 2), (1, 3), (2, 4)]), ([470, 20, 20], [(0, 1), (1, 3)]), ([600, 10], [(0, 1), (1, 2)]), ([], [])])
def test_spans_by_hand(tokens, spans):
    assert C.plan_spans(np.array(tokens, dtype=int), 480, 128) == spans


@given(st.lists(st.integers(0, 700), max_size=40), st.integers(1, 500), st.integers(0, 200))
@settings(max_examples=300, deadline=None)
def test_spans_cover_everything_and_advance(tokens, budget, overlap):
    spans = C.plan_spans(np.array(tokens, dtype=int), budget, overlap)
    assert sorted({i for a, b in spans for i in range(a, b)}) == list(range(len(tokens)))
    assert all(b - a == 1 or sum(tokens[a:b]) <= budget for a, b in spans)
    assert all(c > a and d >= b and c <= b for (a, b), (c, d) in zip(spans, spans[1:]))


def test_chunks_of_two_languages_share_their_cuts(spark):
    rows = [(k, 60.0 * k, "a@h", "b@h", " ".join(f"r{k}w{i}" for i in range(20)), " ".join(f"e{i}" for i in range(15 + k % 3))) for k in range(12)]
    rows += [(50, 900000.0, "b@h", "a@h", " ".join(f"long{i}" for i in range(150)), " ".join(f"big{i}" for i in range(140)))]
    rows += [(60 + k, 2e6 + k, "boss@h", f"u{k}@h", "all hands", "all hands") for k in range(6)]
    chunks = J.chunk_job(L.clean(raw(spark, rows)), size=112, overlap=30)
    got = {(r.corpus, r.chunk_index): r for r in chunks.collect()}
    assert C.uneven_corpora(chunks).count() == 0
    n = len(got) // 2
    assert sorted(got) == [(c, k) for c in ("en", "ru") for k in range(n)]
    for k in range(n):
        ru, en = got["ru", k], got["en", k]
        assert (ru.src_rows, ru.part, ru.n_parts, ru.session_id) == (en.src_rows, en.part, en.n_parts, en.session_id)
    assert all(r.n_tokens <= 112 for r in got.values() if r.corpus == "en" and r.kind == "conversation")
    last = got["ru", n - 1]
    assert last.kind == "broadcast" and last.session_id == -1 and last.participants == ["boss"] and last.n_messages == 6
    assert last.text == "[공지] boss -> 6명 | 1970-01-24 03:33\n수신: u0, u1, u2, u3, u4, u5\nboss: all hands"
    assert {i for r in got.values() for i in r.src_rows} == {r[0] for r in rows}
    first = got["ru", 0].text.split("\n")
    assert first[0].startswith("[대화] a | b | 1970-01-01 00:00~") and first[1].startswith("00:00 a: r0w0 ")
    with pytest.raises(ValueError):
        J.chunk_job(L.clean(raw(spark, rows)), size=64, overlap=64)
    each = J.chunk_job(L.clean(raw(spark, rows)), size=112, overlap=30, basis="each")
    assert {r.corpus for r in each.collect()} == {"ru", "en"}
    report = {r.corpus: r for r in C.chunk_report(chunks, 112).collect()}
    assert report["en"].n_broadcast == 1 and report["en"].n_over == 0


@given(st.integers(0, 60), st.integers(1, 12), st.integers(0, 11))
@settings(max_examples=20, deadline=None)
def test_sliding_windows(spark, n, size, overlap):
    if overlap >= size:
        return
    words = [f"w{i}" for i in range(n)]
    got = C.sliding_windows(spark.createDataFrame([(" ".join(words),)], "text string"), F.array_remove(F.split("text", " "), ""), size, overlap).orderBy("chunk_index").collect()
    want, start = [], 0
    while start < n:
        want.append((start, min(n, start + size)))
        if start + size >= n:
            break
        start += size - overlap
    assert [(r.token_start, r.token_end) for r in got] == want
    assert all(r.chunk.split() == words[r.token_start : r.token_end] for r in got)


def test_clean_job_from_one_stored_pass(spark, tmp_path):
    from colloquy.plans import jobs as J

    raw = spark.createDataFrame([(k, k * 100, "ann@x", f"b{k % 3}@x", f"body {k}", f"text {k}") for k in range(9)], "src_row long, t long, from string, to string, body string, body_en string")
    raw = raw.selectExpr("src_row", "timestamp_seconds(t) as ts", "`from`", "`to`", "body", "body_en")
    plain, counts = J.clean_job(raw)
    stored, stored_counts = J.clean_job(raw, str(tmp_path / "flags"))
    assert sorted(map(str, plain.collect())) == sorted(map(str, stored.collect()))
    assert counts.collect() == stored_counts.collect()


def test_lists_of_notices_are_shown_once_a_run(spark):
    """Each row of a run takes its run's lists; what is made of them is made before that, not again for each row."""
    rows = [(i, datetime.datetime(2020, 1, 1, 10, 0, i), "boss", f"r{i % 6}") for i in range(12)] + [(50, datetime.datetime(2020, 1, 2), "ann", "bob")]
    df = spark.createDataFrame(rows, "src_row long, ts timestamp, sender string, receiver string")
    got = L.folded_notices(df, ["sender"], "receiver", "ts", "src_row", 600, shown=lambda c: F.array_join(c.cast("array<string>"), ";"))
    plain = {r.src_row: r for r in L.folded_notices(df, ["sender"], "receiver", "ts", "src_row", 600).collect()}
    for r in got.collect():
        was = plain[r.src_row]
        assert (r.kind, r.folded, r.recipients, r.merged_rows) == (was.kind, was.folded, ";".join(was.recipients), ";".join(map(str, was.merged_rows)))
    assert plain[3].merged_rows == list(range(12)) and plain[50].merged_rows == []


def test_rows_with_the_lists_of_their_run_are_dealt_by_bytes(spark, monkeypatch):
    """A run's rows times its list are far more than was read; all rows of a run went to one task, and many long runs to one, whose writer held them."""
    at = datetime.datetime(2020, 1, 1)
    rows = [(i, at + datetime.timedelta(seconds=i), f"boss{i % 3}", f"r{i // 3 % 6}") for i in range(1200)] + [(5000 + i, at + datetime.timedelta(seconds=i), "ann", "bob") for i in range(300)]
    df = spark.createDataFrame(rows, "src_row long, ts timestamp, sender string, receiver string")
    fold = lambda: L.folded_notices(df, ["sender"], "receiver", "ts", "src_row", 600, shown=lambda c: F.array_join(c.cast("array<string>"), ";"))
    want = sorted(fold().collect())
    monkeypatch.setattr(L, "PART_BYTES", 50_000, raising=False)
    got = fold().withColumn("task", F.spark_partition_id()).collect()
    assert sorted(r[:-1] for r in got) == sorted(tuple(r) for r in want)
    size = dict.fromkeys((r.task for r in got), 0)
    for r in got:
        size[r.task] += len(r.merged_rows)
    assert sum(size.values()) > 30 * 50_000 and max(size.values()) < 8 * 50_000


def test_long_sessions_are_planned_by_many_tasks(spark):
    """Their counts are few bytes, so that adaptive execution would put them all into one task; sessions may cross batches of rows."""
    rnd = np.random.default_rng(5)
    rows = [(f"s{s}", p, int(rnd.integers(0, 50))) for s in range(300) for p in range(1, 30 + s % 5)] + [("long", p, 7) for p in range(3000)] + [("none", 1, None), ("none", 2, 500), ("none", 3, 500)]
    items = spark.createDataFrame(rows, "key string, pos long, n int").repartition(3)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 64)
    try:
        plan = C.planned(items, "key", "pos", "n", 100, 20)
        got = sorted(r[:5] for r in plan.collect())
        tasks = plan.withColumn("task", F.spark_partition_id()).filter("n_parts > 1").agg(F.count_distinct("task")).first()[0]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = []
    for k in {r[0] for r in rows}:
        mine = sorted((p, n or 0) for key, p, n in rows if key == k)
        spans = C.plan_spans(np.array([n for _, n in mine]), 100, 20)
        want += [(k, i + 1, len(spans), mine[a][0], mine[b - 1][0]) for i, (a, b) in enumerate(spans)]
    assert got == sorted(want) and tasks > 8
