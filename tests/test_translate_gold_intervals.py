import json

from hypothesis import given, settings
from hypothesis import strategies as st

from colloquy.operators import detections as D
from colloquy.operators import gold as G
from colloquy.operators import intervals as I
from colloquy.operators import translate as X
from colloquy.plans import jobs as J
from colloquy.sources import tables as S
from colloquy.streaming import incremental


def test_lines(spark):
    text = "[대화] a | b | x: y\n10:46 ann: hi: there\nann: hi\nno colon\nbob: ends\r\n수신: x: y"
    got = X.lines_of(spark.createDataFrame([(1, text)], "id int, text string"), ["id"]).orderBy("line_no").collect()
    assert [(r.kind, r.ts, r.who, r.body) for r in got] == [("raw", None, None, text.split("\n")[0]), ("msg", "10:46", "ann", "hi: there"), ("msg", None, "ann", "hi"), ("raw", None, None, "no colon"), ("msg", None, "bob", "ends\r"), ("raw", None, None, "수신: x: y")]


def test_noise(spark):
    hit = "1.2.3.4 "
    cases = {"": True, "3300": True, ")))": True, "ok": False, (hit * 3).ljust(400, "x") + "x": True, (hit * 3).ljust(400, "x"): False, (hit * 2).ljust(401, "x"): False, "да": False}
    got = spark.createDataFrame([(k,) for k in cases], "body string").withColumn("n", X.is_noise(X.F.col("body"))).collect()
    assert {r.body: r.n for r in got} == cases


def test_answers(spark):
    answers = [(1, "<think>\n1. no\n</think>\n1. a\ncontinued\n2) b", 3), (2, "0. x\nlost\n4. y\nlost\n1. z", 3), (3, "1. a\nmore\n1. b", 3), (4, "text\n\n 2 .  c \n\n d ", 3), (5, "", 1)]
    got = X.parsed_answers(spark.createDataFrame(answers, "id int, answer string, n int"), ["id"]).collect()
    assert {(r.id, r.no): r.text for r in got} == {(1, 1): "a continued", (1, 2): "b", (2, 1): "z", (3, 1): "b", (4, 2): "c d"}


def test_packs(spark):
    bodies = [f"b{k}" for k in range(9)] + ["x" * 301] + ["y" * 200 + str(k) for k in range(7)]
    got = X.packs(spark.createDataFrame([(b,) for b in bodies], "body string"), 1).collect()
    by = {}
    for r in got:
        by.setdefault(r.pack, []).append((r.no, r.body))
    sizes = [len(by[k]) for k in sorted(by)]
    assert sizes == [8, 5, 3, 1] or sum(sizes) == 17
    assert all(len(v) <= 8 and (len(v) == 1 or sum(len(b) for _, b in v) <= 1200) for v in by.values())
    assert all([n for n, _ in sorted(v)] == list(range(1, len(v) + 1)) for v in by.values())


def test_translate_job(spark):
    def make():
        def run(prompts):
            out = []
            for p in prompts:
                lines = p.split("\n")
                lacks = len(lines) > 1
                out.append("\n".join(x.upper() for x in lines if not (lacks and x.endswith("later")) and "never" not in x))
            return out

        return run

    chunks = spark.createDataFrame([(1, "10:00 ann: hello\nbob: 123\nbob: known\nbob: come later"), (2, "ann: hello\nann: never")], "id int, text string")
    cache = spark.createDataFrame([(1, "known", "old"), (2, "known", "NEW")], S.CACHE)
    out, new = J.translate_job(chunks, ["id"], cache, make, shards=1, keep_original=True)
    assert {r.id: r.text for r in out.collect()} == {1: "10:00 ann: HELLO\nbob: 123\nbob: NEW\nbob: COME LATER", 2: "ann: HELLO\nann: never"}
    assert {r.en: r.ko for r in new.collect()} == {"hello": "HELLO", "come later": "COME LATER", "never": "never"}
    assert set(out.columns) == {"id", "text", "text_en"}


def test_a_stored_translation_asks_the_model_once(spark, tmp_path):
    log = str(tmp_path / "asked")

    def make():
        def run(prompts):
            with open(log, "a") as f:
                f.write("x\n" * len(prompts))
            return [p.upper() for p in prompts]

        return run

    chunks = spark.createDataFrame([(1, "ann: hello there"), (2, "ann: good day")], "id int, text string")
    cache = spark.createDataFrame([], S.CACHE)
    out, new = J.translate_job(chunks, ["id"], cache, make, shards=1, store=str(tmp_path / "new"))
    with open(log) as f:
        asked = len(f.readlines())
    assert {r.text for r in out.collect()} == {"ann: HELLO THERE", "ann: GOOD DAY"} and new.count() == 2
    with open(log) as f:
        assert asked == len(f.readlines()) > 0


def test_blocks_and_gold(spark):
    text = "head one two A-001 a b c A-002 d A-001 again XA-003 e"
    docs = spark.createDataFrame([("t", text)], "tag string, text string")
    spans = G.block_spans(docs)
    got = {r.block: (r.char_start, r.char_end) for r in spans.collect()}
    assert got == {"A-001": (text.index("A-001"), text.index("A-002")), "A-002": (text.index("A-002"), len(text))}
    tok = {r.block: (r.tok_start, r.tok_end) for r in G.token_spans(spans, docs).collect()}
    assert tok == {"A-001": (3, 7), "A-002": (7, 13)}
    chunks = spark.createDataFrame([("t", k, 2 * k, 2 * k + 3) for k in range(8)], "tag string, chunk_index int, token_start long, token_end long")
    for bucket in (2, 5, 4096):
        hits = sorted((r.block, r.chunk_index) for r in G.overlapping(G.token_spans(spans, docs), chunks, bucket=bucket).collect())
        assert hits == sorted((b, k) for b, (s, e) in tok.items() for k in range(8) if 2 * k < e and 2 * k + 3 > s)
    status = {r.block: (r.gold, r.status) for r in G.gold(G.token_spans(spans, docs), chunks, most=3).collect()}
    assert status == {"A-001": ([1, 2, 3], "ok"), "A-002": ([3, 4, 5, 6], "too_many")}


def test_profiles_and_questions(spark):
    text = "People: Ann, Bob · Cy\nTerms: k1, k2, k3, k4, k5\nCharge: theft, fraud\nA-001 body B-001 x"
    docs = spark.createDataFrame([("en", text)], "tag string, text string")
    labels = spark.createDataFrame([("en", "People", "Orgs", None, "Terms", "Charge")], "tag string, people string, orgs string, places string, keywords string, charge string")
    cases = G.profiles(docs, G.block_spans(docs), labels)
    a = {r.case_no: r for r in cases.collect()}[1]
    assert (a.people, a.orgs, a.places, a.charge) == (["Ann", "Bob", "Cy"], ["k1", "k2", "k3"], ["k1", "k2", "k3", "k4"], "theft, fraud")
    templates = spark.createDataFrame([(0, 1, "{people:0} and {people:1}"), (1, 2, "{people:3} at {places:0}"), (2, 3, "{orgs:3}")], "no int, block_no int, text string")
    q = G.questions(cases, templates, {"people": "someone", "orgs": "a firm", "places": "a place"}, "?")
    got = {(r.case_no, r.turn): r.question for r in q.collect()}
    assert got[1, 0] == "Ann and Bob?" and got[1, 1] == "Ann at k1?" and got[1, 2] == "k1?" and got[2, 0] == "Ann at k1?" and got[2, 2] == "Ann and Bob?"
    first = G.first_accepted(q, 2).collect()
    assert sorted((r.case_no, r.turn, r.qid) for r in first) == [(1, 0, "en-001"), (1, 1, "en-002"), (2, 0, "en-003"), (2, 1, "en-004")]
    told = G.told_apart(G.first_accepted(q, 2)).filter("disambiguated").collect()
    assert {r.question for r in told} == {"theft, fraud 혐의 사건의 Ann at k1?"}


INTERVALS = [([], 10, [(0, 10)]), ([], 0, []), ([(1, 3), (2, 5), (5, 6)], 10, [(0, 1), (6, 10)]), ([(0.05, 4), (4.05, 9.95)], 10, []), ([(3, 3), ("x", 4)], 10, [(0, 10)])]


def test_complements_by_hand(spark):
    spans = spark.createDataFrame([(k, float(d)) for k, (_, d, _) in enumerate(INTERVALS)], "audio int, duration double")
    rows = spark.createDataFrame([(k, str(a), str(b)) for k, (x, _, _) in enumerate(INTERVALS) for a, b in x], "audio int, start string, end string")
    got = {}
    for r in I.complement(spans, rows, "audio", "duration").collect():
        got.setdefault(r.audio, []).append((r.start, r.end))
    assert {k: sorted(v) for k, v in got.items()} == {k: w for k, (_, _, w) in enumerate(INTERVALS) if w}


@given(st.lists(st.lists(st.tuples(st.integers(0, 50), st.integers(0, 50)), max_size=6), min_size=1, max_size=8))
@settings(max_examples=10, deadline=None)
def test_union_and_complement_tile_the_whole(spark, cases):
    spans = spark.createDataFrame([(k, 50.0) for k in range(len(cases))], "key int, duration double")
    rows = spark.createDataFrame([(k, float(a), float(b)) for k, x in enumerate(cases) for a, b in x] or [(-1, 0.0, 1.0)], "key int, start double, end double")
    parts = I.union(rows, "key").unionByName(I.complement(spans, rows, "key", "duration")).collect()
    for k in range(len(cases)):
        at = 0
        for s, e in sorted((r.start, r.end) for r in parts if r.key == k):
            assert s == at and e > s
            at = e
        assert at == 50


def test_detections(spark):
    full = {"images": [{"shape": [480, 640], "speed": {"preprocess": 1, "inference": 2.5}, "results": [{"name": "a", "confidence": 0.5, "box": {"x1": 1, "y1": 2, "x2": 3, "y2": 4}}, {"confidence": 0.1}]}], "metadata": {"functionTimeCall": 0.01}}
    rows = spark.createDataFrame([(1, json.dumps(full)), (2, '{"images": [{"results": []}], "metadata": {"functionTimeCall": 0.0}}'), (3, "{}")], "id int, j string")
    got = D.detections(rows, ["id"], "j").collect()
    assert [(r.id, r.no, r.name, r.confidence, r.x2) for r in got] == [(1, 0, "a", 50.0, 3.0), (1, 1, "Unknown", 10.0, None), (2, None, None, 0.0, None), (3, None, None, 0.0, None)]
    lat = {r.id: r for r in D.latencies(rows, ["id"], "j").collect()}
    assert (lat[1].n_detections, lat[1].total, lat[1].network) == (2, 3.5, 6.5) and (lat[3].n_detections, lat[3].network) == (0, 0.0)


def test_sources_round_trip(spark, tmp_path):
    raw = tmp_path / "raw.csv"
    raw.write_text('﻿,ts,from,to,body,body_en\n7,2020-06-22 10:46:00.123456,a@h,b@h,"two\nlines, ""q""",NA\n3,2020-06-22 10:47:00,a@h,b@h,,x\n', encoding="utf-8")
    got = {r.src_row: r for r in S.read_raw_messages(spark, str(raw)).collect()}
    assert got[7].body == 'two\nlines, "q"' and got[7].body_en == "NA" and got[7].ts.microsecond == 123456 and got[3].body is None
    clean = spark.createDataFrame([(1, None, "a", "b", "a | b", "x;y", 'q"', "broadcast", ["u", "v"], [1, 2]), (0, None, "a", "b", "a | b", "m\nn", "e", "conversation", [], [])], S.CLEAN)
    S.write_clean_csv(clean, str(tmp_path / "csv"))
    back = {r.src_row: r for r in S.read_clean_csv(spark, str(tmp_path / "csv")).collect()}
    assert back[1].recipients == ["u", "v"] and back[1].merged_rows == [1, 2] and back[0].recipients == [] and back[0].body == "m\nn" and back[1].body_en == 'q"'
    S.write_clean(clean, str(tmp_path / "clean"))
    assert S.read_clean(spark, str(tmp_path / "clean"), "broadcast").count() == 1
    chunks = spark.createDataFrame([(0, 1, "conversation", ["a"], None, None, None, 1, 1, 1, 5, [1], "t", "ru")], S.CHUNK + ", corpus string")
    S.write_chunks(chunks, str(tmp_path / "chunks"))
    S.write_chunk_metadata(chunks, str(tmp_path / "meta"), "ru")
    assert S.read_chunks(spark, str(tmp_path / "chunks")).collect()[0].text == "t"
    assert "text" not in spark.read.json(str(tmp_path / "meta")).columns
    assert S.first_of_each(chunks.withColumn("tag", X.F.lit("t")), 1).count() == 1


def test_questions_old_and_new(spark, tmp_path):
    pair = {"id": "q1", "question": "w?", "q_type": 1, "answer_chunk_indices": [3, 4]}
    (tmp_path / "qa").mkdir()
    (tmp_path / "qa" / "all.json").write_text(json.dumps({"source": "s", "corpora": [{"tag": "j_ru", "corpus": "ru"}, {"tag": "j_en"}], "qa_pairs": [pair]}))
    (tmp_path / "qa" / "law_ko_qa.json").write_text(json.dumps({"qa_pairs": [{"id": "q2", "question": "v?", "answer_chunk_index": 9}]}))
    got = {(r.tag, r.qid): (r.corpus, r.gold, r.vectors) for r in S.read_questions(spark, str(tmp_path / "qa")).collect()}
    assert got == {("j_ru", "q1"): ("ru", [3, 4], "j_ru_embeddings.npz"), ("j_en", "q1"): ("en", [3, 4], "j_en_embeddings.npz"), ("law_ko", "q2"): ("ko", [9], "law_ko_embeddings.npz")}


def test_whole_text_files(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("한글".encode("cp949"))
    (tmp_path / "b.txt").write_text('{"text": " ", "content": "body"}')
    (tmp_path / "c.txt").write_text("{not json")
    got = {r.path.rsplit("/", 1)[1]: r.text for r in S.read_texts(spark, str(tmp_path)).collect()}
    assert got == {"a.txt": "한글", "b.txt": "body", "c.txt": "{not json"}


def test_caches_and_unfinished_parts(spark, tmp_path):
    cache = tmp_path / "cache"
    S.append_cache(spark.createDataFrame([(1, "a", "x")], S.CACHE), str(cache))
    S.append_cache(spark.createDataFrame([(2, "a", "y")], S.CACHE), str(cache))
    (cache / "bad.json").write_text("{broken\n")
    assert [tuple(r) for r in X.latest(S.read_cache(spark, str(cache))).collect()] == [("a", "y")]
    texts = spark.createDataFrame([("m", "t1", 0), ("m", "t2", 0)], "model string, tag string, chunk_index int")
    path = str(tmp_path / "vectors")
    assert incremental.encode_unfinished(spark, texts.filter("tag = 't1'"), path, lambda df: df) == 1
    assert incremental.encode_unfinished(spark, texts, path, lambda df: df) == 1
    assert incremental.encode_unfinished(spark, texts, path, lambda df: df) == 0
    assert S.read_vectors(spark, path, "m").count() == 2
    assert incremental.encode_unfinished(spark, texts.filter("tag = 't2'"), path, lambda df: df, overwrite=True) == 1
    assert S.read_vectors(spark, path).count() == 2


def test_streamed_translations_are_cached_once(spark, tmp_path):
    source = tmp_path / "in"
    spark.createDataFrame([("a",), ("b",), ("a",)], "body string").write.parquet(str(source))
    for _ in range(2):
        stream = spark.readStream.schema("body string").parquet(str(source))
        incremental.translate_arrivals(stream, str(tmp_path / "cache"), str(tmp_path / "cp"), lambda df: df.selectExpr("en", "upper(en) as ko")).awaitTermination()
        spark.createDataFrame([("b",), ("c",)], "body string").write.mode("append").parquet(str(source))
    assert sorted((r.en, r.ko) for r in S.read_cache(spark, str(tmp_path / "cache")).collect()) == [("a", "A"), ("b", "B"), ("c", "C")]


def test_numbers_of_questions_beyond_999(spark):
    rows = spark.range(1005).selectExpr("'t' as tag", "cast(id div 10 as int) as case_no", "cast(id % 10 as int) as turn")
    got = sorted(r.qid for r in G.first_accepted(rows, 10).collect())
    assert got == sorted(f"t-{k:03d}" for k in range(1, 1006))


def test_texts_of_one_model_and_tag_are_encoded_by_many_tasks(spark, tmp_path, monkeypatch):
    """A (model, tag) may be most of the table; no task has it all, and a task's rows have a bound."""
    monkeypatch.setattr(incremental, "TASK_ROWS", 100)
    rows = spark.range(1000).selectExpr("'m' as model", "if(id % 10 = 0, 't2', 't1') as tag", "cast(id as int) as chunk_index", "concat('text ', id) as text")
    path, task = str(tmp_path / "v"), lambda df: df.selectExpr("*", "spark_partition_id() as task")
    assert incremental.encode_unfinished(spark, rows.filter("tag = 't2'"), path, task) == 100
    assert incremental.encode_unfinished(spark, rows, path, task) == 900
    sizes = [r["count"] for r in S.read_vectors(spark, path).filter("tag = 't1'").groupBy("task").count().collect()]
    assert sum(sizes) == 900 and len(sizes) >= 9 and max(sizes) < 250
    assert incremental.encode_unfinished(spark, rows, path, task) == 0
