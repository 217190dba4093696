import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from colloquy.operators import encode as E
from colloquy.operators import evaluate as V
from colloquy.operators import retrieve as R
from colloquy.plans import jobs as J
from colloquy.sources import tables as S

CASES = [
    ([7, 3, 9], [7], 0, 1, 1.0),
    ([1, 2, 4, 7], [7], 0, 4, 1.0),
    ([1, 7], [7, 8], 0, 2, 0.5),
    ([1, 7], [7, 8], 1, 2, 1.0),
    ([-1, -1, 7], [7], 0, 3, 1.0),
    ([1, 2], [7], 0, 0, 0.0),
    ([7], [7, 7], 0, 1, 1.0),
]


@pytest.mark.parametrize("ranked, gold, tolerance, rank, recall5", CASES)
def test_metrics_by_hand(spark, ranked, gold, tolerance, rank, recall5):
    top = [("other" if c < 0 else "d", 7 if c < 0 else c, 0.0) for c in ranked]
    row = spark.createDataFrame([("q", "d", gold, top)], "qid string, tag string, gold array<int>, top array<struct<tag string, chunk_index int, score double>>")
    r = V.query_metrics(row, tolerance).first()
    assert (r.rank, r["recall@5"], r["hit@5"]) == (rank, recall5, float(0 < rank <= 5))
    assert r["mrr@10"] == pytest.approx(1 / rank if rank else 0) and r["ndcg@10"] == pytest.approx(1 / math.log2(rank + 1) if rank else 0)
    assert V.query_metrics(row, tolerance, coverage=False).first()["recall@5"] == r["hit@5"]


def test_roll_up_parents_are_means_of_children(spark):
    rows = [(f"d_{c}", c, q, 1.0 * (k % 3 == 0)) for c in ("ru", "en", "ko") for q in ("1 a", "2 b", "") for k in range(4)]
    df = spark.createDataFrame(rows, "tag string, corpus string, qtype string, m double").withColumn("config", F.lit("x"))
    for m in V.METRICS:
        df = df.withColumn(m, F.col("m"))
    got = {(r.group_kind, r.document): r for r in V.roll_up(df).collect()}
    assert got["overall", "ALL"].n_queries == 36 and got["overall", "ALL(한국어)"].n_queries == 12
    assert got["q_type", "QTYPE(1 a)"].n_queries == 12 and ("q_type", "QTYPE()") not in got
    assert got["document_q_type", "d_ru / 1 a"].n_queries == 4
    assert got["document", "d_ru"]["hit@5"] == pytest.approx(0.5)


def test_pools_and_hybrid_scores(spark):
    chunks = spark.createDataFrame([("a", 0, [1.0, 0.0], ["x"], [1.0], "answer"), ("a", 1, [0.0, 1.0], ["y"], [1.0], "answer"), ("b", 0, [0.6, 0.8], ["x", "y"], [0.5, 2.0], "evidence")], "tag string, chunk_index int, embedding array<double>, tokens array<string>, weights array<double>, task string")
    questions = spark.createDataFrame([("q1", "a", [1.0, 0.0], ["y"], [1.0], "answer"), ("q2", "b", [0.0, 1.0], ["z"], [1.0], "evidence")], "qid string, tag string, embedding array<double>, tokens array<string>, weights array<double>, task string")

    def top(scope, mode, k=2):
        got = R.top_k(R.question_pools(questions, scope), R.pools(chunks, scope), k, mode)
        return {(r.qid, r["rank"]): (r.tag, r.chunk_index, round(r.score, 6), r.n_candidates) for r in got.collect()}

    assert top("doc", "dense") == {("q1", 1): ("a", 0, 1.0, 2), ("q1", 2): ("a", 1, 0.0, 2), ("q2", 1): ("b", 0, 0.8, 1)}
    assert top("corpus", "hybrid", 1)["q1", 1] == ("b", 0, 1.2, 3)
    assert top("auto", "dense") == top("doc", "dense")
    assert top("corpus", "sparse", 3)["q2", 3] == ("b", 0, 0.0, 3)
    with pytest.raises(ValueError):
        top("doc", "else")


def random_rows(n, seed, dim=3):
    rnd = np.random.default_rng(seed)
    words = ["a", "b", "c", "dé", "the"]
    out = []
    for k in range(n):
        mine = [words[i] for i in np.flatnonzero(rnd.random(5) < 0.4)]
        out.append((k, f"t{k % 4}", k, f"p{k % 3 % 2}", None if k % 7 == 3 else rnd.integers(-2, 3, dim).astype(float).tolist(), None if k % 5 == 4 else mine, None if k % 5 == 4 else rnd.integers(1, 4, len(mine)).astype(float).tolist()))
    return out


ROWS = "qid long, tag string, chunk_index int, pool_key string, embedding array<double>, tokens array<string>, weights array<double>"


def plain_scores(q, c, mode, weight):
    dense = sum(x * y for x, y in zip(q[4] or [], c[4] or []))
    sparse = sum(a * b for t, a in zip(q[5] or [], q[6] or []) for u, b in zip(c[5] or [], c[6] or []) if t == u)
    return {"dense": dense, "sparse": sparse, "hybrid": dense + weight * sparse}[mode]


@pytest.mark.parametrize("sent", [32 << 20, 10])
@pytest.mark.parametrize("mode", ["dense", "sparse", "hybrid"])
def test_top_k_in_blocks_matches_plain_scores(spark, monkeypatch, mode, sent):
    for name, value in (("QUESTIONS", 3), ("CHUNKS", 5), ("POSTINGS", 7)):
        monkeypatch.setattr(R, name, value)
    monkeypatch.setattr("colloquy.operators.joins.BROADCAST_BYTES", sent)
    rows = random_rows(60, 1)
    df = spark.createDataFrame(rows, ROWS).repartition(4)
    got = {}
    for r in R.top_k(df.filter("qid % 4 = 0"), df, 5, mode, 0.5).collect():
        got.setdefault(r.qid, []).append((r["rank"], r.tag, r.chunk_index, r.score, r.n_candidates))
    want = {}
    for q in rows[::4]:
        pool = [c for c in rows if c[3] == q[3]]
        best = sorted((-plain_scores(q, c, mode, 0.5), c[1], c[2]) for c in pool)[:5]
        want[q[0]] = [(i + 1, tag, at, -s, len(pool)) for i, (s, tag, at) in enumerate(best)]
    assert {q: sorted(x) for q, x in got.items()} == want


def test_sparse_scores_of_all_that_share_a_word(spark):
    rows = random_rows(40, 2)
    df = spark.createDataFrame(rows, ROWS).repartition(3)
    got = {(r.qid, r.chunk_index): r.sparse for r in R.sparse_scores(df.filter("qid < 6"), df).collect()}
    want = {(q[0], c[2]): plain_scores(q, c, "sparse", 1) for q in rows[:6] for c in rows if c[3] == q[3]}
    assert got == {k: v for k, v in want.items() if v}


def test_the_driver_holds_no_questions(spark):
    rows = spark.range(100_000).select(F.col("id").alias("qid"), F.lit("t").alias("tag"), F.col("id").alias("chunk_index"), F.lit("all").alias("pool_key"), F.array((F.col("id") % 97).cast("double"), F.lit(1.0)).alias("embedding"))
    got = R.top_k(rows, rows.filter("qid < 50"), 2)
    assert got.agg(F.count("*"), F.count_distinct("qid"), F.count_if((F.col("rank") == 1) & (F.col("chunk_index") != 49) & (F.col("qid") % 97 > 0))).first()[:] == (200_000, 100_000, 0)


def test_sparse_arrays_are_sparse_vectors(spark):
    df = spark.createDataFrame([(1, "the cat, The dog; éa x1 x1", 5), (2, None, 6), (3, "", 7), (4, "a " * 1000 + "b", 8)], "id int, text string, other int").repartition(2)
    got = sorted((r.id, r.other, t, w) for r in E.sparse_arrays(df).collect() for t, w in zip(r.tokens, r.weights))
    want = sorted((r.id, r.other, r.token, r.weight) for r in E.sparse_vectors(E.token_weights(df, ["id", "other"], F.col("text")), ["id", "other"]).collect())
    assert got == want and {r.id for r in E.sparse_arrays(df).collect()} == {1, 2, 3, 4}


def test_neighbours_and_filters(spark):
    rows = spark.createDataFrame([("t", k, ["a", "b"] if k == 4 else ["c", "d"], None, "key here" if k in (4, 9) else "no") for k in range(12)], "tag string, chunk_index int, participants array<string>, recipients array<string>, text string")
    got = R.with_neighbours(rows, R.chunk_filter(speaker="a", pair=("a", "b"), tags=["t"], keyword="key"), 2)
    assert sorted(r.chunk_index for r in got.collect()) == [2, 3, 4, 5, 6]


def test_encoders_and_vectors(spark):
    df = spark.createDataFrame([(1, "a b a"), (2, None)], "id int, text string")
    got = {r.id: r.embedding for r in E.dense_vectors(df, "text").collect()}
    assert sum(x * x for x in got[1]) == pytest.approx(1) and set(got[2]) == {0.0}
    weights = spark.createDataFrame([(1, "x", 0.2), (1, "x", 0.7), (1, "<s>", 9.0), (1, "y", 0.0)], "id int, token string, weight double")
    assert [tuple(r) for r in E.sparse_vectors(weights, ["id"], ["<s>"]).collect()] == [(1, "x", 0.7)]
    zero = df.select(E.unit(F.array(F.lit(0.0), F.lit(0.0))).alias("u")).first().u
    assert zero == [0.0, 0.0]


def test_gold_and_config_checks(spark):
    q = spark.createDataFrame([("q", "t", [5])], "qid string, tag string, gold array<int>")
    sizes = spark.createDataFrame([("t", 5)], "tag string, n_chunks int")
    with pytest.raises(ValueError):
        V.check_gold(q, sizes)
    assert V.check_gold(q.withColumn("gold", F.array(F.lit(4))), sizes).count() == 1
    with pytest.raises(ValueError):
        J.check_config("hash-b", "hash-a", "hybrid")


def test_evaluate_job_of_some_documents(spark):
    chunks = spark.createDataFrame([(t, k, f"{t}{k} beta{k} common") for t in ("a_en", "b_en") for k in range(6)], "tag string, chunk_index int, text string")
    questions = chunks.filter("chunk_index = 2").select("tag", F.col("tag").alias("qid"), F.lit("en").alias("corpus"), F.col("text").alias("question"), F.lit("1 x").alias("qtype"), F.array("chunk_index").alias("gold"))
    assert {r.tag for r in J.evaluate_job(questions, chunks, ["aa-dense"], document="b").select("tag").collect()} == {"b_en"}
    with pytest.raises(ValueError):
        J.evaluate_job(questions, chunks, ["aa-dense"], document="c")


def test_results_of_a_run_are_not_replaced_unless_asked(spark, tmp_path):
    df = spark.createDataFrame([("aa", 0.5)], "config string, value double")
    for write, read in ((S.write_summary, lambda p: spark.read.csv(p, header=True)), (S.write_query_results, spark.read.json)):
        path = str(tmp_path / write.__name__)
        write(df, path, "r1")
        with pytest.raises(Exception, match="exists"):
            write(df, path, "r1")
        write(df, path, "r1", overwrite=True)
        write(df, path, "r2")
        assert sorted((r.config, r.run_id) for r in read(path).collect()) == [("aa", "r1"), ("aa", "r2")]


def test_evaluate_job_finds_a_text_by_itself(spark):
    chunks = spark.createDataFrame([("d_en", k, f"alpha{k} beta{k} gamma{k} common") for k in range(30)], "tag string, chunk_index int, text string")
    questions = chunks.filter("chunk_index % 5 = 0").select(F.concat(F.lit("q"), "chunk_index").alias("qid"), "tag", F.lit("en").alias("corpus"), F.col("text").alias("question"), F.lit("1 x").alias("qtype"), F.array("chunk_index").alias("gold"))
    got = V.roll_up(J.evaluate_job(questions, chunks, ["aa-dense", "aa-hybrid", "aa-sparse"]))
    assert {r.config: r["hit@5"] for r in got.filter("document = 'ALL'").collect()} == {"aa-dense": 1.0, "aa-hybrid": 1.0, "aa-sparse": 1.0}
    assert {c for c in V.compare(got, ["aa-dense", "aa-hybrid"]).columns} == {"metric", "aa-dense", "aa-hybrid"}


@pytest.mark.parametrize("common", [1e-9, 4, 1e9])  # no word by matrix, some, all
def test_products_by_matrix_and_by_postings_are_the_same(monkeypatch, common):
    monkeypatch.setattr(R, "COMMON", common)
    monkeypatch.setattr(R, "WORDS", 2)
    monkeypatch.setattr(R, "POSTINGS", 7)
    rows = random_rows(50, 3)
    sides = {"q": rows[:20], "c": rows[20:]}
    row = {}
    for s, mine in sides.items():
        words = sorted({t for r in mine for t in r[5] or []}, reverse=s == "c")
        row[f"{s}_tokens"] = pa.scalar(words)
        row[f"{s}_codes"] = pa.scalar(np.array([words.index(t) for r in mine for t in r[5] or []], np.int32).tobytes())
        row[f"{s}_weights"] = pa.scalar(np.array([w for r in mine for w in r[6] or []]).tobytes())
        row[f"{s}_ends"] = pa.scalar(np.cumsum([len(r[5] or []) for r in mine]).astype(np.int64).tobytes())
    got = R.shared_weights(row, 20, 30)
    assert got.tolist() == [[plain_scores(q, c, "sparse", 1) for c in sides["c"]] for q in sides["q"]]


def test_one_pool_is_dealt_over_many_tasks(spark, monkeypatch):
    """Where questions are too many to be sent to all, the join went by the pool alone: one pool was one task's."""
    monkeypatch.setattr(R, "CHUNKS", 5)
    monkeypatch.setattr("colloquy.operators.joins.BROADCAST_BYTES", 10)
    df = spark.createDataFrame(random_rows(400, 4), ROWS).withColumn("pool_key", F.lit("all")).repartition(4)
    met = R.meetings(df.filter("qid % 100 = 0"), df, ["embedding"]).withColumn("task", F.spark_partition_id())
    rows = met.select("task", "q_qid", F.explode("c_chunk_index").alias("c")).select("task", F.explode("q_qid").alias("q"), "c").collect()
    assert len({r.task for r in rows}) > 4
    assert len(rows) == len({(r.q, r.c) for r in rows}) == 4 * 400


def test_sparse_texts_group_only_rows_that_share_their_ids(spark):
    rows = [(1, "en", "the cat the"), (2, None, "a b"), (2, None, "b c"), (None, "en", "x y"), (3, "en", None), (4, "en", "")]
    df = spark.createDataFrame(rows, "id long, lang string, text string").repartition(3)
    for some in (df, df.filter("id = 1 or id is null")):
        got = sorted(map(repr, E.sparse_texts(some, ["id", "lang"]).collect()))
        assert got == sorted(map(repr, E.sparse_vectors(E.token_weights(some, ["id", "lang"], F.col("text")), ["id", "lang"]).collect()))
    assert "hashpartitioning" not in E.sparse_texts(df.filter("id = 1"), ["id", "lang"])._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("sent", [32 << 20, 10])
@pytest.mark.parametrize("mode", ["sparse", "hybrid"])
def test_limits_and_bounds_change_no_result(spark, monkeypatch, mode, sent):
    small = {"QUESTIONS": 3, "CHUNKS": 5, "EARLY": 2, "FEW": 1, "COLUMNS": 3, "SHARED": 2, "BLOCK": 2, "FIRST": 2, "MANY": 2, "TABLE": 4, "ENTRIES": 3, "POSTINGS": 7}
    for name, value in small.items():
        monkeypatch.setattr(R, name, value)
    monkeypatch.setattr("colloquy.operators.joins.BROADCAST_BYTES", sent)
    limited = []
    monkeypatch.setattr(R, "with_limits", lambda *a, f=R.with_limits: limited.append(f(*a)) or limited[-1])
    rows = random_rows(80, 5)
    df = spark.createDataFrame(rows, ROWS).repartition(4)
    got = {}
    for r in R.top_k(df.filter("qid % 4 = 0"), df, 3, mode, 0.5).collect():
        got.setdefault(r.qid, []).append((r["rank"], r.tag, r.chunk_index, r.score, r.n_candidates))
    want = {}
    for q in rows[::4]:
        pool = [c for c in rows if c[3] == q[3]]
        best = sorted((-plain_scores(q, c, mode, 0.5), c[1], c[2]) for c in pool)[:3]
        want[q[0]] = [(i + 1, tag, at, -s, len(pool)) for i, (s, tag, at) in enumerate(best)]
    assert {q: sorted(x) for q, x in got.items()} == want and len(limited) == 1


def test_few_pairs_of_a_meeting_are_scored(monkeypatch):
    """All were, though a bound shows of most that they aren't among the best."""
    rnd = np.random.default_rng(6)
    texts = [list(dict.fromkeys(rnd.zipf(1.3, 60) % 5000)) for _ in range(2100)]
    sides, row = {"q": texts[:100], "c": texts[100:]}, {}
    for s, mine in sides.items():
        row[f"{s}_tokens"] = pa.scalar([str(w) for w in range(5000)])
        row[f"{s}_codes"] = pa.scalar(np.array([w for t in mine for w in t], np.int32).tobytes())
        row[f"{s}_weights"] = pa.scalar(np.array([1 / (1 + i) for t in mine for i in range(len(t))]).tobytes())
        row[f"{s}_ends"] = pa.scalar(np.cumsum([len(t) for t in mine]).astype(np.int64).tobytes())
    met, scored = R.Meeting(row, 100, 2000, 1.0, None), []
    for name, size in (("scores", lambda q, c: len(q)), ("all_scores", lambda q: len(q) * 2000)):
        monkeypatch.setattr(met, name, lambda *a, f=getattr(met, name), size=size: scored.append(size(*a)) or f(*a))
    best = R.Best(0, pa.array(range(100)), 10, 9)
    best.add_bounded(met, pa.array(["t"] * 2000), pa.array(range(2000)))
    assert sum(scored) < 100 * 2000 / 4
    q, c, _ = R.best_of(np.round(R.shared_weights(row, 100, 2000), 9), 10)
    assert best.table["q"].to_pylist() == q.tolist() and best.table["chunk_index"].to_pylist() == c.tolist()


def packed_row(texts: list[list[int]], n: int) -> dict[str, pa.Scalar]:
    """The first n as questions, the others as chunks, with words by number."""
    row = {}
    for s, mine in (("q", texts[:n]), ("c", texts[n:])):
        row[f"{s}_tokens"] = pa.scalar([str(w) for w in range(5000)])
        row[f"{s}_codes"] = pa.scalar(np.array([w for t in mine for w in t], np.int32).tobytes())
        row[f"{s}_weights"] = pa.scalar(np.array([1 / (1 + i) for t in mine for i in range(len(t))]).tobytes())
        row[f"{s}_ends"] = pa.scalar(np.cumsum([len(t) for t in mine]).astype(np.int64).tobytes())
    return row


def test_pairs_that_only_share_a_column_are_not_scored(monkeypatch):
    """A pair whose first words share a column of the bounds was scored, though they are different words; so were FIRST of each question with more than FIRST pairs."""
    rnd = np.random.default_rng(7)
    row = packed_row([rnd.permutation(5000)[:20].tolist() for _ in range(2200)], 200)
    exact = np.round(R.shared_weights(row, 200, 2000), 9)
    met, scored = R.Meeting(row, 200, 2000, 1.0, None), []
    monkeypatch.setattr(met, "scores", lambda q, c, f=met.scores: scored.append(len(q)) or f(q, c))
    monkeypatch.setattr(met, "all_scores", lambda q, f=met.all_scores: scored.append(len(q) * 2000) or f(q))
    best = R.Best(0, pa.array(range(200)), 10, 9)
    best.least[:] = np.sort(exact, axis=1)[:, -10] - 1e-9
    best.add_bounded(met, pa.array(["t"] * 2000), pa.array(range(2000)))
    q, c, score = R.best_of(exact, 10)
    assert best.table["q"].to_pylist() == q.tolist() and best.table["chunk_index"].to_pylist() == c.tolist() and best.table["score"].to_pylist() == score.tolist()
    assert sum(scored) < 200 * 2000 / 100


@pytest.mark.parametrize("alone", [0, 10**9])  # pairs looked up one by one, together
@pytest.mark.parametrize("long", [0, 1, 10**9])  # questions looked up in chunks, the shorter in the longer, chunks in questions
def test_pairs_have_the_same_sums_either_way(monkeypatch, alone, long):
    monkeypatch.setattr(R, "ALONE", alone)
    monkeypatch.setattr(R, "LONG", long)
    rnd = np.random.default_rng(8)
    texts = [rnd.permutation(300)[: rnd.integers(0, 60)].tolist() for _ in range(70)]
    row = packed_row(texts, 20)
    q, c = np.divmod(np.arange(20 * 50), 50)
    mix = rnd.permutation(1000)
    got = R.Meeting(row, 20, 50, 1.0, None).scores(q[mix], c[mix])
    want = R.shared_weights(row, 20, 50)[q[mix], c[mix]]
    assert np.allclose(got, want, rtol=0, atol=1e-12) and want.any()


def test_some_chunks_with_vectors_are_searched_first(spark, monkeypatch):
    """Vectors that lie in few packed rows were not met in the first search, so limits of questions with vectors came from words alone."""
    for name, value in {"CHUNKS": 5, "EARLY": 32}.items():
        monkeypatch.setattr(R, name, value)
    found = []
    monkeypatch.setattr(R, "with_limits", lambda asked, rows, *a, f=R.with_limits: found.append(rows) or f(asked, rows, *a))
    rows = [(i, "a" if i < 10 else "b", i, "all", [1.0, i / 10] if i < 10 else None, ["x"], [0.1]) for i in range(500)]
    df = spark.createDataFrame(rows, ROWS).coalesce(1)
    got = R.top_k(df.filter("qid = 0"), df, 2, "hybrid", 0.3).collect()
    assert "a" in {r.tag for r in found[0].filter("score is not null").collect()}
    assert sorted((r["rank"], r.chunk_index) for r in got) == [(1, 0), (2, 1)]


def test_packed_rows_are_bounded_by_bytes(spark, monkeypatch):
    """CHUNKS rows were packed together however long they were, and a packed row travelled with each that it met: tasks held rows of many MB, writers and readers of tables many of these."""
    monkeypatch.setattr(R, "PIECE", 4000, raising=False)
    rows = [(i, "t", i, "all", None, [f"w{i}_{j}" for j in range(20 if i < 300 else 2000)], [1.0] * (20 if i < 300 else 2000)) for i in range(302)]
    df = spark.createDataFrame(rows, ROWS).coalesce(1)
    packs = R.packed_chunks(df, ["tokens", "weights"]).select(F.size("c_tag").alias("n"), (F.octet_length("c_codes") + F.octet_length("c_weights")).alias("size")).collect()
    assert sum(r.n for r in packs) == 302 and max(r.size for r in packs if r.n > 1) <= 4000
    assert sum(r.n == 1 and r.size == 24_000 for r in packs) == 2


@pytest.mark.parametrize("mode", ["dense", "sparse", "hybrid"])
def test_questions_of_a_pool_in_several_tasks(spark, monkeypatch, mode):
    """A row of questions and a row of chunks were one row; now each reaches a task by itself, questions first, and many questions are several tasks'."""
    for name, value in {"QUESTIONS": 3, "CHUNKS": 5, "PIECE": 150, "FULL": 400, "PART": 1000, "TOGETHER": 1, "FLOW": 6, "EARLY": 4, "FEW": 1}.items():
        monkeypatch.setattr(R, name, value, raising=False)
    dealt = []
    monkeypatch.setattr(R, "dealt", lambda *a, f=getattr(R, "dealt", None): dealt.append(f(*a)) or dealt[-1], raising=False)
    rows = random_rows(120, 9)
    df = spark.createDataFrame(rows, ROWS).repartition(4)
    got = {}
    for r in R.top_k(df.filter("qid % 4 = 0"), df, 4, mode, 0.5).collect():
        got.setdefault(r.qid, []).append((r["rank"], r.tag, r.chunk_index, r.score, r.n_candidates))
    want = {}
    for q in rows[::4]:
        pool = [c for c in rows if c[3] == q[3]]
        best = sorted((-plain_scores(q, c, mode, 0.5), c[1], c[2]) for c in pool)[:4]
        want[q[0]] = [(i + 1, tag, at, -s, len(pool)) for i, (s, tag, at) in enumerate(best)]
    assert {q: sorted(x) for q, x in got.items()} == want
    met = dealt[-1].select("pool_key", "__group", F.spark_partition_id().alias("task"), "q_qid", "c_chunk_index").collect()
    assert all((r.q_qid is None) != (r.c_chunk_index is None) for r in met)
    assert len({r["__group"] for r in met}) > 1 and len({r.task for r in met}) > 4
    for n in {(r.pool_key, r["__group"]) for r in met}:
        chunks = [c for r in met if (r.pool_key, r["__group"]) == n for c in r.c_chunk_index or []]
        assert len(chunks) == len(set(chunks)) == len([r for r in rows if r[3] == n[0]])
