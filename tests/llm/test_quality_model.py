import zlib

import numpy as np

from colloquy.llm import quality_model as Q
from colloquy.llm import words as W


def test_word_hashes_tell_words_apart_and_follow_case():
    texts = ["One two\tTWO\nthree", "", " x ", "two"]
    h, text = W.word_hashes([t.encode() for t in texts])
    assert text.tolist() == [0, 0, 0, 0, 2, 3]
    assert h[1] == h[2] == h[5] and len(set(h.tolist())) == 4
    raw, _ = W.word_hashes([t.encode() for t in texts], lower=False)
    assert raw[1] != raw[2]


def test_context_vectors_match_brute_force(spark):
    rows = [(1, "a b c! a"), (2, "b a"), (3, None)]
    got = {r.bucket: (r.n, r.v) for r in Q.contexts(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    places, signs = Q.index_vectors()
    want: dict = {}
    for _, t in rows:
        b, _ = Q.runs([(t or "").encode()])
        for i, x in enumerate(b):
            n, v = want.setdefault(int(x), [0, np.zeros(Q.DIM)])
            want[int(x)][0] += 1
            for j in range(max(0, i - Q.NEAR), min(len(b), i + Q.NEAR + 1)):
                if j != i:
                    np.add.at(v, places[b[j]], signs[b[j]])
    assert {k: (n, v.astype(int).tolist()) for k, (n, v) in want.items()} == {k: (n, list(v)) for k, (n, v) in got.items()}


def test_held_out_accuracy_and_the_learned_rows(spark, tiny):
    rng = np.random.default_rng(0)
    vocab = [f"w{k}" for k in range(300)]
    rows = [(k, " ".join(x + ("###" if k % 3 == 0 else "") for x in rng.choice(vocab, 80)), "n") for k in range(400)]
    rows += [(900, None, "n"), (901, "", "n"), (None, "x", "n"), (5, rows[5][1], "n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    labels = spark.createDataFrame([(k, int(k % 3 != 0), None) for k in range(400)] + [(900, None, None)], "doc_id long, quality int, toxic int")
    model = Q.train(docs, labels)
    got = Q.score(docs, model).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    held = [(r.doc_id, r.score >= Q.LEAST_SCORE) for r in got if r.doc_id is not None and r.doc_id < 400 and zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert len(held) > 50 and np.mean([p == (d % 3 != 0) for d, p in held]) > 0.97
    kept = Q.accepted(docs, model)
    assert kept.columns == docs.columns and kept.count() == sum(r.score >= Q.LEAST_SCORE for r in got)


def test_very_long_null_and_repeated_texts(spark, tiny):
    docs = spark.read.parquet(f"{tiny}/documents.parquet").select("doc_id", "text")
    more = spark.createDataFrame([(10**6, "word " * 400_000), (10**6 + 1, "y" * 2_000_000), (10**6 + 2, None), (10**6 + 2, None), (None, "a b")], "doc_id long, text string")
    both = docs.union(more)
    model = Q.train(both, spark.read.parquet(f"{tiny}/labels.parquet"))
    rows = Q.score(both, model).collect()
    assert len(rows) == docs.count() + 5
    assert all(0 <= r.score <= 1 for r in rows)
    assert np.ptp([r.score for r in rows if r.doc_id == 10**6 + 2]) < 1e-9


def test_without_labels_and_without_rows(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert [r.score for r in Q.score(docs, Q.train(docs, none)).collect()] == [0.5]
    assert Q.score(docs.limit(0), Q.train(docs.limit(0), none)).count() == 0
