import hashlib
import random

import numpy as np

from colloquy.llm import exact_dedup as E

SCHEMA = "doc_id long, text string, keep_id string, key int"


def brute(rows):
    """One tuple per row: doc_id, keep_id, group_size, kept, text_sha256."""
    groups = {}
    for d, t in rows:
        groups.setdefault(t or "", []).append(d)
    out = []
    for d, t in rows:
        ids = groups[t or ""]
        keep = max((x for x in ids if x is not None), default=None)
        out.append((d, keep, len(ids), d == keep, hashlib.sha256((t or "").encode()).hexdigest()))
    return sorted(out, key=str)


def compare(spark, rows, **how):
    docs = spark.createDataFrame([(d, t, "clash", 1) for d, t in rows], SCHEMA).repartition(3)
    got = [(r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in E.exact_dedup(docs, **how).collect()]
    assert sorted(got, key=str) == brute(rows)


def corpus(seed, copies=6):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdé ") for _ in range(rnd.randint(1, 9)))
    texts = ["".join(word() for _ in range(rnd.randint(0, 400))) for _ in range(25)]
    texts += [t[:-1] + "#" for t in texts[:8] if t] + [t + " " for t in texts[:5]] + ["", None, " ", "a" * 40, "a" * 41]
    rows = [(k, t) for k, t in enumerate(texts)]
    rows += [(1000 + k, rnd.choice(texts)) for k in range(len(texts) * copies // 2)]
    rnd.shuffle(rows)
    return rows


def test_groups_match_brute_force(spark):
    compare(spark, corpus(1), mean=64)
    compare(spark, corpus(2))


def test_identifiers_of_different_chunks_are_told_apart(spark):
    rows = corpus(3) + [(None, t) for _, t in corpus(3)[:20]]
    compare(spark, rows, mean=64, id_bytes=1)  # 256 identifiers: most stand for several chunks
    texts = [f"{k:05d}" for k in range(600)]  # texts of one chunk: any two with one identifier have equal recipes
    compare(spark, [(k, t) for k, t in enumerate(texts)] + [(None, t) for t in texts[:30]], id_bytes=1)


def test_nulls_empty_texts_ties_and_repeated_rows(spark):
    compare(spark, [(1, None), (2, ""), (None, ""), (3, "x"), (3, "x"), (None, "y"), (None, "y"), (5, "z"), (4, "z"), (4, "q")])
    compare(spark, [(None, None)])
    assert E.exact_dedup(spark.createDataFrame([], SCHEMA)).count() == 0


def test_very_long_texts(spark):
    rnd = random.Random(4)
    long = "".join(rnd.choice("abcdefgh ") for _ in range(3_000_000))
    compare(spark, [(1, long), (2, long), (3, long[:-1] + "!"), (4, "x" * 2_000_000), (5, "x" * 2_000_001), (6, "x" * 2_000_000)])


def test_one_text_in_a_third_of_all_rows(spark):
    compare(spark, [(k, "same" if k % 3 else f"t{k}") for k in range(3000)])


def test_cuts_depend_on_content_alone():
    rnd = np.random.default_rng(5)
    body = rnd.integers(0, 256, 200_000, dtype=np.uint8).tobytes()
    a, b = E.chunks(body), E.chunks(b"some bytes in front" + body)
    assert b"".join(a) == body and len(set(a) & set(b)) >= len(a) - 2
    assert max(map(len, E.chunks(b"z" * 100_000))) <= E.LONGEST
