import os
from collections import Counter

import numpy as np

import corpus_pipeline as C
from colloquy.llm.common import written
from colloquy.sources.scratch import tables_dir

from .test_near_dedup import brute
from .test_packing import ids_of


def test_stages_one_after_another(spark, tiny):
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    columns, kept = docs.columns, [docs]
    for name, stage in C.STAGES[:-1]:
        kept.append(written(stage(spark, kept[-1], tiny), name))
        assert kept[-1].columns == columns, name
    rows = [k.select("doc_id", "text").collect() for k in kept]
    ids = [{r.doc_id for r in x} for x in rows]
    assert all(b <= a for a, b in zip(ids, ids[1:]))
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{tiny}/labels.parquet").collect()}
    good, bad = ({d for d, q in labels.items() if q == v} for v in (1, 0))
    assert len(good & ids[1]) >= 0.97 * len(good) and len(bad & ids[1]) <= 0.3 * len(bad)
    assert ids[2] == set({r.text: r.doc_id for r in sorted(rows[1])}.values())
    assert ids[3] == {d for d, (_, root) in brute([tuple(r) for r in rows[2]], 5).items() if d == root}
    assert set(Counter(r.doc_id for r in rows[4]).values()) <= {1, 2}
    packed = C.STAGES[-1][1](spark, kept[-1], tiny).collect()
    assert sum(r.n_tokens for r in packed) == sum(len(ids_of(r.text)) for r in rows[4])


def test_extra_columns_null_texts_and_no_rows(spark, tiny):
    docs = spark.createDataFrame([(1, None, "en", None, 0, "k"), (2, "a b c", None, "s", 5, "k"), (2, "a b c", None, "s", 5, "k")], "doc_id long, text string, lang string, source string, n_chars long, kept string")
    for part in (docs, docs.limit(0)):
        for _, stage in C.STAGES:
            part = written(stage(spark, part, tiny), "x")


def test_repeated_rows_leave_once_and_rows_without_id_stay(spark, tiny):
    words = lambda k, n: " ".join(f"w{k}x{i}" for i in range(n))
    near = words(7, 60)
    rows = [(1, words(1, 40)), (1, words(1, 40)), (1, words(1, 40)), (None, words(2, 40)), (None, words(2, 40)), (None, words(3, 50)), (4, words(4, 40)), (4, words(5, 40)), (5, words(5, 40)), (None, words(4, 40)), (8, near), (8, near + " end"), (9, near + " stop"), (8, words(8, 40))]
    docs = spark.createDataFrame([(d, t, "en", "s", 0) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    stages = dict(C.STAGES)
    exact = written(stages["exact_dedup"](spark, docs, tiny), "exact")
    assert sorted((r.text, r.doc_id) for r in exact.collect()) == sorted({t: d for d, t in sorted(rows, key=lambda r: r[0] or 0)}.items())
    kept = written(stages["near_dedup"](spark, exact, tiny), "near")
    got = sorted((r.doc_id or 0, r.text[:4]) for r in kept.collect())
    assert got == [(0, "w2x0"), (0, "w3x0"), (1, "w1x0"), (4, "w4x0"), (5, "w5x0"), (8, "w7x0"), (8, "w8x0")]
    mixed = written(stages["mixing"](spark, kept, tiny), "mixed")
    assert set(Counter(r.text for r in mixed.collect()).values()) <= {1, 2} and mixed.columns == docs.columns
    packed = stages["packing"](spark, mixed, tiny).collect()
    assert pieces_of(packed) == sorted([(r.doc_id or 0, 0, ids_of(r.text)) for r in mixed.collect()])


def pieces_of(packed):
    """doc_id (0 for null), start and ids of every piece in the sequences."""
    out = []
    for r in packed:
        ids = np.frombuffer(r.ids, "<u2").tolist()
        assert len(ids) == r.n_tokens <= r.bin_length
        out += [(p.doc_id or 0, p.start, ids[p.bin_offset : p.bin_offset + p.n_tokens]) for p in r.pieces]
    return sorted(out)


def test_very_long_texts_go_through_all_stages(spark, tiny):
    rows = [r for r in spark.read.parquet(f"{tiny}/documents.parquet").collect() if r.text]
    long = " ".join(r.text for r in rows[:150])
    assert len(long) > 100_000
    docs = spark.createDataFrame([*rows, *[(k, t, "en", rows[0].source, len(t)) for k, t in ((10_000, long), (10_001, long), (None, long[::-1]))]], spark.read.parquet(f"{tiny}/documents.parquet").schema)
    for name, stage in C.STAGES:
        docs = written(stage(spark, docs, tiny), name)
    starts = [(d, s) for d, s, _ in pieces_of(docs.collect())]
    assert len(starts) > 20 and max(s for _, s in starts) % 4096 == 0


def test_a_run_removes_the_tables_between_its_stages(spark, tiny):
    tables = lambda: set(os.listdir(tables_dir(spark))) if os.path.exists(tables_dir(spark)) else set()
    before = tables()
    out = C.run(spark, tiny)
    left = tables() - before
    assert {x.rsplit("-", 1)[0] for x in left} == {"stage-packing"} and out.count() > 0
