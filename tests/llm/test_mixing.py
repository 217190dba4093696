from collections import defaultdict

import pytest

from colloquy.llm import mixing as M

SCHEMA = "doc_id long, text string, source string, size int"


def brute_targets(sizes, share=M.SHARE):
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: M.WEIGHTS[k % 3] for k, s in enumerate(names)}
    total, got = share * sum(sizes.values()), dict.fromkeys(names, 0.0)
    open_, left = set(names), total
    while left > 1e-9 and open_:
        all_w = sum(weight[s] for s in open_)
        for s in open_:
            got[s] += left * weight[s] / all_w
        left = sum(max(0.0, got[s] - 2 * sizes[s]) for s in names)
        for s in names:
            if got[s] >= 2 * sizes[s]:
                got[s] = 2.0 * sizes[s]
                open_.discard(s)
    return got


def check(rows, docs, near):
    sizes, taken, target = defaultdict(int), defaultdict(int), {}
    of = {d: s for d, _, s, _ in docs}
    for r in rows:
        assert 0 <= r.copies <= 2
        s = of[r.doc_id]
        sizes[s] += r.size
        taken[s] += r.copies * r.size
        target[s] = r.target
    want = brute_targets(sizes)
    for s in sizes:
        assert target[s] == pytest.approx(want[s])
        assert abs(taken[s] - want[s]) <= near, s
    assert all(r.source_size == sizes[of[r.doc_id]] for r in rows)


def test_sources_come_near_their_targets(spark):
    docs = [(k, "w " * (1 + k * k % 97), ["a", "b", "c", "d", None, "z"][k % 6 if k % 2 else 0], 3) for k in range(600)]
    docs += [(1000, "x " * 5000, "b", 1), (1001, None, "c", 1), (1002, "", None, 1), (1003, " \t\n", "z", 1)]
    df = spark.createDataFrame(docs, SCHEMA)
    rows = M.mix(df).collect()
    assert len(rows) == len(docs)
    check(rows, docs, near=3)
    again = M.mix(df.repartition(7)).collect()
    assert sorted((r.doc_id, r.copies) for r in rows) == sorted((r.doc_id, r.copies) for r in again)


def test_one_size_only_and_one_source(spark):
    docs = [(k, "one two", "s", 0) for k in range(101)]
    check(M.mix(spark.createDataFrame(docs, SCHEMA)).collect(), docs, near=2)


def test_rates_tilt_exponentially_by_size(spark):
    docs = [(k, "w " * (10 if k % 2 else 40), "ab"[k % 5 == 0], 0) for k in range(400)]
    cells = M.sized(spark.createDataFrame(docs, SCHEMA)).groupBy("source", "size").count().withColumnRenamed("count", "n")
    goals = M.targets(cells)
    got = {r.source.name: r for r in M.tilts(cells, goals).collect()}
    import math

    for g in goals.collect():
        t, words = got[g.source.name], 0.0
        if g.target >= 2 * g.source_size:
            continue
        for c in cells.filter(f"source.name = '{g.source.name}'").collect():
            words += c.n * c.size * 2 / (1 + math.exp(-t.tilt * c.size / t.mean))
        assert words == pytest.approx(g.target, rel=1e-6)


def test_repeated_rows_and_empty_table(spark):
    docs = [(1, "a b c", "s", 0)] * 3 + [(2, "a", None, 0)] * 2
    assert len(M.mix(spark.createDataFrame(docs, SCHEMA)).collect()) == 5
    assert M.mix(spark.createDataFrame([], SCHEMA)).count() == 0
