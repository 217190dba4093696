import hashlib
import math

import numpy as np
import pytest

from colloquy.llm import vector_codes as V

SCHEMA = "vec_id long, embedding array<float>, label int, row string, data int"


def brute(rows, parts=8, entries=16, rounds=6):
    """vec_id, codes, error of each kept row, and the codebooks, with Python's own integers."""
    kept = [(i, [math.floor(4096 * float(np.float32(x))) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    if not kept:
        return [], []
    m = len(kept[0][1]) // parts
    cut = lambda v: [tuple(v[p * m : (p + 1) * m]) for p in range(parts)]
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]
    books = [[cut(r[1])[p] for r in first] for p in range(parts)]
    far = lambda x, e: sum((a - b) ** 2 for a, b in zip(x, e))
    nearest = lambda p, x: min(range(len(books[p])), key=lambda j: (far(x, books[p][j]), j))
    for _ in range(rounds):
        for p in range(parts):
            at = [(nearest(p, x), x) for x in (cut(r[1])[p] for r in kept)]
            for j in range(len(books[p])):
                mine = [x for k, x in at if k == j]
                if mine:
                    books[p][j] = tuple(sum(c) // len(mine) for c in zip(*mine))
    out = []
    for i, v, label in kept:
        code = [nearest(p, x) for p, x in enumerate(cut(v))]
        out.append((i, label, code, sum(far(x, books[p][code[p]]) for p, x in enumerate(cut(v)))))
    return out, books


def compare(spark, rows, **how):
    df = spark.createDataFrame([(i, v, label, "clash", 1) for i, v, label in rows], SCHEMA).repartition(3)
    got, books = V.coded(df, **how)
    want, plain = brute(rows, how.get("parts", 8), how.get("entries", 16), how.get("rounds", 6))
    assert sorted([(r.vec_id, r.label, list(r.codes), r.error) for r in got.collect()], key=str) == sorted(want, key=str)
    assert books.tolist() == [list(map(list, b)) for b in plain]
    return got, books


def corpus(seed, n, dim=16):
    rnd = np.random.default_rng(seed)
    middles = rnd.normal(size=(9, dim)) * 0.4
    rows = [(k, (middles[k % 9] + rnd.normal(size=dim) * rnd.choice([0.0, 0.05])).astype(np.float32).tolist(), int(rnd.integers(3))) for k in range(n)]
    rows += [(5, rows[5][1], None), (7, rows[9][1], 1), (None, rows[3][1], None), (1000, None, 1), (1001, [*rows[0][1][:-1], None], 1), (1002, [*rows[0][1][:-1], float("nan")], 1), (1003, [*rows[0][1][:-1], float("-inf")], 1)]
    return rows


@pytest.mark.parametrize("how", [{}, {"parts": 4, "entries": 5, "rounds": 3}, {"parts": 1, "entries": 40}])
def test_codes_and_books_match_brute_force(spark, how):
    compare(spark, corpus(1, 300), **how)


def test_blocks_of_any_size(spark, monkeypatch):
    rows = corpus(2, 150)
    df = spark.createDataFrame([(i, v, label, "", 0) for i, v, label in rows], SCHEMA)
    found = V.integers(df, "embedding")
    length, low, high = V.checked(found, 8)
    for size in (1, 7, 1000):
        blocks = V.sorted_blocks(found, 8, length, low, high, size).collect()
        assert max(b.n for b in blocks) <= size and sum(b.n for b in blocks) == 8 * found.count()
        for b in blocks:
            x = np.frombuffer(b.data, "<i4").reshape(b.n, -1)
            assert np.frombuffer(b.sums, "<i8").tolist() == x.sum(0).tolist()
            assert np.frombuffer(b.low, "<i4").tolist() == x.min(0).tolist() and np.frombuffer(b.high, "<i4").tolist() == x.max(0).tolist()


def test_few_vectors_one_vector_in_a_third_of_rows_and_none(spark):
    compare(spark, corpus(3, 10)[:4])
    x = corpus(4, 60)[:60]
    compare(spark, [(k, x[0][1] if k % 3 == 0 else x[k][1], 1) for k in range(60)])
    got, books = V.coded(spark.createDataFrame([], SCHEMA))
    assert got.count() == 0 and books.size == 0
    assert V.coded(spark.createDataFrame([(1, None, 1, "", 0), (2, [float("nan")] * 8, 1, "", 0)], SCHEMA))[0].count() == 0


def test_what_cannot_be_coded_is_refused(spark):
    for vectors in ([[1.0] * 8, [1.0] * 16], [[1.0] * 9], [[3e30] * 8, [0.0] * 8]):
        with pytest.raises(ValueError):
            V.coded(spark.createDataFrame([(k, v, 1, "", 0) for k, v in enumerate(vectors)], SCHEMA))
    with pytest.raises(ValueError):
        V.coded(spark.createDataFrame([], SCHEMA), entries=300)


def test_shortlists_hold_the_nearest_of_every_part():
    rnd = np.random.default_rng(6)
    for _ in range(50):
        x = rnd.integers(-20, 20, size=(rnd.integers(1, 30), 3))
        entries = rnd.integers(-20, 20, size=(7, 3))
        listed = np.flatnonzero(V.shortlists(x.min(0)[None], x.max(0)[None], entries)[0])
        code, error = V.nearest(x, entries, listed)
        all_ = ((x[:, None] - entries) ** 2).sum(2)
        assert code.tolist() == all_.argmin(1).tolist() and error.tolist() == all_.min(1).tolist()


def test_the_curve_visits_neighbours():
    for n, bits in ((2, 3), (3, 2)):
        cells = np.stack(np.meshgrid(*[np.arange(1 << 8)[:: 1 << (8 - bits)]] * n), -1).reshape(-1, n)
        place = V.curve(cells, 0, 255)
        assert len(set(place.tolist())) == len(cells)
        walk = cells[np.argsort(place)]
        assert (np.abs(np.diff(walk, axis=0)).sum(1) == 1 << (8 - bits)).all()


def test_errors_fall_and_decoding_is_as_near_as_told(spark):
    rows = [r for r in corpus(7, 200) if r[1] is not None and r[0] is not None and r[0] < 1000]
    df = spark.createDataFrame([(i, v, label, "", 0) for i, v, label in rows], SCHEMA)
    total = lambda rounds: V.coded(df, rounds=rounds)[0].agg({"error": "sum"}).first()[0]
    assert total(6) <= total(0)
    got, books = V.coded(df)
    back = {r.vec_id: r for r in V.decoded(got, books).filter("vec_id not in (5, 7)").collect()}
    for i, v, _ in rows:
        if i in back:
            gap = np.linalg.norm(np.array(v) - np.array(back[i].vector))
            assert abs(gap - back[i].error ** 0.5 / V.SCALE) <= len(v) ** 0.5 / V.SCALE
    assert len(back) > 190


def test_label_errors_and_digest(spark, tmp_path):
    rows = corpus(8, 80)
    spark.createDataFrame([(i, v, label, "", 0) for i, v, label in rows], SCHEMA).drop("row", "data").write.parquet(f"{tmp_path}/embeddings.parquet")
    want, books = brute(rows)
    sums = {}
    for _, label, _, error in want:
        sums[label] = sums.get(label, 0) + error
    text = ",".join(str(x) for b in books for e in b for x in e)
    expect = sorted([(i, "".join(f"{c:02x}" for c in code), error, sums[label], hashlib.sha256(text.encode()).hexdigest()) for i, label, code, error in want], key=str)
    assert sorted([tuple(r) for r in V.op12_vector_codes(spark, str(tmp_path)).collect()], key=str) == expect
