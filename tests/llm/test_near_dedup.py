import random
import re

import numpy as np

from colloquy.llm import near_dedup as N


def shingles(text, n):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()


def brute(rows, n):
    sets = {d: shingles(t, n) for d, t in rows}
    up = {d: d for d in sets}

    def root(d):
        while up[d] != d:
            d = up[d]
        return d

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            common = len(sets[a] & sets[b])
            if common and 100 * common >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                up[y] = x
    return {d: (len(sets[d]), root(d)) for d in sets}


def compare(spark, rows, n, schema="doc_id long, text string"):
    got = N.near_dedup(spark.createDataFrame(rows, schema), n).collect()
    want = brute(rows, n)
    assert len(got) == len(rows)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def families(seed, words, sizes, edits, length):
    rnd, rows = random.Random(seed), []
    vocab = [f"v{k}" for k in range(words)]
    for size in sizes:
        base = [rnd.choice(vocab) for _ in range(length)]
        for _ in range(size):
            text = list(base)
            for _ in range(rnd.randint(0, edits)):
                text[rnd.randrange(length)] = rnd.choice(vocab)
            rows.append(" ".join(text))
    order = list(range(len(rows)))
    rnd.shuffle(order)
    return [(order[k], t) for k, t in enumerate(rows)]


def test_sets_match_brute_force():
    texts = ["One two  THREE\tfour", "", "x", "a b a b a b", "Éa éa", " y z"]
    for n in (1, 2, 5):
        h, text = N.shingle_sets([t.encode() for t in texts], n)
        assert np.bincount(text, minlength=len(texts)).tolist() == [len(shingles(t, n)) for t in texts]


def test_groups_match_brute_force(spark):
    rows = families(1, 400, [1] * 60 + [2] * 20 + [6, 9, 30], edits=5, length=50)
    rows += [(1000, None), (1001, ""), (1002, "a"), (1003, "A"), (1004, "a b"), (1005, " \n"), (1006, "a b c d e f"), (1007, "a b c d e f g")]
    compare(spark, rows, 2)


def test_nodes_of_several_units(spark, monkeypatch):
    monkeypatch.setattr(N, "MEMBERS", 6)
    compare(spark, families(2, 300, [1] * 20 + [80, 40], edits=8, length=60), 5)


def test_sets_counted_in_several_blocks(monkeypatch):
    monkeypatch.setattr(N, "SHARED", 7)
    rows = families(4, 200, [1, 1, 2, 5, 12], edits=6, length=40)
    h, text = N.shingle_sets([t.encode() for _, t in rows], 2)
    lows = N.linked([h[text == k] for k in range(len(rows))])
    want = brute([(k, t) for k, (_, t) in enumerate(rows)], 2)
    assert {k: int(v) for k, v in enumerate(lows)} == {k: root for k, (_, root) in want.items()}


def test_a_family_of_5000(spark):
    rnd = random.Random(8)
    vocab = [f"v{k}" for k in range(500)]
    base = [rnd.choice(vocab) for _ in range(80)]
    rows = []
    for k in range(5000):
        text = list(base)
        for _ in range(rnd.randint(0, 12)):
            text[rnd.randrange(80)] = rnd.choice(vocab)
        rows.append((k, " ".join(text)))
    got = {r.doc_id: r.component_id for r in N.near_dedup(spark.createDataFrame(rows, "doc_id long, text string"), 2).collect()}
    h, text = N.shingle_sets([t.encode() for _, t in rows], 2)
    lows = N.linked(np.split(h, np.cumsum(np.bincount(text))[:-1]))
    same = sum(got[k] == int(low) for k, low in enumerate(lows))
    assert same == len(rows) and len(set(got.values())) > 1


def test_very_long_and_repeated_texts(spark):
    rnd = random.Random(3)
    words = [f"w{rnd.randrange(20_000)}" for _ in range(300_000)]
    other = [w if rnd.random() > 0.02 else "new" for w in words]
    rows = [(1, " ".join(words)), (2, " ".join(other)), (3, "same " * 200_000), (4, "same " * 10), (5, "x" * 3_000_000)]
    compare(spark, rows, 2)


def test_repeated_rows_null_ids_and_empty_tables(spark):
    schema = "doc_id long, text string, n_shingles int"
    got = N.near_dedup(spark.createDataFrame([(3, "a b c", 1), (3, "a b c", 1), (2, "A b c", 1), (None, "a b c", 1), (5, "q", 0)], schema)).collect()
    assert sorted((r.doc_id or 0, r.component_id or 0, r.kept) for r in got) == [(0, 0, True), (2, 2, True), (3, 2, False), (3, 2, False), (5, 5, True)]
    assert N.near_dedup(spark.createDataFrame([], schema)).count() == 0


def test_pairs_meet_as_often_as_computed(spark):
    rnd, pairs = np.random.default_rng(5), 1000
    a = rnd.integers(0, 1 << 16, (pairs, N.PLACES), dtype=np.uint16)
    b = np.where(rnd.random(a.shape) < 0.8, a, rnd.integers(0, 1 << 16, a.shape, dtype=np.uint16))
    classes = spark.createDataFrame([(k, bytearray(x.tobytes())) for k, x in enumerate(np.concatenate([a, b]))], "cls long, sig binary")
    nodes = N.first_nodes(classes)
    for steps in range(N.FIRST_STEPS, N.FIRST_STEPS + 5):
        both = nodes.selectExpr("node", f"cls % {pairs} as pair").groupBy("node", "pair").count().filter("count > 1")
        assert both.select("pair").distinct().count() / pairs >= N.recall(0.8, steps) - 0.01
        nodes = N.next_nodes(nodes, classes)
    assert N.recall(0.8) >= N.RECALL > N.recall(0.8, trees=N.TREES - 1) and N.recall(0.85) > 0.9999
    assert N.TREES == 12 and N.recall(0.8, N.FIRST_STEPS + N.MORE_STEPS) > 0.98  # of pairs in nodes that walk as far as can be
