import random

import numpy as np
import pytest

from colloquy.llm import repeats as R


def brute(rows):
    """Bytes and removed flags of each row: what covers a string that a row of a smaller doc_id has, or its own row before."""
    place = lambda d: -(2**63) if d is None else d
    least = {}
    for d, t in rows:
        raw = (t or "").encode()
        for w in {raw[i : i + 100] for i in range(len(raw) - 99)}:
            least[w] = min(place(d), least.get(w, place(d)))
    out = []
    for d, t in rows:
        raw = (t or "").encode()
        gone, own = np.zeros(len(raw), bool), set()
        for i in range(len(raw) - 99):
            w = raw[i : i + 100]
            if w in own or least[w] < place(d):
                gone[i : i + 100] = True
            own.add(w)
        out.append((d, raw, gone))
    return out


def compare(spark, rows, hot=R.HOT):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted([(str(r.doc_id), r.n_bytes, bytes(r.kept), tuple((x.start, x.end) for x in r.removed)) for r in R.without_repeats(df, hot).collect()])
    want = []
    for d, raw, gone in brute(rows):
        edge = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(int), [0]])))
        want.append((str(d), len(raw), bytes(np.frombuffer(raw, np.uint8)[~gone]), tuple(zip(edge[::2].tolist(), edge[1::2].tolist()))))
    assert got == sorted(want)
    return sum(int(g.sum()) for _, _, g in brute(rows))


def corpus(seed):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdeé ") for _ in range(rnd.randint(2, 8)))
    text = lambda n: " ".join(word() for _ in range(n))
    base = [text(120) for _ in range(6)]
    line = text(9)[:60]
    rows = []
    for _ in range(60):
        parts = [text(rnd.randint(0, 30)), line]
        for _ in range(rnd.randint(0, 3)):
            b = rnd.choice(base)
            i = rnd.randrange(len(b))
            parts.append(b[i : i + rnd.randint(40, 500)])
            if rnd.random() < 0.3:
                parts.append(line)
        s = "".join(parts)
        if rnd.random() < 0.4 and len(s) > 50:
            k = rnd.randrange(len(s))
            s = s[:k] + "#" + s[k + 1 :]
        rows.append(s)
    rows += [rows[3], rows[3], None, "", "x" * 99, "x" * 350, "ab" * 200, "\0" * 150, "aba" * 130, "x" * 100]
    return [(k * 3, t) for k, t in enumerate(rows)]


def test_ranges_match_brute_force(spark):
    assert compare(spark, corpus(1)) > 5000


def test_hot_anchors_are_dealt_by_string(spark):
    assert compare(spark, corpus(2), hot=2) > 5000


def test_contexts_and_ranges_beyond_what_is_sent(spark, monkeypatch):
    monkeypatch.setattr("colloquy.operators.joins.BROADCAST_BYTES", 10)
    assert compare(spark, corpus(3)) > 5000


def test_long_texts_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(R, "PIECE", 150)
    for t in ("", "a" * 99, "a" * 100, "a" * 700):
        strings = [(k + i) for k, p in R.pieces(t.encode()) for i in range(len(p) - 99)]
        assert strings == list(range(len(t) - 99))


def test_suffix_order_in_two_stages():
    rnd = random.Random(4)
    for _ in range(30):
        texts = [bytes(rnd.choice(b"ab\0") for _ in range(rnd.randint(100, 260))) for _ in range(4)]
        data, ends = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([len(t) for t in texts])
        at = R.suffix_order(data, ends)
        assert sorted(at.tolist()) == list(range(len(data)))
        begins = ends - [len(t) for t in texts]
        heads = [(k, i) for k, t in enumerate(texts) for i in range(len(t))]
        valid = [p for p in at if heads[p][1] + 100 <= len(texts[heads[p][0]])]
        first = [bytes(data[p : p + 100]) for p in valid]
        assert first == sorted(first)
        lcp = R.common_prefixes(R.packed(data), np.array(valid, dtype=np.int64))
        assert lcp.tolist() == [next((i for i in range(100) if x[i] != y[i]), 100) for x, y in zip(first, first[1:])]
        assert len(begins) == 4


def test_repeated_rows_null_ids_and_empty_tables(spark):
    t = "".join(random.Random(9).choices("abcdefghij", k=130))
    df = spark.createDataFrame([(1, t, 0), (1, t, 0), (None, "z" * 10, 0), (2, t, 0)], "doc_id long, text string, removed int")
    got = sorted((r.doc_id or 0, r.n_bytes, len(r.kept)) for r in R.without_repeats(df).collect())
    assert got == [(0, 10, 10), (1, 130, 130), (1, 130, 130), (2, 130, 0)]
    assert R.without_repeats(df.limit(0)).count() == 0


def letters(seed, n):
    return "".join(random.Random(seed).choices("abcdefghij ", k=n))


@pytest.mark.parametrize("hot", [R.HOT, 3])
def test_rows_that_share_a_doc_id_or_have_none(spark, hot):
    line = letters(1, 300)
    rows = [(1, letters(2, 50) + line), (2, letters(3, 200) + line + letters(4, 90)), (2, letters(5, 600)), (2, line), (2, letters(6, 20) + line + line)]
    assert compare(spark, rows, hot) == 300 * 4
    rows = [(None, line + "y" + line), (None, letters(7, 600)), (None, letters(8, 30) + line), (3, letters(9, 400)), (3, line + letters(10, 90)), (None, ""), (None, None)]
    assert compare(spark, rows, hot) == 300 * 2
    assert compare(spark, [(4, line + letters(11, 50)), (4, letters(12, 170) + line)], hot) == 0


@pytest.mark.parametrize("hot", [R.HOT, 3])
def test_a_third_of_all_rows_without_a_doc_id(spark, hot):
    rnd = random.Random(13)
    parts = [letters(20 + k, 150) for k in range(8)]
    rows = [(None if k % 3 == 0 else rnd.choice([k, 7]), "".join(rnd.choices(parts, k=rnd.randint(0, 3))) + letters(100 + k, rnd.randint(0, 200))) for k in range(90)]
    rows += [(None, rows[0][1])] * 30 + [(7, parts[0] * 2)] * 30
    assert compare(spark, rows, hot) > 5000


def test_texts_beyond_the_place_bits():
    rnd = random.Random(11)
    letters = np.frombuffer(b"abcdefghijklmnopqrstuvwxyz", np.uint8)
    text = letters[np.random.default_rng(11).integers(0, 26, 17 << 20)].tobytes()
    line = bytes(rnd.choice(b"abcdefgh") for _ in range(300))
    parts = [p for _, p in R.pieces(line + text + line)]
    of, start, n, anchor, context = R.runs_in_turn(parts)
    keys, counts = np.unique(np.stack([anchor, context]), axis=1, return_counts=True)
    base = np.cumsum([0, *[R.PIECE] * (len(parts) - 1)])
    again = np.isin(anchor, keys[0][counts > 1]) & np.isin(context, keys[1][counts > 1])
    starts = {int(base[o] + s + k) for o, s, m in zip(of[again], start[again], n[again]) for k in range(m)}
    end = len(text) + 300  # runs at the edges of the line have other contexts
    assert {*range(69, 132)} <= starts and {*range(end + 69, end + 132)} <= starts


def test_strings_of_hot_anchors_are_not_held_together(spark):
    rnd = random.Random(12)
    text = lambda n: "".join(rnd.choice("abcdefgh ") for _ in range(n))
    line = text(130)
    rows = [(k, text(rnd.randint(0, 150)) + line + text(150)) for k in range(150)]
    assert compare(spark, rows, hot=20) > 130 * 149
    items = [np.array([(0, 1, hot, 5)], R.FIRST).tobytes() for hot in (0, 1)]
    texts = spark.createDataFrame([(k, 0, line, bytearray(x)) for k, x in enumerate(items)], "doc_id long, row long, text string, packed binary")
    assert [r.doc_id for r in R.context_rows(texts).collect()] == [0]
