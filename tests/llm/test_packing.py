from collections import defaultdict

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st

from tokenizers import Tokenizer

from colloquy.llm import packing as P

PATH = public_tokenizers.path("byte_bpe_50k.json")


def plain_open_size(length, later, lengths, overhead):
    """Fills each permitted length in thought, looking at all pieces to come from the longest on."""
    costs = []
    for size in lengths:
        if size >= length:
            held = length
            for n in sorted(later, reverse=True):
                if held + n <= size:
                    held += n
            costs.append(((size + overhead) / held, size))
    return min(costs)[1]


@given(st.integers(1, 64), st.lists(st.integers(1, 64), max_size=40), st.integers(0, 9))
@settings(max_examples=300, deadline=None)
def test_the_opened_size_costs_least(length, later, overhead):
    later = sorted(x for x in later if x <= length)
    for lengths in ((64,), (16, 32, 64), (8, 24, 40, 64)):
        assert P.open_size(length, later, lengths, overhead) == plain_open_size(length, later, lengths, overhead)


def plain_best_fit(sizes, lengths):
    """Open bins of the longest length only, found by looking at all of them."""
    room, bins = [], []
    for n in sizes:
        fit = [(r, b) for b, r in enumerate(room) if r >= n]
        b = min(fit)[1] if fit else len(room)
        if not fit:
            room.append(lengths[-1])
        room[b] -= n
        bins.append(b)
    return bins


@given(st.lists(st.integers(1, 64), max_size=80), st.sampled_from([(64,), (16, 32, 64), (8, 64)]))
@settings(max_examples=200, deadline=None)
def test_bins_hold_their_pieces_and_are_as_short_as_can_be(sizes, lengths):
    sizes = sorted(sizes, reverse=True)
    bins, offsets, out = P.pack(sizes, lengths, 2)
    held = defaultdict(list)
    for n, b, o in zip(sizes, bins, offsets):
        held[b].append((o, n))
    assert sorted(held) == list(range(len(out)))
    for b, got in held.items():
        at = 0
        for o, n in sorted(got):
            assert o == at
            at += n
        assert out[b] == min(x for x in lengths if x >= at)
    if len(lengths) == 1:
        assert bins == plain_best_fit(sizes, lengths)


def test_joint_sizes_cost_no_more_than_one_size():
    import random

    rnd = random.Random(3)
    sizes = sorted((min(4096, int(rnd.lognormvariate(5.5, 1.2)) + 1) for _ in range(3000)), reverse=True)
    cost = lambda out: sum(x + P.OVERHEAD for x in out)
    assert cost(P.pack(sizes)[2]) <= cost(P.pack(sizes, (4096,))[2])
    assert sum(sizes) / sum(P.pack(sizes)[2]) > 0.97


ROWS = [(k, "w " * (k * 37 % 300), 1) for k in range(150)] + [(500, None, 1), (501, "", 1), (None, "a b", 1), (None, "a b", 1), (7, "w " * 259, 1), (7, "w " * 259, 1), (600, "Ä long text. " * 10_000, 1)]


def ids_of(text):
    got = Tokenizer.from_file(PATH).encode(text or "", add_special_tokens=False).ids
    return [*got, P.END_ID] if got else []


def test_every_token_is_packed_once(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, bin int")
    got = P.best_fit(docs, PATH, shard=60).collect()
    assert len({r.shard for r in got if r.shard is not None}) >= 3
    want, have = defaultdict(int), defaultdict(int)
    for d, t, _ in ROWS:
        want[d] += len(ids_of(t))
    at = defaultdict(list)
    for r in got:
        have[r.doc_id] += r.n_tokens
        if r.n_tokens:
            at[r.shard, r.bin, r.bin_length].append((r.bin_offset, r.n_tokens))
    assert want == have
    assert len(at) == len({k[:2] for k in at})
    for (_, _, length), parts in at.items():
        assert all(a + n == b for (a, n), (b, _) in zip(sorted(parts), sorted(parts)[1:]))
        assert sum(n for _, n in parts) <= length


def test_sequences_hold_the_ids_of_their_documents(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, bin int").repartition(3)
    pieces, bins = defaultdict(list), P.sequences(docs, PATH, shard=60).collect()
    for r in bins:
        ids = np.frombuffer(r.ids, "<u2").tolist()
        assert len(ids) == r.n_tokens <= r.bin_length
        for p in r.pieces:
            pieces[p.doc_id].append((p.part, p.start, ids[p.bin_offset : p.bin_offset + p.n_tokens]))
    for d in {d for d, t, _ in ROWS}:
        want = sorted((k, k * 4096, ids[k * 4096 : (k + 1) * 4096]) for e, t, _ in ROWS if e == d for ids in [ids_of(t)] for k in range(-(-len(ids) // 4096)))
        assert sorted(pieces[d]) == want, d


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert P.best_fit(docs, PATH).count() == 0 and P.sequences(docs, PATH).count() == 0
