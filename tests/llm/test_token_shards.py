import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from colloquy.llm import token_shards as T

PATH = public_tokenizers.path("byte_bpe_50k.json")


@given(st.lists(st.integers(0, 5000), max_size=300))
@settings(max_examples=60, deadline=None)
def test_elias_fano_gives_back_what_it_was_built_from(gaps):
    values = np.cumsum(np.array(gaps, dtype=np.int64))
    ef = T.EliasFano.build(values)
    assert ef.all().tolist() == values.tolist()
    assert [ef.select(i) for i in range(len(values))] == values.tolist()


@given(st.lists(st.text(alphabet=st.sampled_from("aB é'.\n\t   ß1!\r\x1c"), max_size=40), max_size=6))
@settings(max_examples=150, deadline=None)
def test_words_encode_as_whole_texts(texts):
    texts = [*texts, "It's a  test\n\n of words \n", "<|endoftext|> in a text", " lead", "\nx", "x\n"]
    tok = Tokenizer.from_file(PATH)
    want = [tok.encode(t, add_special_tokens=False).ids for t in texts]
    got = [np.frombuffer(b, "<u2").tolist() for b in T.encoder(PATH).batch(texts)]
    assert got == want


def test_round_trip(spark, tmp_path):
    tok = Tokenizer.from_file(PATH)
    texts = {5: "b c", 1: None, 9: "", 7: "x " * 30000, 3: "Élan!\n\nvital", None: "null id"}
    rows = [(k, t, "u") for k, t in texts.items()]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    manifest = T.write_shards(docs.union(docs.filter("doc_id = 5")), str(tmp_path / "s"), PATH, 2, shard_ids=20)
    got = sorted(T.read_shards(manifest, str(tmp_path / "s")).collect(), key=lambda r: r.start)
    digests = {(r.doc_id, r.start): r for r in T.shard_digests(manifest, str(tmp_path / "s")).collect()}
    at = 0
    assert [r.doc_id for r in got] == [None, 1, 3, 5, 5, 7, 9]
    for r in got:
        want = tok.encode(texts[r.doc_id] or "", add_special_tokens=False).ids + [2]
        assert (r.start, r.n_tokens, r.ids) == (at, len(want), want)
        assert digests[r.doc_id, r.start].ids_crc32 == zlib.crc32(np.array(want, "<u4").tobytes())
        at += len(want)


def test_empty_table(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert T.shard_digests(T.write_shards(docs, str(tmp_path / "s"), PATH, 2), str(tmp_path / "s")).count() == 0


def test_a_file_of_another_format_is_refused():
    with pytest.raises(ValueError):
        T.parse_shard(b"x" * 64)


def test_other_tokenizers_encode_whole_texts():
    path = public_tokenizers.path("word_bpe_49k.json")
    texts = ["Don't  stop 123\n\nnow", "", "É a", "x" * 300, " a  b "]
    enc, tok = T.WordEncoder(path), Tokenizer.from_file(path)
    got = [np.frombuffer(b, enc.wide).tolist() for b in enc.batch(texts)]
    assert got == [tok.encode(t, add_special_tokens=False).ids for t in texts]
    assert T.WordEncoder(public_tokenizers.path("byte_bpe_50k.json")).wordwise


def test_a_known_text_takes_one_look_at_each_word():
    """Known words are not gathered into a set again; new ones, long ones and white space beside a blank still give the tokenizer's ids."""
    import public_tokenizers

    from colloquy.llm.token_shards import LONG_WORD, WordEncoder

    enc = WordEncoder(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["some known words, here", "a\nline and  two blanks", "", "w" * (LONG_WORD + 9) + " x " + "y" * (LONG_WORD + 5), " lead", "tail "] * 3
    want = [e for t in texts for e in enc._encode([t])]
    for _ in range(3):
        assert enc.batch(texts) == want
    assert not enc.learning and not any(len(w) > LONG_WORD for w in enc.known if w)
    assert enc.batch(["some known words, here", "some newer words"]) == enc._encode(["some known words, here", "some newer words"])
