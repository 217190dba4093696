import re

from colloquy.llm import quality_rules as R


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    wins = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    again = {i + k for i, w in enumerate(wins) if wins.count(w) > 1 for k in range(8)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    dup = sum(x in lines[:k] for k, x in enumerate(lines))
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(again))


TEXTS = [None, "", " \t\n\x0b", "one", "a b c d e f g h " * 3, "x " * 40, "\n a\na\n a\n\n \nÄ|€<>\U0001f600", "w1 w2 w3 w4 w5 w6 w7 w8 w9 w1 w2 w3 w4 w5 w6 w7 w8 z", "a b c d", " ".join(f"t{k % 57}" for k in range(500)), "only\rone\x0cline"]


def test_base_counts_match_brute_force(spark):
    docs = spark.createDataFrame([(k, t, "en", None, 7) for k, t in enumerate(TEXTS)], "doc_id long, text string, lang string, source string, n_words int")
    got = {r.doc_id: r for r in R.quality_rules(docs).collect()}
    assert len(got) == len(TEXTS)
    for k, t in enumerate(TEXTS):
        r = got[k]
        want = brute(t)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 20 or 100 * want[4] > 30 * want[0])
        assert not (r.kept and r.base_failed)


def test_odd_documents_of_a_group_fail_and_common_ones_stay(spark):
    plain = " ".join(f"word{k}" for k in range(60))
    rows = [(k, plain + f" end{k}", "en", "s") for k in range(150)]
    rows += [(1000, " ".join(f"word{k}$$$" for k in range(60)), "en", "s"), (1001, plain.upper(), "en", "s"), (1002, plain, None, None), (1002, plain, None, None)]
    got = R.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()
    assert len(got) == len(rows)
    assert {r.doc_id for r in got if not r.kept} == {1000, 1001}


def test_sketches_merge(spark):
    docs = spark.createDataFrame([(k, " ".join("ab" * (1 + k % 5) for _ in range(30 + k)), "en", f"s{k % 2}") for k in range(40)], "doc_id long, text string, lang string, source string")
    feats = R.features(docs)
    whole = R.quartiles(R.sketches(feats), [])
    parts = R.quartiles(R.sketches(feats.filter("doc_id < 13")).union(R.sketches(feats.filter("doc_id >= 13"))), [])
    assert sorted(whole.collect()) == sorted(parts.collect())


def test_very_long_texts(spark):
    long = " ".join(f"w{k * k % 7001}" for k in range(120_000))
    rows = [(1, long, "en", "s"), (2, "x" * 2_000_000, "en", "s"), (3, "same " * 100_000, "en", "s")]
    got = {r.doc_id: r for r in R.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    words = long.split()
    wins = {}
    for k in range(len(words) - 7):
        wins.setdefault(tuple(words[k : k + 8]), []).append(k)
    again = {k + j for at in wins.values() if len(at) > 1 for k in at for j in range(8)}
    assert (got[1].n_words, got[1].n_repeat_words) == (120_000, len(again))
    assert (got[2].n_words, got[2].word_chars, got[2].base_failed) == (1, 2_000_000, True)
    assert (got[3].n_repeat_words, got[3].base_failed) == (100_000, True)


def test_empty_table(spark):
    assert R.quality_rules(spark.createDataFrame([], "doc_id long, text string, lang string, source string")).count() == 0
