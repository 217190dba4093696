from pyspark.sql import functions as F

from colloquy.functions import text as T


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).first().y


def test_entities_are_decoded_twice(spark):
    assert one(spark, "I&#39;ll &amp;#39; &amp;amp; a", T.unescaped) == "I'll ' & a"


def test_notice_lines_go_and_messages_stay(spark):
    text = "hello\n[12:00:01] *** Message was NOT sent to x\nbye"
    assert one(spark, text, T.clean_body) == "hello bye"
    assert one(spark, "*** сообщение не было отправлено (x)", T.clean_body) == ""
    assert one(spark, "a \n  b\x1cc ", T.clean_body) == "a b c"
    assert one(spark, None, T.clean_body) == ""


def test_nicknames(spark):
    tail = r"(?i)\.?zz9relay\.(?:example|exmaple)$"
    for address, nick in (("bob@host", "bob"), (" bob@host> ", "bob"), ("twinzz9relay.example", "twin"), ("vjud.ZZ9relay.exmaple", "vjud"), ("zz9relay.example", "zz9relay.example"), ("a@b@c", "a"), ("plain", "plain"), (None, "")):
        assert one(spark, address, lambda c: T.nickname(c, tail)) == nick
    assert one(spark, "twinzz9relay.example", T.nickname) == "twinzz9relay.example"


def test_pair_header_and_lines(spark):
    rows = spark.createDataFrame([("b", "a", "2020-06-22 10:46:00", "2020-06-23 00:05:00")], "x string, y string, s string, e string").withColumns({"s": F.to_timestamp("s"), "e": F.to_timestamp("e")})
    got = rows.select(T.pair_key(F.col("x"), F.col("y")).alias("p"), T.pair_key(F.col("x"), F.col("x")).alias("q"), T.chunk_header(F.lit("a | b"), F.col("s"), F.col("e"), F.lit(1), F.lit(2)).alias("h"), T.chunk_header(F.lit("a | b"), F.col("s"), F.col("s"), F.lit(1), F.lit(1)).alias("k"), T.utterance_prefix(F.col("s"), F.col("x")).alias("u")).first()
    assert (got.p, got.q) == ("a | b", "b | b")
    assert got.h == "[대화] a | b | 2020-06-22~06-23 10:46~00:05 (1/2)"
    assert got.k == "[대화] a | b | 2020-06-22 10:46~10:46"
    assert got.u == "10:46 b: "


def test_labels(spark):
    names = {1: "meaning", 8: "accounts"}
    assert one(spark, "jabber_ru", T.corpus_of) == "ru"
    assert one(spark, "plain", T.corpus_of) == "plain"
    assert one(spark, 1, lambda c: T.question_type(c, F.lit(None).cast("string"), names), "int") == "1 meaning"
    assert one(spark, 7, lambda c: T.question_type(c, F.lit("x")), "int") == "7 x"
    assert one(spark, None, lambda c: T.question_type(c, F.lit("x")), "int") == ""
    assert one(spark, "pil_doc", lambda c: T.language_of(c, ("pl", "pil", "p"))) == "pil"
    assert one(spark, "zz", lambda c: T.language_of(c, ("pl",))) == "?"
    assert one(spark, "A-008", lambda c: T.evidence_type(c, names)) == "accounts"
    assert one(spark, None, lambda c: T.evidence_type(c, names)) == ""
    assert one(spark, "A-x", lambda c: T.evidence_type(c, names)) == ""
    assert one(spark, None, lambda c: T.oversize(c, 10), "int") is False
    assert one(spark, 11, lambda c: T.oversize(c, 10), "int") is True
