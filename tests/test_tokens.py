import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import functions as F

from colloquy.functions import tokens as N
from colloquy.operators import chunks as C
from colloquy.plans import jobs as J

PATH = public_tokenizers.path("byte_bpe_50k.json")


def ids_of(text):
    return N.loaded(PATH).encode(text, add_special_tokens=False).ids


TEXTS = ["plain words here", "", None, "Ünïcode 한국어 𝄞 text", "<|endoftext|> is text", "long " * 300 + "한국어" * 40]


def test_counts_and_ids_are_the_tokenizers(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "k int, text string").repartition(2)
    got = {r.k: (r.n, r.ids, r.back) for r in df.select("k", N.count(PATH)("text").alias("n"), N.ids(PATH)("text").alias("ids")).withColumn("back", N.text_of(PATH)("ids")).collect()}
    for k, t in enumerate(TEXTS):
        assert got[k] == (len(ids_of(t or "")), ids_of(t or ""), t or "")


def test_cuts_by_ids(spark):
    rows = [(k, t, n) for k, t in enumerate(TEXTS) for n in (1, 2, 3, 7)]
    df = spark.createDataFrame(rows, "k int, text string, n int").select("k", "n", N.cut(PATH)(F.lit("10:00 ann: "), F.coalesce("text", F.lit("")), F.col("n")).alias("pieces"))
    got = {(r.k, r.n): r.pieces for r in df.collect()}
    for k, t, n in rows:
        ids = ids_of(t or "")
        step = -(-len(ids) // n)
        want = [t or ""] if n == 1 or not ids else [N.loaded(PATH).decode(ids[i * step : (i + 1) * step], skip_special_tokens=False).strip() or "…" for i in range(n)]
        assert got[k, n] == ["10:00 ann: " + x for x in want]


def test_chunks_of_a_tokenizers_ids(spark):
    rows = [(k, 60 * k, "a@h", "b@h", f"Wörter {k} " * (k % 5 + 1), f"words {k}! " * (k % 7 + 1)) for k in range(40)] + [(90, 5000, "b@h", "a@h", "длинный текст " * 90, "a very long text, " * 200)]
    raw = spark.createDataFrame(rows, "src_row long, t long, `from` string, `to` string, body string, body_en string").selectExpr("src_row", "timestamp_seconds(t) as ts", "`from`", "`to`", "body", "body_en")
    size, overlap = 160, 40
    got = J.chunk_job(J.clean_job(raw)[0], size=size, overlap=overlap, count=N.count(PATH), cut=N.cut(PATH)).collect()
    # The same from the messages by hand: lines of the English bodies, cut and planned by their ids.
    for corpus, body in (("en", 5), ("ru", 4)):
        lines, plan = [], []
        for r in rows:
            prefix = f"{r[1] // 3600:02d}:{r[1] // 60 % 60:02d} {r[2][0]}: "
            k = max(1, -(-len(ids_of(prefix + r[5].strip())) // (size - C.HEADER_TOKENS)))
            for x, into in ((r[body].strip(), lines), (r[5].strip(), plan)):
                ids = ids_of(x)
                step = -(-len(ids) // k)
                into += [prefix + x] if k == 1 else [prefix + (N.loaded(PATH).decode(ids[i * step : (i + 1) * step]).strip() or "…") for i in range(k)]
        spans = C.plan_spans(np.array([len(ids_of(x)) for x in plan]), size - C.HEADER_TOKENS, overlap)
        mine = sorted((r for r in got if r.corpus == corpus), key=lambda r: r.chunk_index)
        assert [r.text.split("\n")[1:] for r in mine] == [lines[a:b] for a, b in spans]
        assert [r.n_tokens for r in mine] == [sum(len(ids_of(x)) for x in lines[a:b]) + C.HEADER_TOKENS for a, b in spans]


def test_windows_of_ids(spark):
    df = spark.createDataFrame([(1, TEXTS[-1]), (2, "short"), (3, "")], "k int, text string")
    got = C.sliding_windows(df, N.ids(PATH)("text"), 64, 16, N.text_of(PATH)).orderBy("k", "chunk_index").collect()
    ids = ids_of(TEXTS[-1])
    assert [(r.token_start, r.token_end) for r in got if r.k == 1] == [(s, min(s + 64, len(ids))) for s in range(0, max(1, len(ids) - 16), 48)]
    assert all(r.chunk == N.loaded(PATH).decode((ids if r.k == 1 else ids_of("short"))[r.token_start : r.token_end]) for r in got) and {r.k for r in got} == {1, 2}


def test_texts_are_encoded_in_slices_of_bounded_size(spark):
    """One batch of a table may hold 10,000 texts; their encodings together took gigabytes of a worker."""
    texts = ["some words " * 5_000, None, "", *["some words " * 2_000] * 60, "end"]
    parts = list(N._encodings(PATH, pa.array(texts)))
    assert len(parts) > 1 and sum(map(len, parts)) == len(texts)
    longest = max(len(t or "") for t in texts)
    at = 0
    for part in parts:
        assert sum(len(t or "") for t in texts[at : at + len(part)]) < N.SLICE_BYTES + longest
        at += len(part)
    assert list(N._encodings(PATH, pa.array([], pa.string()))) == []


def test_a_windows_row_does_not_carry_its_whole_document(spark):
    df = spark.createDataFrame([(1, "a b c")], "k int, text string")
    got = C.sliding_windows(df, F.split("text", " "), 2, 1)
    plan = got.select("k", "chunk")._jdf.queryExecution().optimizedPlan().toString()
    assert [line for line in plan.splitlines() if "Generate" in line and "[" in line]
    assert all("__t" not in line for line in plan[: plan.index("Generate")].splitlines())
