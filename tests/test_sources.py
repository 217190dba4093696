import random

import pytest
from pyspark.sql import functions as F

from colloquy.operators import joins as N
from colloquy.operators import retrieve as R
from colloquy.operators import translate as X
from colloquy.plans import jobs as J
from colloquy.sources import tables as S


def csv_text(rows, end="\n"):
    cell = lambda v: "" if v is None else '"' + v.replace('"', '""') + '"' if any(c in v for c in '",\n\r') or v == "" else v
    return end.join(["id,a,b", *(f"{k},{cell(a)},{cell(b)}" for k, a, b in rows)]) + end


@pytest.mark.parametrize("split", [64, 700, 1 << 20])
@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_a_csv_file_is_read_by_many_tasks(spark, tmp_path, split, end):
    rnd = random.Random(split)
    bits = ["word", '"', ",", "\n", "\n\n", "é", " ", '""', "x" * 90]
    for name in ("one", "two"):
        rows = [(k, "".join(rnd.choices(bits, k=rnd.randint(0, 9))) or None, rnd.choice(["plain", "end\n", None, "y" * 300 + "\n" * 4])) for k in range(60)]
        (tmp_path / f"{name}.csv").write_bytes(csv_text(rows, end).encode())
    schema = "id int, a string, b string"
    want = sorted(map(str, spark.read.schema(schema).csv(str(tmp_path), header=True, multiLine=True, quote='"', escape='"').collect()))
    conf = {"spark.sql.files.maxPartitionBytes": str(split), "spark.sql.files.openCostInBytes": "0"}
    before = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        got = S.read_csv_rows(spark, str(tmp_path), schema)
        assert sorted(map(str, got.collect())) == want and len(want) == 120
        assert split > 700 or S.csv_records(spark, str(tmp_path / "one.csv")).select(F.spark_partition_id()).distinct().count() > 1
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_a_batch_reads_only_the_buckets_of_its_keys(spark, tmp_path):
    path = str(tmp_path / "cache")
    rows = [(k % 3, f"key {k % 200}", f"value {k}") for k in range(600)]
    for step in range(3):
        S.add_to_cache(spark.createDataFrame([r for r in rows if r[0] == step], S.CACHE), path)
    asked = spark.createDataFrame([("key 5",), ("key 17",), ("new",)], "en string")
    got = S.cached_of(asked, path)
    wanted = {r[0] for r in asked.select(S.cache_bucket(F.col("en"))).collect()}
    assert {int(f.split("bucket=")[1].split("/")[0]) for f in got.inputFiles()} <= wanted and got.count() < 60
    latest = {r.en: r.ko for r in X.latest(got).collect()}
    last = {en: ko for seq, en, ko in sorted(rows)}
    assert latest["key 5"] == last["key 5"] and latest["key 17"] == last["key 17"] and "new" not in latest
    everything = spark.createDataFrame([(f"key {k}",) for k in range(200)], "en string")
    files = len(S.cached_of(everything, path).inputFiles())
    assert S.compact_cache(spark, path, least=4) == 0 and S.compact_cache(spark, path, least=3) > 50
    rows_left = S.cached_of(everything, path)
    assert {r.en: r.ko for r in X.latest(rows_left).collect()} == last and rows_left.count() == 200 and len(rows_left.inputFiles()) < files
    assert S.cached_of(asked, str(tmp_path / "none")).count() == 0


TEXTS = ["", "a", "ab", "a" * 5000, "a" * 5000 + "b", "é"]


@pytest.mark.parametrize("how", ["inner", "left", "left_anti", "left_semi"])
def test_joins_by_keys_of_texts(spark, how):
    left = spark.createDataFrame([(k, t) for k, t in enumerate([*TEXTS, None, "a"])], "k int, body string")
    right = spark.createDataFrame([(t, n) for n, t in enumerate(["a", "é", "a" * 5000, None, "zz"])], "en string, n int")
    got = N.join_texts(left, "body", right, "en", how)
    want = left.join(right, F.col("body") == F.col("en"), how)
    assert got.columns == want.columns and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    keys = [line for line in N.join_texts(left, "body", right.hint("merge"), "en", how)._jdf.queryExecution().sparkPlan().toString().split("\n") if "Join" in line]
    assert keys and all("body" not in line.split("]")[0] for line in keys)  # the keys of the join hold no text


def test_distinct_texts(spark):
    df = spark.createDataFrame([(t,) for t in [*TEXTS, *TEXTS, None]], "body string").repartition(3)
    assert sorted(r.body for r in N.distinct_texts(df.filter("body is not null"), "body").collect()) == sorted(TEXTS)


def test_one_prompt_that_fails_leaves_the_others_translated(spark, tmp_path):
    log = str(tmp_path / "asked")

    def make():
        def run(prompts):
            with open(log, "a") as f:
                f.write(f"{len(prompts)}\n")
            if any("poison" in p for p in prompts):
                raise RuntimeError("out of memory")
            return [p.upper() for p in prompts]

        return run

    bodies = [f"{'y' * 320} {k}" for k in range(99)] + ["poison " + "x" * 320]  # long ones are packs of their own
    got = {r.body: r.text for r in X.translated(spark.createDataFrame([(b,) for b in bodies], "body string").coalesce(1), make, shards=1).collect()}
    assert got == {b: b if "poison" in b else b.upper() for b in bodies}
    with open(log) as f:
        asked = [int(x) for x in f]
    assert sum(asked) < 100 * 4  # halves of a batch of 100, and the one alone once more
    assert X.answered(lambda p: p[:-1], ["a", "b"]) == ["", ""]


def test_each_text_is_encoded_once_for_each_model(spark, tmp_path, monkeypatch):
    log = str(tmp_path / "encoded")

    def logged(name):
        def make():
            def encode(texts):
                with open(log, "a") as f:
                    f.writelines(f"{name} {t}\n" for t in texts)
                import numpy as np

                return np.array([[len(t), 1.0] for t in texts], dtype=np.float32)

            return encode

        return make

    from colloquy.operators import encode as E

    monkeypatch.setattr(E, "ENCODERS", {m: logged(m) for m in ("hash-a", "hash-b")})
    chunks = spark.createDataFrame([("d_en", k, f"text{k}") for k in range(9)], "tag string, chunk_index int, text string")
    questions = chunks.filter("chunk_index < 3").select(F.concat(F.lit("q"), "chunk_index").alias("qid"), "tag", F.lit("en").alias("corpus"), F.concat(F.lit("ask "), "text").alias("question"), F.lit("1 x").alias("qtype"), F.array("chunk_index").alias("gold"))
    table = str(tmp_path / "vectors")
    rows = J.evaluate_job(questions, chunks, list(J.CONFIGS), table=table)
    assert rows.groupBy("config").count().count() == len(J.CONFIGS)
    with open(log) as f:
        lines = sorted(f.read().splitlines())
    assert lines == sorted([f"{m} text{k}" for m in ("hash-a", "hash-b") for k in range(9)] + [f"{m} ask text{k}" for m in ("hash-a", "hash-b") for k in range(3)])
    J.evaluate_job(questions, chunks, ["aa-dense"], table=table).collect()
    with open(log) as f:
        assert len(f.read().splitlines()) == len(lines) + 3  # the questions; the table has the rest


def test_vectors_of_one_model_have_one_length(spark):
    rows = spark.createDataFrame([("a", [1.0, 2.0]), ("a", [1.0, 2.0]), ("b", [1.0]), ("a", None)], "model string, embedding array<double>")
    R.check_dimensions(rows)
    with pytest.raises(ValueError, match="'a'"):
        R.check_dimensions(rows.unionByName(spark.createDataFrame([("a", [1.0])], rows.schema)))


def test_the_raw_table_is_read_and_decoded_once(spark, tmp_path):
    log = str(tmp_path / "read")

    def read(batches):
        for b in batches:
            with open(log, "a") as f:
                f.write(f"{len(b)}\n")
            yield b

    rows = [(k, k * 100, f"u{k % 4}@x", f"b{k % 3}@x", f"body {k % 9} &amp; more", f"text {k % 9}") for k in range(200)]
    raw = spark.createDataFrame(rows, "src_row long, t long, `from` string, `to` string, body string, body_en string").selectExpr("src_row", "timestamp_seconds(t) as ts", "`from`", "`to`", "body", "body_en")
    kept, counts = J.clean_job(raw.mapInPandas(read, raw.schema))
    chunks = J.chunk_job(kept)
    assert counts.first().n_input == 200 and chunks.count() > 0
    with open(log) as f:
        assert sum(map(int, f)) == 200
    plan = chunks._jdf.queryExecution().optimizedPlan().toString()
    assert all("PARTITION" not in line or "windowspecdefinition(" in line for line in plan.split("\n"))
    for line in plan.split("\n"):
        if "windowspecdefinition(" in line:
            assert "], [" in line and ", [], [" not in line  # each window has keys to be dealt by
