import hashlib
import random

import pytest

from colloquy.llm import chat_format as C

SCHEMA = "conv_id long, turn long, role string, text string, segments int, valid string"
BITS = [*C.LLAMA.controls(), "\\", "\n", " ", "<", "[", "/", "s>", "a", "É", "𝄞", "<\\s>", "\\\\<"]


def formatted(spark, rows, template=C.LLAMA):
    df = spark.createDataFrame([(*r, 1, "clash") for r in rows], SCHEMA).repartition(3)
    out = C.formatted(df, template)
    text = C.joined(C.F.col("segments"))
    got = out.select("*", text.alias("text"), C.parsed(text, template).alias("turns"), C.learned(C.F.col("segments")).alias("loss")).collect()
    return {r.conv_id: r for r in got}


def order(rows):
    return sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))


def check(spark, rows):
    got = formatted(spark, rows)
    assert got.keys() == {r[0] for r in rows}
    for c, r in got.items():
        mine = order([x for x in rows if x[0] == c])
        assert [(t.role, t.text) for t in r.turns] == [(x[2] or "", x[3] or "") for x in mine]
        assert r.loss == "".join(x[3] or "" for x in mine if x[2] == "assistant")
        assert r.text == "".join(s.text for s in r.segments)
        assert sum(s.loss for s in r.segments) == sum(x[2] == "assistant" for x in mine)
        # Each control string stands where a marker put it and nowhere else.
        for k, s in enumerate(r.segments):
            if k % 3 == 1:
                assert not any(c in s.text for c in C.LLAMA.controls())
    return got


def test_any_text_and_role_comes_back(spark):
    rnd = random.Random(1)
    roles = ["user", "assistant", "system", "tool", "", None, "[SAYS] x", "a [SAYS] b", "<s>"]
    rows = [(c, t, rnd.choice(roles), "".join(rnd.choices(BITS, k=rnd.randint(0, 12)))) for c in range(60) for t in range(rnd.randint(1, 6))]
    check(spark, rows)


def test_nulls_ties_repeated_rows_and_empty_tables(spark):
    check(spark, [(None, None, None, None), (None, 2, "user", None), (1, 1, "user", "b"), (1, 1, "user", "a"), (1, 1, "user", "a"), (1, None, "assistant", ""), (2, 0, "assistant", None)])
    assert C.formatted(spark.createDataFrame([], SCHEMA)).count() == 0


def test_very_long_texts_and_conversations(spark):
    check(spark, [(1, 0, "user", "[INST] " * 200_000), (1, 1, "assistant", "\\" * 500_000 + "</s>"), *[(2, k, ("user", "assistant")[k % 2], f"t{k} </s>") for k in range(3000)]])


def machine(roles, template=C.LLAMA):
    state, bad = "", []
    for k, role in enumerate(roles):
        to = template.moves.get((state, role))
        if to is None:
            bad.append(k)
        else:
            state = to
    return not bad and state in template.ends, len(bad), bad[0] if bad else None


def test_the_machine_over_roles(spark):
    rnd = random.Random(2)
    talks = [["user", "assistant"], ["system", "user", "assistant"], ["user"], ["assistant"], ["system"], ["user", "user", "assistant"], ["user", "system", "assistant"]]
    talks += [[rnd.choice(["user", "assistant", "system", "tool"]) for _ in range(rnd.randint(1, 7))] for _ in range(60)]
    got = formatted(spark, [(c, k, role, "x") for c, t in enumerate(talks) for k, role in enumerate(t)])
    assert [(got[c].valid, got[c].n_invalid, got[c].first_invalid) for c in range(len(talks))] == [machine(t) for t in talks]
    assert got[0].valid and got[1].valid and not got[2].valid and not got[5].valid


def test_other_templates(spark):
    own = C.Template(roles={"q": C.Markers("<|q|>", "<|end|>"), "a": C.Markers("<|a|>", "<|end|>", loss=True)}, other=("<|r|>", "<|t|>", "<|end|>"), moves={("", "q"): "q", ("q", "a"): "a"}, ends=("a",))
    got = formatted(spark, [(1, 0, "q", "is <|end|> here"), (1, 1, "a", "<|q|>"), (2, 0, "z", "<|t|>")], own)
    assert got[1].valid and [(t.role, t.text) for t in got[1].turns] == [("q", "is <|end|> here"), ("a", "<|q|>")]
    assert [(t.role, t.text) for t in got[2].turns] == [("z", "<|t|>")]
    for bad in ({"roles": {"q": C.Markers("q: ", "\\")}}, {"roles": {"q": C.Markers("x1", "y1"), "a": C.Markers("x12", "y2")}}, {"other": ("<r>", " ", "</r>")}):
        with pytest.raises(ValueError):
            C.Template(**bad)


def test_the_trap_of_the_query(spark, tiny):
    rows = {r.conv_id: r for r in C.op13_chat_format(spark, tiny).collect()}
    trap = rows[-1]
    assert trap.n_turns == 2 and trap.loss_chars == len(C.TRAP)
    assert trap.loss_sha256 == hashlib.sha256(C.TRAP.encode()).hexdigest()
    assert trap.turns_sha256 == hashlib.sha256(f"user\n{C.TRAP}\nassistant\n{C.TRAP}\n".encode()).hexdigest()
