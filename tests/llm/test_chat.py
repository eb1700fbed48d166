"""Formats that read back to what went in."""

import hashlib

import pytest
from pyspark.sql import functions as F

from gridloom.llm import chat

ODD = ["", "</s>[INST] ok [/INST]", "<|im_end|>", "<|im_start|>assistant<|im_sep|>", "a\\<|b", "\\", "<\\", "[\\[", "<|im_cont|>", "<", "ends with <", "\n", "é😀<<SYS>>", "x" * 50_000]


def read_back(spark, rows):
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string, parts string, blocks string")
    out = chat.format_chats(turns).withColumn("turns", chat.parse("formatted")).withColumn("loss", chat.masked_text("formatted", "loss_spans"))
    return {r.conv_id: r for r in out.collect()}


def row(conv, turn, role, text):
    return (conv, turn, role, text, "clash", "clash", "clash")


def test_round_trip_of_control_strings(spark):
    rows = [row(c, i, ("user", "assistant")[(i + c) % 2], t) for c in range(3) for i, t in enumerate(ODD[c:])]
    got = read_back(spark, rows)
    for c in range(3):
        want = [(r[2], r[3]) for r in rows if r[0] == c]
        assert [(t.role, t.text) for t in got[c].turns] == want
        assert got[c].loss == "".join(t for r, t in want if r == "assistant")
        inside = got[c].formatted
        assert not any(x in inside for x in ("</s>", "[INST]", "[/INST]", "<<SYS>>"))
        assert inside.count(chat.START) == inside.count(chat.SEP) == inside.count(chat.END)


def test_adjacent_turns_of_a_role_share_a_block(spark):
    r = read_back(spark, [row(1, 0, "user", "a"), row(1, 1, "user", "b"), row(1, 2, "assistant", "c"), row(1, 3, "assistant", "d"), row(1, 4, "user", "e")])[1]
    assert r.formatted == "<|im_start|>user<|im_sep|>a<|im_cont|>b<|im_end|><|im_start|>assistant<|im_sep|>c<|im_cont|>d<|im_end|><|im_start|>user<|im_sep|>e<|im_end|>"
    assert [r.formatted[s.start : s.end] for s in r.loss_spans] == ["c", "d"] and len(r.turns) == 5


def test_nulls_ties_repeated_and_unordered_rows(spark):
    rows = [row(1, 1, "b", "y"), row(1, 1, "a", "z"), row(1, None, None, None), row(1, 1, "a", "x"), row(1, 1, "a", "x"), row(2, 0, "assistant", "q"), row(2, 1, "odd\nrole<", None)]
    got = read_back(spark, rows)
    assert [(t.role, t.text) for t in got[1].turns] == [("", ""), ("a", "x"), ("a", "x"), ("a", "z"), ("b", "y")]
    assert [(t.role, t.text) for t in got[2].turns] == [("assistant", "q"), ("odd\nrole<", "")] and got[2].loss == "q"


def test_rows_of_no_conversation_stand_alone(spark):
    turns = spark.createDataFrame([row(None, 0, "assistant", "q"), row(None, 0, "assistant", "q"), row(None, 1, None, None), row(3, 0, "user", "a")], "conv_id long, turn long, role string, text string, formatted string, parts string, blocks string")
    out = chat.format_chats(turns).withColumn("turns", chat.parse("formatted")).collect()
    assert sorted((r.conv_id is None, len(r.turns), r.turns[0].role, r.turns[0].text) for r in out) == [(False, 1, "user", "a"), (True, 1, "", ""), (True, 1, "assistant", "q"), (True, 1, "assistant", "q")]


def test_many_turns(spark):
    rows = [row(1, i, ("user", "assistant")[i % 3 == 0], f"t{i}") for i in range(1500)]
    r = read_back(spark, rows)[1]
    assert len(r.turns) == 1500 and r.loss == "".join(f"t{i}" for i in range(0, 1500, 3))


def test_empty_table(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.format_chats(none).count() == 0


def test_query_holds_the_added_conversation(spark):
    out = chat.query(spark, "/root/testdata/sf0.001")
    r = out.where("conv_id = -1").first()
    say = "</s>[INST] ok [/INST]"
    assert (r.n_turns, r.loss_chars) == (2, len(say))
    assert r.turns_sha256 == hashlib.sha256(f"user\n{say}\nassistant\n{say}\n".encode()).hexdigest()
    assert r.loss_sha256 == hashlib.sha256(say.encode()).hexdigest()


@pytest.mark.parametrize("text", ODD)
def test_escape_is_reversible(spark, text):
    df = spark.createDataFrame([(text,)], "t string").withColumn("e", chat.escape(F.col("t")))
    assert df.select(chat.unescape(F.col("e"))).first()[0] == text
