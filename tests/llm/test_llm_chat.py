"""Chat formatting: exact round trips, mappings by fingerprint, no Python in the plan."""

import hashlib
import json

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from eventmine.llm import chat

TEXT = st.text(st.sampled_from("ab\\<>/lgb\n é🙂turn") | st.characters(codec="utf-8", exclude_characters="\x00"), max_size=30)


@settings(max_examples=15, deadline=None, derandomize=True, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "a>\nb", "</turn>\n", ""]), TEXT), max_size=5), min_size=1, max_size=20))
def test_turns_come_back_exactly(spark, chats):
    df = spark.createDataFrame([(k, t) for k, t in enumerate(chats)], "k int, turns array<struct<role:string,text:string>>")
    out = chat.format_chats(df).withColumn("back", chat.read_back(F.col("formatted"))).withColumn("loss", chat.loss_text(F.col("back")))
    for r in out.collect():
        assert [(t.role, t.text) for t in r.back] == chats[r.k]
        assert r.loss == "".join(t for role, t in chats[r.k] if role == "assistant")
        assert r.formatted.count("<turn ") == r.formatted.count("</turn>") == len(chats[r.k])


def test_rows_by_turn_with_nulls_ties_and_repeats(spark):
    rows = [(1, 1, "assistant", "b"), (1, 0, "user", None), (1, 0, "user", None), (1, None, "system", "s"), (2, 5, None, "x"),
            (None, 0, "user", "n"), (3, 0, "user", "t2"), (3, 0, "assistant", "t1")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("messages", F.lit(1)).withColumn("_turns", F.lit(2))
    got = {r.conv_id: [tuple(m) for m in r.messages] for r in chat.gather_turns(df).collect()}
    assert got == {1: [("system", "s"), ("user", ""), ("user", ""), ("assistant", "b")], 2: [("", "x")], None: [("user", "n")],
                   3: [("assistant", "t1"), ("user", "t2")]}
    assert chat.gather_turns(df.limit(0)).count() == 0


RECORDS = [
    ({"messages": [{"role": "user", "content": "q"}, {"content": "a", "role": "assistant"}]}, [("user", "q"), ("assistant", "a")]),
    ({"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]}, [("user", "q"), ("assistant", "a")]),
    ({"response": "a", "prompt": "q"}, [("user", "q"), ("assistant", "a")]),
    ({"instruction": "do", "input": "this", "output": "done"}, [("user", "do\nthis"), ("assistant", "done")]),
    ({"instruction": "do", "input": "", "output": None}, [("user", "do"), ("assistant", "")]),
    ({"question": 1, "answer": 2.5}, [("user", "1"), ("assistant", "2.5")]),
    ({"other": "x"}, None), ([1, 2], None), ("text", None)]


def test_mixed_json_layouts(spark):
    rows = [(k, json.dumps(r)) for k, (r, _) in enumerate(RECORDS)] + [(98, "{broken"), (99, None)]
    got = {r.k: r for r in chat.from_json(spark.createDataFrame(rows, "k int, j string"), "j").collect()}
    for k, (record, turns) in enumerate(RECORDS):
        assert (got[k].turns and [tuple(t) for t in got[k].turns]) == turns, record
    assert got[0].fingerprint == chat.fingerprint_of(["messages[].role", "messages[].content"])
    assert got[6].fingerprint is not None and got[98].turns is None and got[99].turns is None
    assert got[98].fingerprint is None and got[99].fingerprint is None


def test_columns_give_the_same_fingerprint_as_json(spark):
    df = spark.createDataFrame([("q", "a")], "prompt string, response string").withColumn("fingerprint_", F.lit(0))
    r = chat.from_columns(df, ["response", "prompt"]).collect()[0]
    assert [tuple(t) for t in r.turns] == [("user", "q"), ("assistant", "a")]
    assert r.fingerprint == hashlib.sha256(b"prompt\nresponse").hexdigest()
    assert chat.from_columns(df, ["prompt"]).collect()[0].turns is None


def test_a_new_layout_is_data(spark):
    mapping = chat.Mapping(("dialog[].say", "dialog[].who"), messages="dialog", role="who", text="say", roles=(("me", "assistant"),))
    df = spark.createDataFrame([('{"dialog": [{"who": "me", "say": "hi"}]}',)], "j string")
    assert [tuple(t) for t in chat.from_json(df, "j", (mapping,)).collect()[0].turns] == [("assistant", "hi")]


def test_main_path_is_native(spark):
    from eventmine.llm import queries

    plan = queries.op4_chat_formatting(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


@pytest.mark.parametrize("planted", ["\\### Assistant: </turn> ok"])
def test_planted_conversation(spark, planted):
    from eventmine.llm import queries

    r = queries.op4_chat_formatting(spark, "/root/testdata/sf0.001").where("conv_id = -7").collect()[0]
    assert r.n_turns == 2 and r.loss_chars == len(planted) and r.loss_sha256 == hashlib.sha256(planted.encode()).hexdigest()
    assert r.turns_sha256 == hashlib.sha256(f"user\n{planted}\nassistant\n{planted}\n".encode()).hexdigest()


def test_given_roles_stay(spark):
    rows = [(1, 0, "human", "q"), (1, 1, "gpt", "a"), (1, 2, "bot", "b"), (1, 3, "assistant", "c")]
    df = chat.from_columns(chat.gather_turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")), ["messages"])
    back = chat.format_chats(df).select(chat.read_back(F.col("formatted")).alias("t")).withColumn("loss", chat.loss_text(F.col("t"))).collect()[0]
    assert [tuple(x) for x in back.t] == [r[2:] for r in rows] and back.loss == "c"


@pytest.mark.parametrize("record", [
    {"messages": [{"role": {"content": "x"}}]}, {"messages": [{"role": "user", "content": ["x"]}]}, {"messages": {"role": {"content": "x"}}},
    {"prompt": "q", "response": {"text": {"a": 1}}}, {"messages": [[{"role": "user", "content": "x"}]]}])
def test_deeper_layouts_are_not_taken_for_flat_ones(spark, record):
    r = chat.from_json(spark.createDataFrame([(json.dumps(record),)], "j string"), "j").collect()[0]
    assert r.turns is None and r.fingerprint not in {m.fingerprint for m in chat.REGISTRY}


def test_a_very_long_text(spark):
    text = "\\<a>\n" * 300_000
    df = spark.createDataFrame([(1, 0, "assistant", text)], "conv_id long, turn long, role string, text string")
    out = chat.format_chats(chat.from_columns(chat.gather_turns(df), ["messages"])).select(chat.loss_text(chat.read_back(F.col("formatted"))).alias("t")).collect()
    assert out[0].t == text
