"""Tool calls linked, ordered, validated and written, against literals and a brute-force pass over the conversations."""

import json

from strandmap.llm import registry, tool_calls

SCHEMAS = {"sum": {"type": "object", "required": ["a"], "properties": {"a": {"type": "integer", "minimum": 0}, "b": {"type": "array", "items": {"type": "string"}}}, "additionalProperties": False}}


def test_links_order_and_validity(spark):
    calls = [(1, "x", 5, "sum", '{"b": ["é"], "a": {"$ref": "y"}}'), (1, "y", 6, "sum", '{"a": 1}'), (1, "x", 9, "sum", '{"a": 1}'), (1, "p", 1, "sum", '{"a": {"$ref": "q"}}'), (1, "q", 2, "sum", '{"a": {"$ref": "p"}}'), (2, "z", 1, "sum", '{"a": -1}'), (2, "w", 0, "other", "{}"), (2, "v", 3, "sum", "no"), (2, "u", 4, "sum", None), (None, "x", 1, "sum", '{"a": 1}'), (3, None, 1, "sum", '{"a": 1, "c": 2}')]
    results = [(1, "x", 7, "second"), (1, "x", 6, "first"), (1, "y", 8, None), (9, "k", 1, "lost"), (2, "z", 2, "r")]
    got = tool_calls.linked(spark.createDataFrame(calls, "conv_id long, call_id string, turn long, name string, arguments string").repartition(3), spark.createDataFrame(results, "conv_id long, call_id string, turn long, content string"), SCHEMAS).collect()
    by = {(r.conv_id, r.call_id, r.turn): r for r in got}
    assert len(got) == len(calls) + 1
    assert [(by[1, c, t].level, by[1, c, t].position, by[1, c, t].status) for c, t in (("y", 6), ("x", 5), ("p", 1), ("q", 2), ("x", 9))] == [(0, 1, "linked"), (1, 2, "linked"), (None, 3, "cycle"), (None, 4, "cycle"), (None, None, "repeated")]
    assert by[1, "x", 5].json == '{"arguments":{"a":{"$ref":"y"},"b":["é"]},"id":"x","name":"sum","result":"first"}'
    assert [by[2, c, t].error for c, t in (("z", 1), ("w", 0), ("v", 3), ("u", 4))] == ["$.a: bounds", "unknown tool", "no JSON", "$.a: missing"]
    assert by[3, None, 1].error == "$.c: unknown" and by[9, "k", 1].status == "orphan" and by[2, "u", 4].status == "unanswered"


def test_conversations_equal_brute_force(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").orderBy("conv_id", "turn").collect()
    want: dict[tuple, list] = {}
    asked = None
    for k, r in enumerate(rows):
        if k and rows[k - 1].conv_id != r.conv_id:
            asked = None
        if r.role == "user":
            asked = r.turn
            want[r.conv_id, f"call-{asked}"] = [r.text, None]
        elif r.role == "assistant" and asked is not None and want[r.conv_id, f"call-{asked}"][1] is None:
            want[r.conv_id, f"call-{asked}"][1] = r.text
    got = {(r.conv_id, r.call_id): r for r in registry.op4_tool_calls(spark, "/root/testdata/sf0.001").collect() if r.status != "orphan"}
    assert set(got) == set(want)
    for key, (text, answer) in want.items():
        assert json.loads(got[key].json) == {"arguments": {"text": text}, "id": key[1], "name": "reply", "result": answer} and got[key].valid
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert tool_calls.linked(*tool_calls.of_conversations(none), tool_calls.REPLY).count() == 0
