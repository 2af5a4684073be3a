"""Unusual JSON in arguments and schemas gives a defined result."""

import pytest

from strandmap.llm import tool_calls as T


@pytest.mark.parametrize("text", ["[" * 3000 + "]" * 3000, '"\\ud800"', "NaN", "[1e999]", "-Infinity", "{", "[" * 300 + "]" * 300])
def test_no_json(text):
    with pytest.raises((ValueError, RecursionError)):
        T.read_json(text)


def test_large_numbers_unions_and_strict_enums():
    assert T.violation(T.read_json("9" * 400), {"type": "integer"}) is None
    assert T.violation(None, {"type": ["integer", "null"]}) is None
    assert T.violation("x", {"type": ["integer", "null"]}) == "$: not integer or null"
    assert T.violation(True, {"enum": [1]}) == "$: not in enum"
    assert T.violation(1.0, {"enum": [1]}) is None
    assert T.violation(1.5, {"type": "integer"}) == "$: not integer"


def test_calls_with_unusual_arguments(spark):
    texts = ["[" * 3000 + "]" * 3000, '{"a": "\\ud800"}', '{"a": NaN}', '{"a": ' + "9" * 400 + "}", '{"a": 1}']
    calls = spark.createDataFrame([(1, str(i), i, "f", t) for i, t in enumerate(texts)], "conv_id long, call_id string, turn long, name string, arguments string")
    got = {r.call_id: r.error for r in T._parsed(calls, {"f": {"type": "object", "properties": {"a": {"type": "integer"}}}}).collect()}
    assert got == {"0": "no JSON", "1": "no JSON", "2": "no JSON", "3": None, "4": None}
