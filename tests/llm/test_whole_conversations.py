"""Every message of a conversation is in a row's JSON."""

import json
from collections import Counter

from strandmap.llm import registry, tool_calls


def test_every_message_is_in_a_row(spark, tmp_path):
    rows = [(1, 0, "system", "be kind"), (1, 1, "user", "hi"), (1, 2, "assistant", "one"), (1, 3, "assistant", "two"), (1, 3, "assistant", "two"), (1, 4, "tool", "t"), (1, 5, None, "n"), (1, 6, "user", "bye"), (2, 0, "assistant", "a"), (2, 1, "assistant", "b"), (None, 0, "user", "u"), (None, 1, "assistant", "v"), (None, 1, "assistant", "w"), (3, None, "user", "x")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = registry.op4_tool_calls(spark, str(tmp_path)).collect()
    said = Counter()
    for r in got:
        j = json.loads(r.json)
        said.update(x for x in ((j["arguments"] or {}).get("text"), j["result"]) if x is not None)
    assert said == Counter(r[3] for r in rows)
    assert Counter((r.status, r.name, json.loads(r.json)["result"]) for r in got if r.name != "reply") == Counter({("orphan", "system", "be kind"): 1, ("orphan", "tool", "t"): 1, ("orphan", None, "n"): 1, ("repeated", "assistant", "two"): 2, ("orphan", "assistant", "a"): 1, ("orphan", "assistant", "b"): 1, ("orphan", "assistant", "v"): 1, ("orphan", "assistant", "w"): 1})


def test_each_orphaned_result_is_a_row(spark):
    calls = spark.createDataFrame([], "conv_id long, call_id string, turn long, name string, arguments string")
    results = [(1, None, 1, "a"), (1, None, 2, "b"), (None, "k", 1, "c"), (None, "k", 1, "d"), (1, "k", 1, "e"), (1, "k", 2, "f")]
    got = tool_calls.linked(calls, spark.createDataFrame(results, "conv_id long, call_id string, turn long, content string"), {}).collect()
    assert sorted((r.status, json.loads(r.json)["result"]) for r in got) == [("orphan", x) for x in "abcdef"]
