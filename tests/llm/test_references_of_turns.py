"""Turns refer to the turns before them: levels, and whether a call rests on answered, valid ones alone."""

import json

from strandmap.llm import registry, tool_calls


def test_turns_stand_on_those_before(spark, tmp_path):
    rows = [(1, 0, "user", "a"), (1, 1, "assistant", "A"), (1, 2, "user", "b"), (1, 2, "user", "bb"), (1, 3, "assistant", "B"), (1, 4, "user", "c"), (1, 5, "user", "d"), (1, 6, "assistant", "D")]
    rows += [(2, 1, "user", ""), (2, 2, "assistant", "E"), (2, 3, "user", "f"), (2, 4, "assistant", "F"), (3, 0, "user", "g"), (3, 1, "assistant", "G"), (None, 0, "user", "h"), (None, 1, "user", "i"), (3, None, "user", "n")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3).write.parquet(str(tmp_path / "conversations.parquet"))
    got = {(r.conv_id, r.turn): (r.level, r.position, r.status, r.valid, r.grounded) for r in registry.op4_tool_calls(spark, str(tmp_path)).collect() if r.name == "reply" and r.status != "repeated"}
    assert got == {
        (1, 0): (0, 1, "linked", True, True), (1, 2): (1, 2, "linked", True, True), (1, 4): (2, 3, "unanswered", True, False), (1, 5): (3, 4, "linked", True, False),
        (2, 1): (0, 1, "linked", False, False), (2, 3): (1, 2, "linked", True, False), (3, 0): (0, 1, "linked", True, True),
    }


def test_query_equals_a_pass_over_the_turns(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet").orderBy("conv_id", "turn").collect()
    want: dict[tuple, list] = {}
    for r in rows:
        own = [k for k in want if k[0] == r.conv_id]
        if r.role == "user":
            want[r.conv_id, r.turn] = [len(own), False]
        elif r.role == "assistant" and own:
            last = own[-1]
            want[last][1] = all(want[k][1] for k in own[:-1])
    got = {(r.conv_id, r.turn): [r.level, r.grounded] for r in registry.op4_tool_calls(spark, "/root/testdata/sf0.01").collect() if r.name == "reply" and r.status != "repeated"}
    assert got == want and max(level for level, _ in want.values()) > 1


def test_levels_of_chains_branches_and_cycles(spark):
    arguments = lambda *refs: json.dumps([{"$ref": r} for r in refs])
    calls = [(1, f"c{k:03d}", k, "t", arguments(*([f"c{k - 1:03d}"] if k else []))) for k in range(70)]
    calls += [(1, "x", 100, "t", arguments("c010", "c060")), (1, "y", 101, "t", arguments("x")), (1, "z", 102, "t", arguments("y", "c069")), (1, "w", 103, "t", arguments("z"))]
    calls += [(1, "p", 104, "t", arguments("q")), (1, "q", 105, "t", arguments("p")), (1, "r", 106, "t", arguments("p")), (1, "s", 107, "t", arguments("r", "w")), (1, "u", 108, "t", arguments("s"))]
    results = [(1, c[1], c[2], "ok") for c in calls if c[1] != "c065"]
    got = {r.call_id: r for r in tool_calls.linked(spark.createDataFrame(calls, "conv_id long, call_id string, turn long, name string, arguments string"), spark.createDataFrame(results, "conv_id long, call_id string, turn long, content string"), {"t": {"type": "array"}}).collect()}
    assert [got[f"c{k:03d}"].level for k in range(70)] == list(range(70))
    assert [got[c].level for c in "xyzw"] == [61, 62, 70, 71]
    assert {c for c in got if got[c].status == "cycle"} == {*"pqrsu"}
    assert {c for c in got if not got[c].grounded} == {"c065", "c066", "c067", "c068", "c069", *"zwpqrsu"}
