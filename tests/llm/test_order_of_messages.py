"""The order in which messages are read plays no part, also where turns tie or are missing."""

import random

from strandmap.llm import tool_calls


def test_rows_in_any_order(spark):
    rows = [(1, 0, "user", "a"), (1, 0, "user", "b"), (1, 0, "assistant", "z"), (1, 0, "assistant", "w"), (1, None, "assistant", "w"), (1, None, "user", "n"), (1, 1, None, "x"), (1, 1, "assistant", None), (1, 2, "user", None), (1, 2, "system", "s")]
    found = set()
    for seed in range(3):
        random.Random(seed).shuffle(rows)
        df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").coalesce(1)
        out = tool_calls.linked(*tool_calls.of_conversations(df), tool_calls.REPLY, further=True).collect()
        found.add(tuple(sorted(str(tuple(r)) for r in out)))
    assert len(found) == 1
    got = next(iter(found))
    assert len(got) == len(rows) - 1  # the answer is in its call's row
    assert sum("'linked'" in r for r in got) == 1 and any("'linked'" in r and '"result":"w"' in r for r in got)
