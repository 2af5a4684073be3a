"""An anti join over rows whose order is not the same each time that they are computed."""

import random

import numpy as np
import pyarrow as pa

from strandmap.operators import intervals as I

IV = "chrom long, start long, end_ long"


def turned(batches):
    for batch in batches:
        yield batch.take(pa.array(np.random.default_rng().permutation(len(batch))))


def test_left_anti_does_not_hang_on_the_order_of_rows(spark):
    rng = random.Random(9)
    some = lambda n, length: [(rng.randint(1, 2), s := rng.randint(0, 20_000), s + rng.randint(1, length)) for _ in range(n)]
    a, b = [*some(200, 300), (None, 1, 5)], some(40, 50)
    a += a[:3]
    left = spark.createDataFrame(a, IV).coalesce(1).mapInArrow(turned, IV)
    right = spark.createDataFrame(b, "chrom2 long, start2 long, end2 long")
    got = I.overlap_join(left, right, ("chrom", "start", "end_"), ("chrom2", "start2", "end2"), 1000, "left_anti").collect()
    want = [x for x in a if not any(x[0] == y[0] and x[1] < y[2] and y[1] < x[2] for y in b)]
    assert 20 < len(want) < len(a) - 20
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
