"""Greedy placements in several blocks are those in one."""

import random

import pytest
from test_graph import ET, greedy, rows

from chronoweave.operators import partition as pt


@pytest.mark.parametrize("kind", ["hdrf", "hurl", "babh"])
def test_greedy_carries_state(spark, kind):
    rng = random.Random(9)
    data = [(rng.randrange(30), rng.randrange(30)) for _ in range(300)]
    df = spark.createDataFrame([(k + 1, s, d, 0) for k, (s, d) in enumerate(data)], ET).repartition(3)
    assert [p for _, p in rows(pt.greedy(df, kind, 4, block=70), "seq", "part")] == greedy(data, kind, 4)


def test_least_load_carries_loads(spark):
    rng = random.Random(10)
    degrees = [(k * 1000, rng.randrange(1, 9)) for k in range(25)]
    load, want = [0] * 3, []
    for k, d in degrees:
        p = load.index(min(load))
        load[p] += d + 1
        want.append((k, p))
    df = spark.createDataFrame(degrees, "id long, degree long").repartition(3)
    assert rows(pt.least_load(df, 3, block=10)) == want
