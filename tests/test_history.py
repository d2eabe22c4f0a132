"""Components after every batch against counting anew."""

import random

from test_graph import ET, rows

from chronoweave.operators import algorithms


def anew(data, size):
    out = []
    for b in range((max(e[0] for e in data) - 1) // size + 1):
        label = {}
        held = [e for e in data if (e[0] - 1) // size <= b and None not in e[1:3]]
        for _, s, d, _ in held:
            label.setdefault(s, s)
            label.setdefault(d, d)
        changed = True
        while changed:
            changed = False
            for _, s, d, _ in held:
                low = min(label[s], label[d])
                changed |= label[s] != low or label[d] != low
                label[s] = label[d] = low
        out += [(b, v, x) for v, x in label.items()]
    return sorted(out)


def test_components_by_batch(spark):
    rng = random.Random(3)
    # Ids that number * batches can't hold, below zero too.
    name = [rng.randrange(-(2**62), 2**62) for _ in range(60)]
    data = [(k, rng.choice(name), rng.choice(name), 0) for k in range(1, 80)]
    data += [(80, None, name[0], 0), (81, 5, 5, 0), (190, name[1], name[2], 0)]
    frame = spark.createDataFrame(data, ET).repartition(5)
    for size in (4, 200):
        assert rows(algorithms.components_by_batch(frame, size), "batch_id", "id", "label") == anew(data, size)


def test_least_vertices_that_come_last(spark):
    # A path whose end of least id comes last: every batch changes every label.
    data = [(k, 100 - k, 101 - k, 0) for k in range(1, 60)]
    frame = spark.createDataFrame(data, ET).repartition(3)
    assert rows(algorithms.components_by_batch(frame, 2), "batch_id", "id", "label") == anew(data, 2)
    assert rows(algorithms.components_by_batch(spark.createDataFrame([], ET), 2)) == []
