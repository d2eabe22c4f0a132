"""Queries over every edge, against plain Python that shares no SQL with them."""

import pytest

from chronoweave.plans.queries import queries


@pytest.fixture(scope="module")
def edges(spark, sf):
    return [(r.src, r.dst) for r in queries()["drop_self_loops"](spark, sf).orderBy("seq").collect()]


def test_components_of_every_edge(spark, sf, edges):
    root = {v: v for e in edges for v in e}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for s, d in edges:
        a, b = sorted((find(s), find(d)))
        root[b] = a
    got = {r.id: r.label for r in queries()["connected_components"](spark, sf).collect()}
    assert got == {v: find(v) for v in root}


def test_whole_reads_every_edge(spark, sf, edges):
    assert queries()["batch_id"](spark, sf).count() == len(edges)
    assert queries()["edge_replace"](spark, sf).count() == len(set(edges))


def test_pagerank_ends_by_tolerance(spark, sf, edges):
    pairs = set(edges)
    out = {}
    for s, d in pairs:
        out.setdefault(s, []).append(d)
    rank = {v: 0.15 for e in pairs for v in e}
    delta = dict(rank)
    while any(x > 1e-4 for x in delta.values()):
        got = {}
        for s, x in delta.items():
            if x > 1e-4:
                for d in out.get(s, ()):
                    got[d] = got.get(d, 0) + 0.85 * x / len(out[s])
        delta = got
        for v, x in got.items():
            rank[v] += x
    found = {r.id: r.pr for r in queries()["pagerank"](spark, sf).collect()}
    assert found == pytest.approx(rank, abs=2e-6)
