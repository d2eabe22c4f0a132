"""Profiles and sketches from the packed graph are those by tables."""

import random

import pyarrow.parquet  # noqa: F401
import pytest
from pyspark.sql import functions as F
from test_graph import ET, rows

from chronoweave.functions import hashing
from chronoweave.operators import edges as eg, partition as pt, profile as pf, walks
from chronoweave.sources import storage


def graph(spark, seed, vertices, edges, times, hub=0):
    rng = random.Random(seed)
    name = [rng.randrange(-(2**60), 2**60) for _ in range(vertices)]
    data = [(rng.choice(name), rng.choice(name), rng.randrange(times) - times // 2) for _ in range(edges)]
    data += [(name[0], n, rng.randrange(times)) for n in name[:hub]]
    return spark.createDataFrame([(k + 1, *row) for k, row in enumerate(data)], ET).repartition(3)


@pytest.mark.parametrize(("vertices", "edges", "times", "hub"), [(40, 200, 2**40, 40), (300, 330, 50, 250)])
def test_packed_is_as_by_tables(spark, monkeypatch, vertices, edges, times, hub):
    frame = graph(spark, edges, vertices, edges, times, hub).cache()
    want = pf.exact_by_tables(frame, 3).cache()
    packed = walks.pack(frame)
    assert rows(walks.profiles(packed, 3)) == rows(want)
    updates = rows(pf.update_counts(want))
    for horizon, inclusive in ((0, False), (2, True), (-(2**50), False), (2**50, True)):
        sizes = rows(pf.sizes(want, horizon, inclusive))
        assert rows(walks.summaries(packed, 3, horizon, inclusive)) == sorted((i, dict(sizes).get(i, 0), u) for i, u in updates)
        if inclusive:
            assert rows(pf.window_sizes(frame, 3, horizon, inclusive)) == sizes
    h = hashing.spread(F.col("nbr"))
    tables = rows(pf.approximate_by_tables(frame, 3, 64, h, 31))
    assert rows(pf.approximate(frame, 3, 64, h, 31)) == tables
    # In small pieces, a vertex's walks are in several of them.
    rng = random.Random(4)
    bound = [(i, x) for i in range(6) for x in range(rng.choice((1, 3, 90)))]
    monkeypatch.setattr(walks, "CHUNK", 16)
    batches = [walks.pa.RecordBatch.from_arrays([walks.pa.array(c) for c in zip(*bound[k : k + 5])], ["i", "x"]) for k in range(0, len(bound), 5)]
    g = walks.Graph(6, len(bound), 0, 8)
    for batch in walks._pack_pairs(iter(batches)):
        g.add(*(batch.column(k)[0].as_py() for k in range(4)))
    g.close()
    assert [(i, int(x)) for i in range(6) for x in g.words[g.off[i] : g.off[i] + g.deg[i]]] == bound
    monkeypatch.undo()
    whole = walks.pack(frame, hashing.bucket_of(h, 64) * 128 + hashing.rank_of(h, 64, 31))
    monkeypatch.setattr(walks, "PIECE", 7)
    g = walks.Graph(whole.n, whole.pairs, whole.base, whole.time_bits)
    for r in whole.rows.collect():
        g.add(*r)
    g.close()
    found = []
    for own, levels in walks._shares(g, 0, 1, 3):
        for hop, (r, _) in enumerate(levels, 1):
            found += [(int(g.ids[own[x >> (g.vb + g.tb)]]), hop, int(g.ids[(x >> g.tb) & ((1 << g.vb) - 1)]), int(x & g.time) + g.base) for x in r.tolist()]
    assert sorted(found) == rows(want)
    there = (g.codes >> 7) == 5
    parts = list(walks._merged(g, there.astype("int64"), ((g.codes[there] & 127).astype("int64") << g.tb) | g.time))
    assert sorted((int(g.ids[lo + (x >> (7 + g.tb))]), 1, 5, (x >> g.tb) & 127, (x & g.time) + g.base) for lo, _, r in parts for x in r.tolist()) == [t for t in tables if t[1] == 1 and t[2] == 5]


@pytest.mark.parametrize(("vertices", "edges", "times", "hub"), [(40, 200, 2**40, 40), (300, 330, 50, 250), (60, 700, 9, 0)])
@pytest.mark.parametrize(("piece", "held"), [(500_000, 1 << 22), (7, 1 << 8)])
def test_profiles_of_blocks_are_as_by_tables(spark, monkeypatch, vertices, edges, times, hub, piece, held):
    frame = graph(spark, edges + 1, vertices, edges, times, hub)
    packed = walks.pack(frame)
    monkeypatch.setattr(walks, "PIECE", piece)
    monkeypatch.setattr(walks, "HELD", held)
    g = walks.Graph(packed.n, packed.pairs, packed.base, packed.time_bits)
    for r in packed.rows.collect():
        g.add(*r)
    g.close()
    found = []
    for task in range(2):
        blocks = walks._blocks(g, task, 2, 3)
        mine = list(range(task, g.n, 2))
        if blocks is not None:
            assert [i for own in blocks for i in own.tolist()] == mine
            assert (len(blocks) > 1) == (held < 1 << 22)
        for own in blocks or [walks.np.array(mine)]:
            for hop, nbr, place, time in walks._toward(g, own, 3):
                found += [(int(g.ids[own[p]]), hop, int(g.ids[n]), int(t) + g.base) for n, p, t in zip(nbr, place, time)]
    assert sorted(found) == rows(pf.exact_by_tables(frame, 3))


def test_neighbours_come_in_runs(spark, tmp_path):
    """A result of all pairs of vertices is written in fewer bytes where neighbours repeat from row to row."""
    frame = graph(spark, 7, 800, 4000, 50)
    profile = pf.exact(frame, 3)
    parts = {}
    for r in profile.withColumn("part", F.spark_partition_id()).collect():
        parts.setdefault(r.part, []).append((r.hop, r.nbr))
    total = sum(map(len, parts.values()))
    runs = sum(1 for p in parts.values() for a, b in zip([None, *p], p) if a != b)
    assert total > 200_000 and runs < total / 10
    profile.write.parquet(str(tmp_path / "out"))
    chunks = [walks.pa.parquet.ParquetFile(f).metadata.row_group(0) for f in (tmp_path / "out").glob("*.parquet")]
    assert sum(c.num_rows for c in chunks) == total
    assert sum(c.column(2).total_compressed_size for c in chunks) < total / 2
    # Few walks: vertex by vertex, without a pass over all pairs for each block.
    sparse = walks.Graph(4000, 4000, 0, 4)
    sparse._place(walks.np.arange(4000), walks.np.ones(4000, int), (walks.np.arange(4000) ^ 1) << 4)
    assert walks._blocks(sparse, 0, 8, 3) is None


def test_no_pairs_of_vertices_are_written(spark, monkeypatch):
    """A star of n vertices has n * n profile rows: what is written stays in proportion to its edges."""
    written = []
    keep = storage.write_table
    monkeypatch.setattr(storage, "write_table", lambda s, df, path: (written.append(back := keep(s, df, path)), back)[1])
    monkeypatch.setattr(storage, "release", lambda s, df: None)
    monkeypatch.setattr(walks, "release", lambda s, df: None)
    star = spark.createDataFrame([(k, 0, k, k) for k in range(1, 201)], ET)
    assert pf.exact(star, 3).count() > 200 * 199
    assert {r["size"] for r in pf.summaries(star).collect()} == {200}
    assert pf.approximate(star, 3, 16).count() > 0
    assert written and max(df.count() for df in written) <= 2 * 201


def test_what_is_not_packed_goes_by_tables(spark, monkeypatch):
    empty = spark.createDataFrame([], ET)
    assert rows(pf.exact(empty)) == rows(pf.summaries(empty)) == rows(pf.window_sizes(empty)) == rows(pf.approximate(empty)) == []
    loops = spark.createDataFrame([(1, 4, 4, 1), (2, None, 4, 2)], ET)
    assert rows(pf.exact(loops)) == []
    odd = spark.createDataFrame([(1, 1, 2, None), (2, 2, 3, 5), (3, 3, 4, 9)], ET)
    wide = spark.createDataFrame([(1, 1, 2, -(2**62)), (2, 2, 3, 2**62)], ET)
    small = odd.select(*[F.col(c).cast("int") for c in ("src", "dst", "ts")])
    for frame in (odd, wide, small):
        assert walks.pack(frame) is None
        assert pf.exact(frame).exceptAll(pf.exact_by_tables(frame)).count() == 0
        assert rows(pf.window_sizes(frame, 3, 4)) == rows(pf.sizes(pf.exact_by_tables(frame), 4))
    path = spark.createDataFrame([(1, 1, 2, 10), (2, 2, 3, 5), (3, 3, 4, 20)], ET)
    monkeypatch.setattr(walks, "MOST_PAIRS", 5)
    assert walks.pack(path) is None
    assert rows(pf.summaries(path, 3, 5)) == [(1, 1, 3), (2, 1, 2), (3, 1, 2), (4, 1, 3)]


def test_updates_are_joined_once_for_each_end(spark):
    frame = pf.latest(graph(spark, 5, 30, 60, 9)).select(F.col("id").alias("src"), F.col("nbr").alias("dst"), "ts")
    stats = {r.id: r for r in pf.summaries(frame).collect()}
    degree = {r.id: r.degree for r in eg.degree_undirected(frame).collect()}
    copies = {r.id: r.replicas for r in pt.replicas(frame.withColumn("part", pt.hash_strategy("EdgePartition2D", 4))).collect()}
    placed = pt.with_updates(frame, 4)
    assert placed.count() == frame.count() > 0
    for r in placed.collect():
        assert (r.s_degree, r.s_updates, r.s_replicas) == (degree[r.src], stats[r.src].updates, copies[r.src])
        assert (r.d_degree, r.d_updates, r.d_replicas) == (degree[r.dst], stats[r.dst].updates, copies[r.dst])
    # Joins of the edges themselves: the statistics are a table.
    assert placed._jdf.queryExecution().optimizedPlan().toString().count("Join LeftOuter") == 2
