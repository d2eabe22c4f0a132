"""Profiles and sketches from a packed graph, without tables of pairs of vertices.

The newest edge between every two neighbours is packed into eight bytes each way (neighbour, time) and written once
to shared storage. Every task reads the packed graph whole. For profiles a task takes a share of the vertices and
follows their walks hop by hop; for sketches it takes a share of the buckets, which do not depend on each other,
through all hops. Nothing is shuffled, and nothing but the packed graph is written: rows go from the task that makes
them to their reader.

A profile's rows are in proportion to pairs of vertices, so their order matters to who writes them: a task takes some
thousands of vertices at once and gives their rows by neighbour, so that neighbours come in runs and few
vertices stand in turn beside them. In Parquet both then take fewer bytes than neighbours that never repeat
(``_toward``). Where walks are few, vertex by vertex is less work.

Within a task, rows are 64-bit integers: vertex, neighbour (or rank) and time from the high bits to the low ones, so
that sorting brings equal (vertex, neighbour) together with the newest last. Walks are worked on in pieces of about
``PIECE``, so a vertex of many walks takes time and no more memory than its result.

A graph of over ``MOST_PAIRS`` pairs, with a missing time, with times of too many bits or with other columns than
64-bit integers is not packed: ``pack``
returns None, and the caller works by tables.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.edges import with_seq
from ..sources.storage import bound_batches, materialize, release

#: Pairs that a task holds, 8 bytes each.
MOST_PAIRS = 32_000_000
#: Walks that are sorted at once.
PIECE = 500_000
#: Pairs of a row of the packed table, and for which there is a task.
CHUNK, TASK_PAIRS = 65_536, 300_000
#: Entries that a block of vertices holds between hops, about, and its most vertices as a power of two.
HELD, BLOCK_BITS = 1 << 22, 13
RANK_BITS = 7
_PACKED = pa.schema([("kind", pa.int32()), ("a", pa.binary()), ("b", pa.binary()), ("x", pa.binary())])
_PACKED_SQL = "kind int, a binary, b binary, x binary"


class Packed:
    """The packed table, and what a task must know of it."""

    def __init__(self, rows: DataFrame, n: int, pairs: int, base: int, time_bits: int):
        self.rows, self.n, self.pairs, self.base, self.time_bits = rows, n, pairs, base, time_bits

    def tasks(self, most: int) -> int:
        return max(1, min(most, max(self.rows.sparkSession.sparkContext.defaultParallelism, self.pairs // TASK_PAIRS)))

    def run(self, kernel: Callable, tasks: int, schema: str) -> DataFrame:
        """The rows of kernel(graph, task) of every task, each of which reads all packed rows."""
        spark = self.rows.sparkSession
        bound_batches(spark)
        numbers = spark.range(0, tasks, 1, tasks).select(F.col("id").alias("task"))
        # A Cartesian product moves no rows: each task reads the files itself.
        every = numbers.crossJoin(self.rows.coalesce(1).hint("shuffle_replicate_nl"))
        return every.mapInArrow(_reader(kernel, self.n, self.pairs, self.base, self.time_bits), schema)


def pack(edges: DataFrame, code: Column | None = None, least: int | None = None) -> Packed | None:
    """The packed graph of (src, dst, ts) edges, of those of a time from least on if it is given. code: a number
    under 2**31 for each vertex, over the column nbr."""
    spark = edges.sparkSession
    kinds = dict(edges.dtypes)
    if any(kinds[c] != "bigint" for c in ("src", "dst", "ts")):
        return None
    ends = edges.where("src <> dst").select(F.least("src", "dst").alias("p"), F.greatest("src", "dst").alias("q"), "ts")
    newest = ends.groupBy("p", "q").agg(F.max("ts").alias("ts"))
    if least is not None:
        newest = newest.where(F.col("ts").isNull() | (F.col("ts") >= least))
    pairs = materialize(spark, newest, "pairs")
    seen = pairs.agg(F.count("*").alias("pairs"), F.count("ts").alias("timed"), F.min("ts").alias("low"), F.max("ts").alias("high")).collect()[0]
    if 2 * seen.pairs > MOST_PAIRS or seen.timed < seen.pairs:
        release(spark, pairs)
        return None
    base = seen.low or 0
    time_bits = max(1, ((seen.high or 0) - base).bit_length())
    ids = with_seq(pairs.select(F.explode(F.array("p", "q")).alias("nbr")).distinct(), "nbr")
    coded = (F.lit(0) if code is None else code).cast("long")
    ids = materialize(spark, ids.select("nbr", (F.col("seq") - 1).alias("i"), coded.alias("code")), "vertices")
    n, known = ids.agg(F.count("*"), F.count("code")).collect()[0]
    if time_bits + n.bit_length() > 61 or known < n:
        release(spark, pairs)
        release(spark, ids)
        return None
    at = lambda c: ids.select(F.col("nbr").alias(c), F.col("i").alias(f"{c}_i"))
    placed = pairs.join(at("p"), "p").join(at("q"), "q").select("p_i", "q_i", (F.col("ts") - base).alias("t"))
    word = lambda c: (F.shiftleft(F.col(c), time_bits) + F.col("t")).alias("x")
    ways = placed.select(F.inline(F.array(F.struct(F.col("p_i").alias("i"), word("q_i")), F.struct(F.col("q_i").alias("i"), word("p_i")))))
    ways = ways.repartition(max(1, 2 * seen.pairs // (8 * CHUNK)), "i").sortWithinPartitions("i", "x")
    bound_batches(spark)
    rows = ways.mapInArrow(_pack_pairs, _PACKED_SQL).unionByName(ids.select("i", "nbr", "code").mapInArrow(_pack_vertices, _PACKED_SQL))
    packed = materialize(spark, rows, "packed")
    release(spark, pairs)
    release(spark, ids)
    return Packed(packed, n, 2 * seen.pairs, base, time_bits)


def _packed_row(kind: int, a: np.ndarray, b: np.ndarray, x: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip((kind, a.tobytes(), b.tobytes(), x.tobytes()), _PACKED)], schema=_PACKED)


def _pack_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row has all pairs of its vertices, or pairs of one vertex alone."""
    def row(i: np.ndarray, x: np.ndarray) -> pa.RecordBatch:
        who, count = np.unique(i, return_counts=True)
        return _packed_row(1, who.astype(np.int32), count.astype(np.int32), x)

    def rows(last: bool) -> Iterator[pa.RecordBatch]:
        nonlocal held, size, begun
        i, x = (np.concatenate(c) for c in zip(*held))
        if (k := int(np.searchsorted(i, begun, "right"))):
            yield row(i[:k], x[:k])
            i, x = i[k:], x[k:]
        # The last vertex may go on.
        k = len(i) if last or not len(i) else int(np.searchsorted(i, i[-1]))
        if k:
            yield row(i[:k], x[:k])
        elif len(i):
            begun, k = i[-1], len(i)
            yield row(i, x)
        held, size = [(i[k:], x[k:])], len(i) - k

    held, size, begun = [], 0, -1
    for batch in batches:
        held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
        size += batch.num_rows
        if size >= CHUNK:
            yield from rows(False)
    if size:
        yield from rows(True)


def _pack_vertices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            i, nbr, code = (batch.column(k).to_numpy() for k in range(3))
            yield _packed_row(0, i.astype(np.int32), code.astype(np.int32), nbr)


# Within a task.

class Graph:
    """off, deg, words: the pairs of vertex i are words[off[i] : off[i] + deg[i]]; ids and codes by vertex."""

    def __init__(self, n: int, pairs: int, base: int, time_bits: int):
        self.n, self.base, self.tb = n, base, time_bits
        self.time = (1 << time_bits) - 1
        self.vb = max(1, n.bit_length())
        self.ids, self.codes = np.zeros(n, np.int64), np.zeros(n, np.int32)
        self.off, self.deg, self.words = np.zeros(n, np.int64), np.zeros(n, np.int64), np.empty(pairs, np.int64)
        self.at, self.held = 0, {}

    def add(self, kind: int, a, b, x) -> None:
        a, b, x = np.frombuffer(a, np.int32), np.frombuffer(b, np.int32), np.frombuffer(x, np.int64)
        if kind == 0:
            self.ids[a], self.codes[a] = x, b
        elif len(a) == 1:
            # There may be more of this vertex.
            self.held.setdefault(int(a[0]), []).append(x.copy())
        else:
            self._place(a, b, x)

    def _place(self, a: np.ndarray, b: np.ndarray, x: np.ndarray) -> None:
        self.deg[a] = b
        self.off[a] = self.at + np.cumsum(b, dtype=np.int64) - b
        self.words[self.at : self.at + len(x)] = x
        self.at += len(x)

    def close(self) -> None:
        for i in list(self.held):
            x = np.concatenate(self.held.pop(i))
            self._place(np.array([i]), np.array([len(x)]), x)
        if self.at != len(self.words):
            raise ValueError("the packed graph is not whole")


def _reader(kernel: Callable, n: int, pairs: int, base: int, time_bits: int) -> Callable:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, graph = None, None
        for batch in batches:
            numbers, kinds, *columns = (batch.column(k) for k in range(5))
            for k, number in enumerate(numbers.to_pylist()):
                if number != task:
                    if graph is not None:
                        graph.close()
                        yield from kernel(graph, task)
                    task, graph = number, Graph(n, pairs, base, time_bits)
                graph.add(kinds[k].as_py(), *(c[k].as_buffer() for c in columns))
        if graph is not None:
            graph.close()
            yield from kernel(graph, task)

    return work


def _newest(rows: np.ndarray, time_bits: int) -> np.ndarray:
    """Sorted, and of equal rows but for their time the newest."""
    rows.sort()
    key = rows >> time_bits
    last = np.ones(len(rows), bool)
    np.not_equal(key[1:], key[:-1], out=last[:-1])
    return rows[last]


def _spans(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start[k], start[k] + 1, ... (count[k] of them) for every k."""
    ends = np.cumsum(count)
    at = np.repeat(start - (ends - count), count)
    at += np.arange(len(at))
    return at


def _pieces(count: np.ndarray, most: int | None = None) -> Iterator[slice]:
    """Slices whose counts sum to most (PIECE) at most, but for single items."""
    ends, at, most = np.cumsum(count), 0, most or PIECE
    while at < len(count):
        before = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + most, "right")))
        yield slice(at, to)
        at = to


def _widen(g: Graph, rows: np.ndarray) -> tuple[np.ndarray, int]:
    """The rows' walks with one more edge at their far end, the newest of each pair, and how many walks they were."""
    far = (rows >> g.tb) & ((1 << g.vb) - 1)
    count, walks, found = g.deg[far], 0, None
    for piece in _pieces(count):
        c = count[piece]
        x = g.words[_spans(g.off[far[piece]], c)]
        near = np.repeat(rows[piece], c)
        time = np.minimum(x & g.time, near & g.time)
        near >>= g.vb + g.tb
        near <<= g.vb + g.tb
        x &= ~g.time
        x |= near
        x |= time
        walks += len(x)
        x = _newest(x, g.tb)
        found = x if found is None else _newest(np.concatenate((found, x)), g.tb)
    return (rows[:0] if found is None else found), walks


def _levels(g: Graph, own: np.ndarray, hops: int) -> tuple[list, int]:
    """(rows, before) for each hop of some vertices, rows by their place in own; before: the newest time of a pair
    at a lower hop, or -1."""
    place = np.arange(len(own), dtype=np.int64) << (g.vb + g.tb)
    rows = np.repeat(place, g.deg[own]) | g.words[_spans(g.off[own], g.deg[own])]
    rows.sort()
    out, lower, walks = [(rows, np.full(len(rows), -1))], rows, len(rows)
    for hop in range(2, hops + 1):
        rows, more = _widen(g, rows)
        walks += more
        rows = rows[((rows >> g.tb) & ((1 << g.vb) - 1)) != own[rows >> (g.vb + g.tb)]]
        before = np.full(len(rows), -1)
        if len(rows):
            key, old = rows >> g.tb, lower >> g.tb
            at = np.minimum(np.searchsorted(key, old), len(key) - 1)
            same = key[at] == old
            before[at[same]] = lower[same] & g.time
            kept = (rows & g.time) > before
            rows, before = rows[kept], before[kept]
        out.append((rows, before))
        if hop < hops:
            lower = _newest(np.concatenate((lower, rows)), g.tb)
    return out, walks


def _shares(g: Graph, task: int, tasks: int, hops: int) -> Iterator[tuple[np.ndarray, list]]:
    """The vertices of a task, some at a time, with their levels."""
    mine, at, some = np.arange(task, g.n, tasks), 0, 8
    most = 1 << min(12, 63 - g.vb - g.tb)
    while at < len(mine):
        own = mine[at : at + some]
        at += some
        levels, walks = _levels(g, own, hops)
        yield own, levels
        some = max(1, min(most, 4 * some, some * PIECE // max(1, walks)))


def _bounds(g: Graph, hops: int) -> tuple[np.ndarray, np.ndarray]:
    """For each vertex at least as many as its entries below the last hop, and as its entries at the last hop."""
    held, last = np.zeros(g.n, np.int32), np.ones(g.n, np.int32)
    for _ in range(hops):
        held += last
        more = np.empty(g.n, np.int32)
        for part in _pieces(g.deg):
            ends = np.cumsum(g.deg[part])
            sums = np.cumsum(last[g.words[_spans(g.off[part], g.deg[part])] >> g.tb])
            more[part] = np.minimum(np.diff(sums[ends - 1], prepend=0), g.n)
        last = more
    return held, last


def _block_bits(g: Graph) -> int:
    """Beside a time and a vertex's place in a piece."""
    return min(BLOCK_BITS, 63 - g.tb - min(g.vb, PIECE.bit_length()))


def _reached(g: Graph, count: np.ndarray, words: np.ndarray, bits: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """(from, to, rows) for ranges of vertices, all in turn: the newest of their neighbours' entries. count, words: the
    entries (place of bits, time) of each vertex, in order; rows are (vertex from the range's first, place, time)."""
    start = np.cumsum(count, dtype=np.int32) - count
    for part in _pieces(g.deg):
        ends = np.cumsum(g.deg[part])
        x = g.words[_spans(g.off[part], g.deg[part])]
        c = count[x >> g.tb]
        walks = np.diff(np.cumsum(c)[ends - 1], prepend=0)
        for piece in _pieces(walks):
            lo, hi = ends[piece.start] - g.deg[part][piece.start], ends[piece.stop - 1]
            owner = np.repeat(np.arange(piece.stop - piece.start), g.deg[part][piece]) << (bits + g.tb)
            some = np.flatnonzero(c[lo:hi])
            near, owner, k = x[lo:hi][some], owner[some], c[lo:hi][some]
            rows = words[:0]
            # A vertex of many walks stands alone, in parts.
            for at in _pieces(k):
                y = words[_spans(start[near[at] >> g.tb], k[at])]
                time = np.minimum(y & g.time, np.repeat(near[at] & g.time, k[at]))
                y &= ~g.time
                y |= time
                y |= np.repeat(owner[at], k[at])
                rows = _newest(y if not len(rows) else np.concatenate((rows, y)), g.tb)
            yield part.start + piece.start, part.start + piece.stop, rows


def _toward(g: Graph, own: np.ndarray, hops: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """hop, and by neighbour in order: neighbours, places in own (ascending vertices), times. Walks have no
    direction: what a vertex has of own is what own has of it."""
    bits = _block_bits(g)
    key = bits + g.tb
    count = np.zeros(g.n, np.int32)
    count[own] = 1
    words = (np.arange(len(own)) << g.tb) | g.time
    # Of all hops so far the newest; at no later hop a vertex has itself, at any time.
    best_count, best = count, words
    for hop in range(1, hops + 1):
        ends = np.cumsum(best_count, dtype=np.int32)
        found, merged, counts, best_counts = [], [], np.zeros(g.n, np.int32), np.zeros(g.n, np.int32)
        for lo, hi, rows in _reached(g, count, words, bits):
            c = best_count[lo:hi]
            old = best[ends[lo] - c[0] : ends[hi - 1]] | (np.repeat(np.arange(hi - lo), c) << key)
            if len(rows) and len(old):
                who, lower = rows >> g.tb, old >> g.tb
                at = np.minimum(np.searchsorted(who, lower), len(who) - 1)
                same = who[at] == lower
                before = np.full(len(rows), -1)
                before[at[same]] = old[same] & g.time
                rows = rows[(rows & g.time) > before]
            if len(rows):
                yield hop, (rows >> key) + lo, (rows >> g.tb) & ((1 << bits) - 1), rows & g.time
            if hop < hops:
                old = _newest(np.concatenate((old, rows)), g.tb) if len(rows) else old
                for entries, to, into in ((rows, found, counts), (old, merged, best_counts)):
                    to.append(entries & ((1 << key) - 1))
                    into[lo:hi] = np.bincount(entries >> key, minlength=hi - lo)
        if hop < hops:
            count, words, best_count, best = counts, np.concatenate(found), best_counts, np.concatenate(merged)


def _blocks(g: Graph, task: int, tasks: int, hops: int) -> list[np.ndarray] | None:
    """The vertices of a task in blocks for _toward, or None where walks are fewer than the pairs that it reads."""
    mine = np.arange(task, g.n, tasks)
    held, last = (x[mine].astype(np.int64) for x in _bounds(g, hops))
    blocks = [mine[k] for k in _pieces(np.maximum(held, max(1, HELD >> _block_bits(g))), HELD)]
    return blocks if last.sum() >= len(blocks) * len(g.words) else None


def _batch(schema: pa.Schema, *columns: np.ndarray) -> Iterator[pa.RecordBatch]:
    whole = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)
    for k in range(0, whole.num_rows, CHUNK):
        yield whole.slice(k, CHUNK)


def profiles(packed: Packed, hops: int) -> DataFrame:
    """id, hop, nbr, ts: the exact profile of every vertex."""
    tasks = packed.tasks(max(1, packed.n))
    schema = pa.schema([("id", pa.int64()), ("hop", pa.int32()), ("nbr", pa.int64()), ("ts", pa.int64())])

    def kernel(g: Graph, task: int) -> Iterator[pa.RecordBatch]:
        blocks = _blocks(g, task, tasks, hops)
        for own in blocks or ():
            for hop, nbr, place, time in _toward(g, own, hops):
                yield from _batch(schema, g.ids[own[place]], np.full(len(nbr), hop, np.int32), g.ids[nbr], time + g.base)
        for own, levels in _shares(g, task, tasks, hops) if blocks is None else ():
            for hop, (rows, _) in enumerate(levels, 1):
                near, far = own[rows >> (g.vb + g.tb)], (rows >> g.tb) & ((1 << g.vb) - 1)
                yield from _batch(schema, g.ids[near], np.full(len(rows), hop, np.int32), g.ids[far], (rows & g.time) + g.base)

    return packed.run(kernel, tasks, "id long, hop int, nbr long, ts long")


def summaries(packed: Packed, hops: int, horizon: int, inclusive: bool = False) -> DataFrame:
    """id, size, updates of every vertex: neighbours newer than the horizon, and hops with entries."""
    tasks = packed.tasks(max(1, packed.n))
    schema = pa.schema([("id", pa.int64()), ("size", pa.int64()), ("updates", pa.int64())])

    def kernel(g: Graph, task: int) -> Iterator[pa.RecordBatch]:
        # The least time that counts, from the base.
        least = horizon - g.base + (0 if inclusive else 1)
        for own, levels in _shares(g, task, tasks, hops):
            size, updates = np.zeros(len(own), np.int64), np.zeros(len(own), np.int64)
            for rows, before in levels:
                near = rows >> (g.vb + g.tb)
                # A neighbour counts at the first hop at which it is newer.
                first = ((rows & g.time) >= least) & ((before < least) | (before < 0))
                size += np.bincount(near[first], minlength=len(own))
                updates += np.bincount(near, minlength=len(own)) > 0
            yield from _batch(schema, g.ids[own], size, updates)

    return packed.run(kernel, tasks, "id long, size long, updates long")


# Sketches.

def _frontier(rows: np.ndarray, time_bits: int) -> np.ndarray:
    """Of sorted (vertex, rank, time) rows those that no larger rank at least as new makes useless."""
    back = rows[::-1]
    vertex = back >> (time_bits + RANK_BITS)
    time = back & ((1 << time_bits) - 1)
    # Vertices come in falling order here: numbered upwards, a running maximum starts anew at each.
    fresh = np.ones(len(back), bool)
    np.not_equal(vertex[1:], vertex[:-1], out=fresh[1:])
    upto = np.maximum.accumulate((np.cumsum(fresh) << time_bits) | time)
    kept = fresh.copy()
    kept[1:] |= time[1:] > (upto[:-1] & ((1 << time_bits) - 1))
    return back[kept][::-1]


def _merged(g: Graph, count: np.ndarray, words: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
    """(from, to, rows) for ranges of vertices: the merged entries of their neighbours, pruned. count, words: the
    entries (rank, time) of each vertex, in order."""
    start = np.cumsum(count) - count
    most, lo, ends = 1 << min(20, 63 - RANK_BITS - g.tb), 0, np.cumsum(g.deg)
    while lo < g.n:
        upto = (ends[lo - 1] if lo else 0) + PIECE
        hi = max(lo + 1, min(lo + most, int(np.searchsorted(ends, upto, "right"))))
        x = g.words[_spans(g.off[lo:hi], g.deg[lo:hi])]
        owner = np.repeat(np.arange(hi - lo), g.deg[lo:hi])
        c = count[x >> g.tb]
        some = c > 0
        x, owner, c = x[some], owner[some] << (RANK_BITS + g.tb), c[some]
        rows = None
        for piece in _pieces(c):
            k = c[piece]
            y = words[_spans(start[x[piece] >> g.tb], k)]
            time = np.minimum(y & g.time, np.repeat(x[piece] & g.time, k))
            y &= ~g.time
            y |= time
            y |= np.repeat(owner[piece], k)
            y = _newest(y, g.tb)
            rows = y if rows is None else _newest(np.concatenate((rows, y)), g.tb)
        if rows is not None:
            yield lo, hi, _frontier(rows, g.tb)
        lo = hi


def sketches(packed: Packed, hops: int, buckets: int) -> DataFrame:
    """id, hop, bucket, rank, ts; the packed codes are bucket * 2**RANK_BITS + rank."""
    tasks = packed.tasks(buckets)
    schema = pa.schema([("id", pa.int64()), ("hop", pa.int32()), ("bucket", pa.int32()), ("rank", pa.int32()), ("ts", pa.int64())])

    def kernel(g: Graph, task: int) -> Iterator[pa.RecordBatch]:
        for bucket in range(task, buckets, tasks):
            # At no hop a vertex has itself, at any time.
            there = (g.codes >> RANK_BITS) == bucket
            count = there.astype(np.int64)
            words = ((g.codes[there] & ((1 << RANK_BITS) - 1)).astype(np.int64) << g.tb) | g.time
            for hop in range(1, hops + 1):
                counts, found = np.zeros(g.n, np.int64), []
                for lo, hi, rows in _merged(g, count, words):
                    owner = rows >> (RANK_BITS + g.tb)
                    counts[lo:hi] = np.bincount(owner, minlength=hi - lo)
                    entry = rows & ((1 << (RANK_BITS + g.tb)) - 1)
                    if hop < hops:
                        found.append(entry)
                    size = len(rows)
                    yield from _batch(schema, g.ids[lo:hi][owner], np.full(size, hop, np.int32), np.full(size, bucket, np.int32), (entry >> g.tb).astype(np.int32), (entry & g.time) + g.base)
                count, words = counts, np.concatenate(found) if found else words[:0]

    return packed.run(kernel, tasks, "id long, hop int, bucket int, rank int, ts long")
