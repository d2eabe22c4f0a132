"""Components after every batch, from the history of their labels.

Of the edges in order of their batch only those matter that unite two components, fewer than there are vertices: each
partition leaves the others out, then one task unites what is left, batch after batch. It holds some numbers for each
vertex, not for each batch. A vertex that stops being the least of its component passes its label on to another one
for good, so a vertex's labels are found by following those steps, and are rows of (from, to) batches.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

_EDGE = pa.schema([("src", pa.int64()), ("dst", pa.int64()), ("batch_id", pa.int64())])
_SPAN = pa.schema([("id", pa.int64()), ("label", pa.int64()), ("first", pa.int64()), ("last", pa.int64())])
SPAN_SQL = "id long, label long, first long, last long"
ROWS = 65_536


def _read(batches: Iterator[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct ids in order, and ends (as places among them) and batches of the edges, by batch."""
    held = [[batch.column(k).to_numpy() for k in range(3)] for batch in batches]
    src, dst, when = (np.concatenate(c) if c else np.zeros(0, np.int64) for c in (zip(*held) if held else ((), (), ())))
    order = np.argsort(when, kind="stable")
    ids, ends = np.unique(np.concatenate((src[order], dst[order])), return_inverse=True)
    return ids, ends[: len(order)], ends[len(order) :], when[order]


def _unite(n: int, src: np.ndarray, dst: np.ndarray) -> tuple[list[int], list[int], list[int]]:
    """Which edges unite two components, and for each the larger and the smaller of their least vertices."""
    parent = list(range(n))
    edges, gone, stays = [], [], []
    for k, (a, b) in enumerate(zip(src.tolist(), dst.tolist())):
        while parent[a] != a:
            parent[a] = a = parent[parent[a]]
        while parent[b] != b:
            parent[b] = b = parent[parent[b]]
        if a != b:
            if a < b:
                a, b = b, a
            parent[a] = b
            edges.append(k)
            gone.append(a)
            stays.append(b)
    return edges, gone, stays


def _rows(schema: pa.Schema, *columns: np.ndarray) -> Iterator[pa.RecordBatch]:
    whole = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], schema=schema)
    for k in range(0, whole.num_rows, ROWS):
        yield whole.slice(k, ROWS)


def forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edges that unite components within a partition, and the first self loop of each vertex."""
    ids, src, dst, when = _read(batches)
    kept = np.zeros(len(when), bool)
    kept[_unite(len(ids), src, dst)[0]] = True
    loops = np.flatnonzero(src == dst)
    kept[loops[np.unique(src[loops], return_index=True)[1]]] = True
    yield from _rows(_EDGE, ids[src[kept]], ids[dst[kept]], when[kept])


def spans(last: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """From all edges that may unite components: id, label, and the first and last batch with that label."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, src, dst, when = _read(batches)
        born = np.full(len(ids), last + 1)
        for ends in (src, dst):
            np.minimum.at(born, ends, when)
        edges, gone, stays = _unite(len(ids), src, dst)
        ends, heir = np.full(len(ids), last + 1), np.arange(len(ids))
        ends[gone], heir[gone] = when[edges], stays
        who, label, since = np.arange(len(ids)), np.arange(len(ids)), born
        while len(who):
            until = ends[label]
            some = since < until
            yield from _rows(_SPAN, ids[who[some]], ids[label[some]], since[some], until[some] - 1)
            more = until <= last
            who, label, since = who[more], heir[label[more]], np.maximum(since, until)[more]

    return work
