"""Removal of repeated byte strings by a depth-limited radix sort of suffixes.

Only the first ``depth`` bytes of a suffix matter, so a suffix is a window of that many bytes, and the
windows that stand in equal groups after the last digit are exactly the repeated ones.

1. Dealing. A row for each suffix would be a row for each byte, so suffixes travel in runs: neighbouring windows
   that share their minimiser (of the window's grams of ``GRAM`` bytes the one with the least hash, the leftmost
   of equals). It depends on the window alone, so equal windows have it at the same place. A run is dealt by its
   gram's hash, with a digest of its bytes. A gram with one run in the whole table holds no repeated window; where
   all runs of a gram have equal bytes, all their windows are repeated; both leave here.
2. Sorting. Each different content of the other grams is fetched once, with the number of its copies. The
   sort reads a window from its minimiser: the gram, then on to the right one byte a pass, most significant
   digit first, and from the gram to the left likewise. A pass splits every group by the next byte; a string
   that is alone in its group leaves. A window that begins o bytes before the gram ends after depth - o bytes
   on the right, so its group is that of its right string after depth - o digits and of its left string after
   o digits. One pass thus moves on all windows of all contents that need the byte, and equal groups have equal
   bytes, compared one by one.
3. Grams with more than ``hot`` contents are not sorted in one task: their windows are dealt out one by one, by
   128-bit digests of their bytes, so that no group grows without bound.

What comes out are byte ranges per distinct text; texts are cut once, and rows take their text's result. Texts, and
contents within a text's gram, are named by 128 bits of hashes of their bytes.

Cases: a null text counts as empty; texts under ``depth`` bytes lose nothing; repeated rows are each
other's repetition; a null doc_id is carried through; an empty table gives no rows; ``removed_spans``
reads the id and the text only, and ``cut_documents`` passes every other column through.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batch, materialize, release

DEPTH = 200
GRAM = 40
HOT = 4_000
#: Contents that are sorted together, whole groups at a time.
SORTED = 8_192
_BITS = 20
BUFFER = 1 << _BITS
_TABLE = np.random.default_rng(20_240_607).integers(0, 2**64, 256, np.uint64)
_M = 0x9E3779B97F4A7C15


def _powers(base: int, n: int) -> np.ndarray:
    return np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, base, np.uint64)]))


_UP, _DOWN = _powers(_M, BUFFER), _powers(pow(_M, -1, 2**64), BUFFER)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def rolling(data: np.ndarray, width: int) -> np.ndarray:
    """The hash of each string of ``width`` bytes."""
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_TABLE[data] * _UP[: len(data)], out=total[1:])
    return mix((total[width:] - total[:-width]) * _DOWN[: len(data) - width + 1])


def sliding_min(v: np.ndarray, width: int) -> np.ndarray:
    n = len(v)
    x = np.concatenate([v, np.full(-n % width, 2**64 - 1, np.uint64)]).reshape(-1, width)
    ahead = np.minimum.accumulate(x, axis=1).ravel()
    back = np.minimum.accumulate(x[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - width + 1], ahead[width - 1 : n])


def runs(pieces: list[bytes], depth: int, gram: int) -> tuple[np.ndarray, ...] | None:
    """(piece, gram hash, content hash, start, windows, anchor) of each run; starts count from the piece's start,
    and the anchor is where the minimiser stands in the run."""
    data = b"".join(pieces)
    if len(data) < depth:
        return None
    sizes = np.array([len(p) for p in pieces])
    g = rolling(np.frombuffer(data, np.uint8), gram)
    low = np.uint64(BUFFER - 1)
    at = (sliding_min((g & ~low) | np.arange(len(g), dtype=np.uint64), depth - gram + 1) & low).astype(np.int64)
    piece = np.repeat(np.arange(len(pieces)), sizes)[: len(at)]
    ends = np.cumsum(sizes)
    window = np.flatnonzero(np.arange(len(at)) + depth <= ends[piece])
    if not len(window):
        return None
    at, piece = at[window], piece[window]
    new = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (piece[1:] != piece[:-1])]))
    start = window[new]
    count = np.diff(np.append(new, len(window)))
    view = memoryview(data)
    spans = zip(start.tolist(), (start + count - 1 + depth).tolist())
    content = np.fromiter((xxhash.xxh3_64_intdigest(view[s:e]) for s, e in spans), np.uint64, len(start))
    return piece[new], g[at[new]].view(np.int64), content.view(np.int64), start - (ends - sizes)[piece[new]], count, at[new] - start


def text_key() -> list[Column]:
    """The 128 bits that name a text, as two columns."""
    text = F.coalesce("text", F.lit(""))
    return [F.xxhash64(text).alias("h"), F.xxhash64(F.lit(1), text).alias("i")]


def encoded(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "replace")


def all_runs(docs: DataFrame, depth: int, gram: int) -> DataFrame:
    """gram, content, h and i (the text), start, windows, anchor."""
    schema = pa.schema([("gram", pa.int64()), ("content", pa.int64()), ("h", pa.int64()), ("i", pa.int64()), ("start", pa.int64()), ("windows", pa.int32()), ("anchor", pa.int32())])
    step = BUFFER - depth + 1

    def flush(held):
        found = runs([p for p, *_ in held], depth, gram)
        if found is not None:
            piece, g, content, start, count, anchor = found
            h, i, offset = (np.array(x, np.int64)[piece] for x in list(zip(*held))[1:])
            yield batch(schema, gram=g, content=content, h=h, i=i, start=start + offset, windows=count.astype(np.int32), anchor=anchor.astype(np.int32))

    def find(batches):
        held, size = [], 0
        for b in batches:
            for h, i, text in zip(b.column("h").to_pylist(), b.column("i").to_pylist(), b.column("text")):
                data = encoded(text.as_py())
                for at in range(0, max(len(data) - depth + 1, 0), step):
                    piece = data[at : at + BUFFER]
                    if size + len(piece) > BUFFER:
                        yield from flush(held)
                        held, size = [], 0
                    held.append((piece, h, i, at))
                    size += len(piece)
        yield from flush(held)

    return docs.select(*text_key(), "text").mapInArrow(find, "gram long, content long, h long, i long, start long, windows int, anchor int")


def ranges(found: np.ndarray, depth: int) -> list[tuple[int, int]]:
    """The byte ranges that sorted window starts cover."""
    if not len(found):
        return []
    new = np.concatenate([[True], found[1:] > found[:-1] + depth])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(found)) - 1
    return list(zip(found[first].tolist(), (found[last] + depth).tolist()))


_RANGES = "gram long, content long, s int, e int"


def named(keys: np.ndarray) -> np.ndarray:
    """Numbers from 0 on, equal for equal keys."""
    return np.unique(keys, return_inverse=True)[1].ravel()


def digit_passes(names: np.ndarray, digits: np.ndarray, copies: np.ndarray) -> list[np.ndarray]:
    """Most-significant-digit passes over strings, the rows of ``digits`` (256 beyond a string's end).

    ``names`` are the groups to begin with. The k-th result has each string's group after k digits, or -1 once
    it has left: because it ended, or because nothing else was in its group and it has no copies."""
    out = [names]
    alive = np.arange(len(names))
    for digit in digits.T:
        now = digit[alive]
        alive = alive[now < 256]
        group = named(out[-1][alive] * 256 + now[now < 256])
        stays = np.bincount(group, copies[alive])[group] > 1 if len(group) else np.zeros(0, bool)
        alive = alive[stays]
        after = np.full(len(names), -1)
        after[alive] = group[stays]
        out.append(after)
    return out


def strings(contents: list[bytes], begin: list[int], width: int, backwards: bool) -> np.ndarray:
    """A row of ``width`` digits for each content, from a place in it on, to the right or to the left."""
    rows = np.full((len(contents), width), 256, np.int16)
    for row, data, at in zip(rows, contents, begin):
        part = np.frombuffer(data, np.uint8)
        part = part[:at][::-1] if backwards else part[at:]
        row[: len(part)] = part[:width]
    return rows


def repeated_windows(grams: np.ndarray, copies: np.ndarray, contents: list[bytes], anchors: list[int], depth: int, gram: int) -> np.ndarray:
    """Which windows of some contents are repeated in their gram's group: a row for each content, a column for
    each place before the gram where a window may begin."""
    reach = depth - gram
    right = strings(contents, anchors, depth, False)
    # The first digit is the gram itself, so that grams of one hash and different bytes part here.
    first = named(np.ascontiguousarray(right[:, :gram].astype(np.uint8)).view(f"V{gram}").ravel())
    first = named(first * (int(grams.max()) + 1) + grams)
    after = [None] * gram + digit_passes(first, right[:, gram:], copies)
    before = digit_passes(first, strings(contents, anchors, reach, True), copies)
    sizes = np.array([len(c) for c in contents])
    anchors = np.array(anchors)
    again = np.zeros((len(contents), reach + 1), bool)
    for o in range(reach + 1):
        mine = np.flatnonzero((after[depth - o] >= 0) & (before[o] >= 0) & (o <= anchors) & (anchors - o + depth <= sizes))
        if len(mine):
            group = named(after[depth - o][mine] * len(contents) + before[o][mine])
            again[mine, o] = np.bincount(group, copies[mine])[group] > 1
    return again


def sort_groups(batches, depth: int, gram: int):
    """Rows (gram, content, copies, anchor, bytes) in the order of their grams -> covered ranges per content."""
    schema = pa.schema([("gram", pa.int64()), ("content", pa.int64()), ("s", pa.int32()), ("e", pa.int32())])

    def decide(rows):
        grams, content, copies, anchors, data = zip(*rows)
        again = repeated_windows(named(np.array(grams)), np.array(copies), data, list(anchors), depth, gram)
        out = {f.name: [] for f in schema}
        for k in np.flatnonzero(again.any(axis=1)):
            for s, e in ranges(anchors[k] - np.flatnonzero(again[k])[::-1], depth):
                for c, v in zip(out, (grams[k], content[k], s, e)):
                    out[c].append(v)
        return batch(schema, **out)

    held: list = []
    for b in batches:
        held += zip(*(b.column(c).to_pylist() for c in ("gram", "content", "copies", "anchor", "bytes")))
        # Whole groups: the last one may go on in the next batch.
        while len(held) > SORTED and held[0][0] != held[-1][0]:
            cut = SORTED
            while cut < len(held) and held[cut][0] == held[cut - 1][0]:
                cut += 1
            if cut == len(held):
                cut = next(k for k in range(len(held) - 1, 0, -1) if held[k][0] != held[k - 1][0])
            yield decide(held[:cut])
            held = held[cut:]
    if held:
        yield decide(held)


def covered(spark: SparkSession, docs: DataFrame, depth: int, gram: int, hot: int) -> DataFrame:
    """(h, ranges): the byte ranges of each distinct text that repeated windows cover, as (s, e) pairs."""
    found = materialize(spark, all_runs(docs, depth, gram), "runs")
    groups = found.groupBy("gram").agg(F.count("*").alias("n"), F.min("content").alias("lo"), F.max("content").alias("hi")).where("n > 1")
    # A table of its own: a join of two plain exchanges is one whose hot keys can be split.
    groups = materialize(spark, groups.select("gram", (F.col("lo") == F.col("hi")).alias("decided")), "groups")
    again = materialize(spark, found.join(groups, "gram"), "repeated")
    release(spark, found)
    sure = again.where("decided").select("h", "i", F.col("start").alias("s"), (F.col("start") + F.col("windows") - 1 + depth).alias("e"))

    open_runs = again.where("not decided")
    contents = open_runs.groupBy("gram", "content").agg(F.count("*").alias("copies"), F.min(F.struct("h", "i", "start", "windows", "anchor")).alias("at"))
    wanted = contents.groupBy("at.h", "at.i").agg(F.collect_list(F.struct(
        "gram", "content", "copies", F.col("at.start").alias("start"), F.col("at.windows").alias("windows"), F.col("at.anchor").alias("anchor"))).alias("wanted"))
    schema = pa.schema([("gram", pa.int64()), ("content", pa.int64()), ("copies", pa.int64()), ("anchor", pa.int32()), ("bytes", pa.binary())])

    def fetch(batches):
        for b in batches:
            rows = {f.name: [] for f in schema}
            for text, items in zip(b.column("text").to_pylist(), b.column("wanted").to_pylist()):
                data = encoded(text)
                for r in items:
                    for c in ("gram", "content", "copies", "anchor"):
                        rows[c].append(r[c])
                    rows["bytes"].append(data[r["start"] : r["start"] + r["windows"] - 1 + depth])
            yield batch(schema, **rows)

    bytes_of = distinct_texts(docs).join(wanted, ["h", "i"]).mapInArrow(fetch, "gram long, content long, copies long, anchor int, bytes binary")
    bytes_of = materialize(spark, bytes_of, "contents")
    sizes = bytes_of.groupBy("gram").agg(F.count("*").alias("contents"))
    tagged = bytes_of.join(sizes, "gram")
    cold = tagged.where(F.col("contents") <= hot).drop("contents").repartition("gram").sortWithinPartitions("gram")
    cold = cold.mapInArrow(lambda batches: sort_groups(batches, depth, gram), _RANGES)
    cells = pa.schema([("gram", pa.int64()), ("window", pa.binary()), ("content", pa.int64()), ("at", pa.int32()), ("copies", pa.int64())])

    def windows(batches):
        for b in batches:
            for g, c, n, data in zip(*(b.column(x).to_pylist() for x in ("gram", "content", "copies", "bytes"))):
                view, k = memoryview(data), len(data) - depth + 1
                yield batch(cells, gram=[g] * k, window=[xxhash.xxh3_128_digest(view[s : s + depth]) for s in range(k)], content=[c] * k, at=np.arange(k, dtype=np.int32), copies=[n] * k)

    dealt = tagged.where(F.col("contents") > hot).mapInArrow(windows, "gram long, window binary, content long, at int, copies long")
    twice = dealt.groupBy("window").agg(F.sum("copies").alias("n")).where("n > 1").select("window")
    dealt = dealt.join(twice, "window").select("gram", "content", F.col("at").alias("s"), (F.col("at") + depth).alias("e"))
    parts = materialize(spark, cold.union(dealt), "ranges")
    release(spark, bytes_of)

    late = open_runs.join(parts, ["gram", "content"]).select("h", "i", (F.col("start") + F.col("s")).alias("s"), (F.col("start") + F.col("e")).alias("e"))
    # Copies of a text give equal ranges: one of each is left before they are gathered per text.
    return sure.union(late).distinct().groupBy("h", "i").agg(F.sort_array(F.collect_list(F.struct("s", "e"))).alias("ranges"))


def distinct_texts(docs: DataFrame) -> DataFrame:
    return docs.select(*text_key(), F.coalesce("text", F.lit("")).alias("text")).dropDuplicates(["h", "i"])


def merge(pairs) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for s, e in pairs:
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [(s, e) for s, e in out]


def cut_texts(docs: DataFrame, cover: DataFrame, with_text: bool) -> DataFrame:
    """h, i, n_bytes, n_removed, n_spans, kept_sha256 and, with_text, the text that is left."""
    fields = [("h", pa.int64()), ("i", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())]
    schema = pa.schema(fields + [("kept_text", pa.string())] * with_text)

    def cut(batches):
        for b in batches:
            rows = {f.name: [] for f in schema}
            for text, found in zip(b.column("text").to_pylist(), b.column("ranges").to_pylist()):
                data = encoded(text)
                spans = merge((r["s"], r["e"]) for r in found or ())
                edges = [0, *(x for span in spans for x in span), len(data)]
                kept = b"".join(data[s:e] for s, e in zip(edges[::2], edges[1::2]))
                rows["n_bytes"].append(len(data))
                rows["n_removed"].append(len(data) - len(kept))
                rows["n_spans"].append(len(spans))
                rows["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
                if with_text:
                    # A range may end inside a character; what is left of it is no text.
                    rows["kept_text"].append(kept.decode("utf-8", "ignore"))
            rows["h"], rows["i"] = b.column("h"), b.column("i")
            yield batch(schema, **rows)

    ddl = "h long, i long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept_text string" * with_text
    return distinct_texts(docs).join(cover, ["h", "i"], "left").mapInArrow(cut, ddl)


def removed_spans(spark: SparkSession, docs: DataFrame, depth: int = DEPTH, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    docs = docs.select("doc_id", "text")
    results = cut_texts(docs, covered(spark, docs, depth, gram, hot), False)
    return docs.select("doc_id", *text_key()).join(results, ["h", "i"]).drop("h", "i")


def cut_documents(spark: SparkSession, docs: DataFrame, depth: int = DEPTH, gram: int = GRAM, hot: int = HOT, lengths: str | None = "n_chars") -> DataFrame:
    """The input's rows and columns with what is left of their texts. Null texts stay null; the column
    named by ``lengths``, where there is one, gets the new number of characters."""
    cover = covered(spark, docs.select("text"), depth, gram, hot)
    results = cut_texts(docs.select("text"), cover, True).where("n_removed > 0").select(F.col("h").alias("_h"), F.col("i").alias("_i"), F.col("kept_text").alias("_kept"))
    names = docs.columns
    own = {c: f"_row_{k}" for k, c in enumerate(names)}
    name = [k.alias(c) for k, c in zip(text_key(), ("_h", "_i"))]
    rows = docs.select(*[F.col(f"`{c}`").alias(o) for c, o in own.items()], *name).join(results, ["_h", "_i"], "left")
    new = {c: F.col(o) for c, o in own.items()}
    new["text"] = F.when(F.col("_kept").isNotNull(), F.col("_kept")).otherwise(F.col(own["text"]))
    if lengths in own:
        new[lengths] = F.when(F.col("_kept").isNotNull(), F.length("_kept").cast(docs.schema[lengths].dataType)).otherwise(F.col(own[lengths]))
    return rows.select(*[v.alias(c) for c, v in new.items()])


def op7_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .common import table

    return removed_spans(spark, table(spark, sf_dir, "documents"))
