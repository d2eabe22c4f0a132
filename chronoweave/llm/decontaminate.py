"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

The patterns are the windows of the benchmark items: ``window`` consecutive words, or the whole
item where it has fewer words but not none. Patterns of one length form a searcher. Its shift table
is keyed by blocks of two neighbouring words: a text position whose block stands in no pattern lets
the search jump ahead by as much as the pattern length allows; a block that ends patterns leads to
the bucket of those patterns, and a direct comparison of the words confirms each of them.

The patterns travel in blocks of at most ``max_words`` words (a longer item is a block of its own), a documented
bound on what the driver reads, broadcasts and holds at a time and on a worker's tables, which are built
once in a worker. A larger benchmark takes a pass over the rows for each block; a pass adds its hits to those of the
passes before it and is written to the shared folder before the next block is read.

Cases: null texts have no words; an empty table of documents gives no rows; an item or a text without words never hits; equal items each count;
null item ids are left out of the list of items; repeated document rows each give a row; an empty
benchmark hits nothing; columns other than the ids and texts are not read.
"""

from __future__ import annotations

import uuid
from collections import defaultdict
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, release

WINDOW = 13
MAX_WORDS = 400_000
#: Words are runs of ASCII letters and digits and of everything beyond ASCII.
_TABLE = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20
    for b in range(256)
)


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "replace").translate(_TABLE).split() if text else []


class Searcher:
    """Wu-Manber over patterns of ``m`` words each."""

    def __init__(self, patterns: dict[tuple[bytes, ...], list[str]], m: int):
        self.m, self.block = m, min(2, m)
        self.shift: dict = {}
        self.buckets: dict = defaultdict(list)
        self.default = m - self.block + 1
        for words, items in patterns.items():
            for end in range(self.block, m + 1):
                key = words[end - self.block : end] if self.block == 2 else words[end - 1]
                if m - end < self.shift.get(key, self.default):
                    self.shift[key] = m - end
            self.buckets[words[m - self.block :] if self.block == 2 else words[-1]].append((words, items))

    def search(self, text: list[bytes], hit: bytearray, items: set) -> None:
        m, shift, default, n = self.m, self.shift, self.default, len(text)
        i = m - 1
        while i < n:
            key = (text[i - 1], text[i]) if self.block == 2 else text[i]
            s = shift.get(key, default)
            if s:
                i += s
                continue
            at = i - m + 1
            for words, of in self.buckets[key]:
                if text[at] == words[0] and tuple(text[at : i + 1]) == words:
                    hit[at : i + 1] = b"\x01" * m
                    items.update(of)
            i += 1


def searchers(items: list[tuple[str, list[bytes]]], window: int) -> list[Searcher]:
    by_length: dict[int, dict] = defaultdict(lambda: defaultdict(list))
    for item, words in items:
        m = min(window, len(words))
        for at in range(len(words) - m + 1) if m else ():
            by_length[m][tuple(words[at : at + m])].append(item)
    return [Searcher(p, m) for m, p in sorted(by_length.items())]


def pattern_blocks(benchmark: DataFrame, max_words: int):
    """The items in blocks of at most max_words words (a longer single item is a block)."""
    block, held = [], 0
    rows = benchmark.select(F.col("item_id").cast("string").alias("item"), "text").toLocalIterator()
    for row in rows:
        words = words_of(row["text"])
        if not words:
            continue
        if held and held + len(words) > max_words:
            yield block
            block, held = [], 0
        block.append((row["item"], words))
        held += len(words)
    if block:
        yield block


@lru_cache(maxsize=1)
def tables(key: str, window: int, held) -> list[Searcher]:
    """A block's searchers, built once in a worker; the key names the block."""
    return searchers(held.value, window)


def mark_contamination(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, max_words: int = MAX_WORDS, with_rows: bool = False
) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated; with_rows puts the input's columns first."""
    names = docs.columns if with_rows else ["doc_id"]
    own = {c: f"_row_{k}" for k, c in enumerate(names)}
    frame = docs.select(*[F.col(f"`{c}`").alias(own[c]) for c in names], F.col("text").alias("_text"), F.lit(None).cast("binary").alias("_hit"), F.lit(None).cast("array<string>").alias("_items"))
    spark, schema = docs.sparkSession, frame.schema
    written = None
    blocks = pattern_blocks(benchmark, max_words)
    block = next(blocks, [])
    while block is not None:
        held, key, following = spark.sparkContext.broadcast(block), uuid.uuid4().hex, next(blocks, None)

        def search(batches, held=held, key=key):
            found = tables(key, window, held)
            for b in batches:
                hits, lists = [], []
                for text, hit, items in zip(b.column("_text").to_pylist(), b.column("_hit").to_pylist(), b.column("_items").to_pylist()):
                    words = words_of(text)
                    hit = bytearray(hit) if hit is not None else bytearray(len(words))
                    items = set(items or ())
                    for s in found:
                        s.search(words, hit, items)
                    hits.append(bytes(hit))
                    lists.append([x for x in items if x is not None])
                columns = [b.column(c) for c in b.schema.names[:-2]] + [pa.array(hits, pa.binary()), pa.array(lists, pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays(columns, names=b.schema.names)

        frame = frame.mapInArrow(search, schema)
        if following is not None:
            frame = materialize(spark, frame, "hits")
            held.destroy()
            if written is not None:
                release(spark, written)
            written = frame
        block = following

    hit = F.length(F.regexp_replace(F.decode("_hit", "ISO-8859-1"), "\\x00", ""))
    frame = frame.select(
        *[F.col(own[c]).alias(c) for c in names],
        F.length("_hit").cast("long").alias("n_words"), hit.cast("long").alias("n_hit"),
        F.size("_items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("_items"), ","), 256).alias("items_sha256"),
    )
    return frame.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, max_words: int = MAX_WORDS) -> DataFrame:
    """The input's rows and columns that are not contaminated, whatever the columns' names."""
    own = [f"_in_{k}" for k in range(len(docs.columns))]
    renamed = docs.select("text", *[F.col(f"`{c}`").alias(o) for c, o in zip(docs.columns, own)])
    marked = mark_contamination(renamed, benchmark, window, max_words, with_rows=True)
    return marked.where(~F.col("contaminated")).select(*[F.col(o).alias(c) for c, o in zip(docs.columns, own)])


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .common import table

    return mark_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP8_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, m, array_to_string(w[i:i + m - 1], ' ') AS k FROM (
    SELECT item_id, w, least(13, len(w)) AS m, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
ms AS (SELECT DISTINCT m FROM bw),
dw AS (SELECT doc_id, i, m, array_to_string(w[i:i + m - 1], ' ') AS k FROM (
    SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM d, ms WHERE len(w) >= m)),
h AS (SELECT doc_id, i, dw.m, item_id FROM dw JOIN bw ON dw.k = bw.k AND dw.m = bw.m),
hw AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS p FROM h) GROUP BY 1),
hi AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS x FROM h) GROUP BY 1)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
    sha256(coalesce(items, '')) AS items_sha256,
    coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hw USING (doc_id) LEFT JOIN hi USING (doc_id)
"""
