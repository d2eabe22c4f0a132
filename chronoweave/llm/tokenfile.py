"""Token ids as Parquet lists, in document order, with selective reads.

Format. A folder of Parquet files, one per range of (doc_id, hash of the text), in ascending order; there are as
many ranges as the input has ``RANGE_BYTES``, so files are of like size whatever the session's settings, and a
repeated id is no single range. Per document: ``part`` (the range), ``doc_id``, ``local_start`` (ids before it in its part), ``n_tokens`` and
``ids`` (a list of 32-bit ids). Ids are dictionary encoded, the other columns dictionary or delta encoded
(version 2 pages); row groups, pages and dictionaries have set sizes, and the page indexes let a
reader take the rows of some documents or only the metadata columns. A document's global start is its
local start plus the lengths of the parts before, which come from the metadata columns alone.

Encoding. The library encodes pieces of a text. A text is cut before white space that follows another
character, and before punctuation that follows a Latin letter: there the pre-tokeniser always
has a boundary, and it looks at nothing before a match. The first ``MAX_PIECES`` pieces of a worker, of at most
``LONGEST`` characters, stay in a table, others for the group of texts at hand. Groups are small, as a worker holds all
pieces of one: that leaves its memory to the table. A text with a special token's string goes whole.

Cases: a null text counts as empty and has the end id only; repeated rows each give a row, equal ids in
the order of their texts' hashes; null ids come first, and ids of any type keep it; an empty table gives an empty
file set, read back without rows; other columns are not read.
"""

from __future__ import annotations

import math
import os
import re
import zlib
from array import array
from functools import lru_cache
from itertools import compress, count, islice
from operator import not_

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import batch, id_types, new_folder

END_ID = 2
MAX_PIECES = 900_000
LONGEST = 64
GROUP = 256
ROW_GROUP_BYTES = 32 << 20
PAGE_BYTES = 128 << 10
DICTIONARY_BYTES = 1 << 20
#: Bytes of the input, as Spark's statistics have them, for a range.
RANGE_BYTES = 16 << 20
_LATIN = "A-Za-zÀ-ÖØ-öø-ɏ"
_PUNCTUATION = r"!-/:-@\[-`{-~"
#: A word, punctuation, or else anything up to white space that follows another character.
_PIECE = re.compile(
    rf"[ \n]?[{_LATIN}]+(?=[ \n\t\r{_PUNCTUATION}]|\Z)|(?<=[{_LATIN}])[{_PUNCTUATION}]+(?=[ \n\t\r]|\Z)"
    r"|(?s:.+?)(?:(?<=[^\s\x1c-\x1f\x85\u180e])(?=[ \n\t\r])|\Z)"
)


class PieceEncoder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.held: dict[str, bytes] = {}

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, packed as little-endian unsigned 32-bit integers."""
        out: list[bytes] = []
        for at in range(0, len(texts), GROUP):
            cut, got, holes = [], [], []
            for t in texts[at : at + GROUP]:
                pieces = [t] if any(s in t for s in self.special) else _PIECE.findall(t)
                ids = list(map(self.held.get, pieces))
                holes.append(list(compress(count(), map(not_, ids))) if None in ids else ())
                got.append(ids)
                cut.append([pieces[k] for k in holes[-1]])
            new = list(set().union(*cut))
            made = {p: array("I", e.ids).tobytes() for p, e in zip(new, self.tokenizer.encode_batch_fast(new, add_special_tokens=False))}
            for ids, places, missed in zip(got, holes, cut):
                for k, p in zip(places, missed):
                    ids[k] = made[p]
                out.append(b"".join(ids))
            short = ((p, x) for p, x in made.items() if len(p) <= LONGEST)
            self.held.update(islice(short, max(0, MAX_PIECES - len(self.held))))
        return out


@lru_cache(maxsize=2)
def piece_encoder(path: str) -> PieceEncoder:
    return PieceEncoder(path)


def ranges_of(docs: DataFrame) -> int:
    """How many ranges the documents are written in, from the size of the files that they are read from."""
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(1, min(math.ceil(size / RANGE_BYTES), 100_000))


def write_tokens(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int = END_ID, parts: int | None = None) -> None:
    """Encode the documents, append end_id to each, and write the files."""
    parts = parts or ranges_of(docs)
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    arrow_id, sql_id = id_types(docs)
    order = ["doc_id", F.xxhash64("text")]
    ranged = docs.repartitionByRange(parts, *order).sortWithinPartitions(*order, "text")
    end = np.array([end_id], "<u4").tobytes()
    schema = pa.schema([("part", pa.int32()), ("doc_id", arrow_id), ("local_start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.list_(pa.int32()))])

    def encode(batches):
        from pyspark import TaskContext

        encoder, part, start = piece_encoder(tokenizer_path), TaskContext.get().partitionId(), 0
        for b in batches:
            packed = [x + end for x in encoder.encode(b.column("text").to_pylist())]
            sizes = np.array([len(x) // 4 for x in packed], np.int64)
            offsets = np.concatenate([[0], np.cumsum(sizes)])
            ids = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.frombuffer(b"".join(packed), "<i4"), pa.int32()))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(sizes), part, np.int32)), b.column("doc_id"), pa.array(start + offsets[:-1], pa.int64()), pa.array(sizes, pa.int64()), ids], schema=schema)
            start += int(offsets[-1])

    (
        ranged.mapInArrow(encode, f"part int, doc_id {sql_id}, local_start long, n_tokens long, ids array<int>").write
        .option("parquet.writer.version", "v2").option("parquet.enable.dictionary", "true")
        .option("parquet.block.size", ROW_GROUP_BYTES).option("parquet.page.size", PAGE_BYTES).option("parquet.dictionary.page.size", DICTIONARY_BYTES)
        .option("compression", "zstd").parquet(folder)
    )


def read_files(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(folder)


def with_starts(rows: DataFrame, files: DataFrame) -> DataFrame:
    """Adds ``start``, the ids of all documents before a row's, to rows with ``part`` and
    ``local_start``; of the files it reads the metadata columns only."""
    sizes = files.groupBy("part").agg(F.sum("n_tokens").alias("size"))
    # One row per part: the scan over them is small, whatever the number of documents.
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("part", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("offset"))
    return rows.join(offsets, "part").withColumn("start", F.col("offset") + F.col("local_start")).drop("offset")


def read_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """The files' rows with ``start``; columns that are not asked for are not read."""
    files = read_files(spark, folder)
    return with_starts(files, files)


def checksums(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens and the crc32 of the ids. The Parquet reader hands over batches of lists, and the
    sums are made there, so that the lists travel nowhere else."""
    files = read_files(spark, folder)
    arrow_id, sql_id = id_types(files)
    schema = pa.schema([("part", pa.int32()), ("doc_id", arrow_id), ("local_start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def crc(batches):
        for b in batches:
            lists = b.column("ids")
            values, offsets = lists.values.to_numpy(zero_copy_only=False).astype("<i4", copy=False), lists.offsets.to_numpy()
            if (np.diff(offsets) != b.column("n_tokens").to_numpy()).any():
                raise ValueError("a list's length differs from its n_tokens")
            sums = [zlib.crc32(values[s:e]) for s, e in zip(offsets[:-1], offsets[1:])]
            yield batch(schema, **{c: b.column(c) for c in ("part", "doc_id", "local_start", "n_tokens")}, ids_crc32=sums)

    rows = files.mapInArrow(crc, f"part int, doc_id {sql_id}, local_start long, n_tokens long, ids_crc32 long")
    return with_starts(rows, files).select("doc_id", "start", "n_tokens", "ids_crc32")


def op4_tokenfile(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as P

    from .common import table

    folder = new_folder(spark, "tokens")
    write_tokens(table(spark, sf_dir, "documents"), folder, P.path("byte_bpe_50k.json"))
    return checksums(spark, folder)
