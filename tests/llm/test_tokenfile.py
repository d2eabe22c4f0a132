import glob
import random
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow.parquet as pq
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from chronoweave.llm import tokenfile as tf
from chronoweave.llm.common import new_folder

PATH = P.path("byte_bpe_50k.json")


def test_files_round_trip(spark):
    rng = random.Random(3)
    parts = ["the ", "  two", "it's", "\n x", " \n", "　 y", "\x85 z", "\t", " ", "é à", "<|endoftext|>", "<|end", "日本", "12 3", "...", "᠎ q", "\x1c w", "end.\n", "x,y", "no. 5", "a.'s", "é, ", "é;", "1, ", "_. ", "x're", "y'", "a_b", "c##", "d**e", "f's't", "(g)"]
    texts = [None, "", " ", "a" * 3000, "word " * 500] + ["".join(rng.choices(parts, k=rng.randint(1, 80))) for _ in range(120)]
    rows = [(rng.randint(0, 10_000), t, "q") for t in texts] + [(None, "null id", "q"), (7, "same", "q"), (7, "same", "q")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start string")
    folder = new_folder(spark, "t")
    tf.write_tokens(docs, folder, PATH, parts=5)
    got = sorted((tuple(r) for r in tf.checksums(spark, folder).collect()), key=lambda r: r[1])
    assert len(glob.glob(folder.removeprefix("file://").removeprefix("file:") + "/part-*")) == 5
    tok = Tokenizer.from_file(PATH)
    start, want = 0, []
    hashed = {r.t: r.h for r in spark.createDataFrame([(t or "",) for _, t, _ in rows], "t string").select("t", F.xxhash64("t").alias("h")).collect()}
    for i, t in sorted(((i, t or "") for i, t, _ in rows), key=lambda r: (-1 if r[0] is None else r[0], hashed[r[1]])):
        ids = tok.encode(t, add_special_tokens=False).ids + [2]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert got == want


def test_format_and_empty(spark, sf):
    folder = new_folder(spark, "t")
    tf.write_tokens(spark.read.parquet(f"{sf}/documents.parquet"), folder, PATH, parts=2)
    path = folder.removeprefix("file://").removeprefix("file:")
    column = pq.ParquetFile(glob.glob(f"{path}/part-*")[0]).metadata.row_group(0).column(4)
    assert any("DICTIONARY" in e for e in column.encodings) and column.has_offset_index and column.has_column_index
    plan = tf.read_tokens(spark, folder).select("doc_id", "start")._jdf.queryExecution().executedPlan().toString()
    assert "array<int>" not in plan
    scans = tf.checksums(spark, folder)._jdf.queryExecution().executedPlan().toString()
    assert scans.count("ids:array<int>") == 1 and "binaryFile" not in scans
    folder = new_folder(spark, "t")
    tf.write_tokens(spark.createDataFrame([], "doc_id long, text string"), folder, PATH)
    assert tf.checksums(spark, folder).count() == 0


def test_table_bound(monkeypatch):
    monkeypatch.setattr(tf, "MAX_PIECES", 10)
    tok, encoder = Tokenizer.from_file(PATH), tf.PieceEncoder(PATH)
    texts = [f"word{k} and another{k % 7}, thing{k}.\n" * 3 for k in range(400)]
    assert encoder.encode(texts) == [np.array(tok.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert len(encoder.held) <= 10


def test_the_library_is_asked_once_for_a_piece_and_long_ones_are_not_kept():
    encoder, asked = tf.PieceEncoder(PATH), []

    class Library:
        def encode_batch_fast(self, pieces, add_special_tokens):
            asked.append(len(pieces))
            return [type("Ids", (), {"ids": [len(p)]}) for p in pieces]

    encoder.tokenizer = Library()
    letters = str.maketrans("0123456789", "abcdefghij")
    words = [str(k).translate(letters) for k in range(100_000, 700_000)]
    texts = [" ".join(words[k : k + 600]) for k in range(0, len(words), 600)] + ["x" * 5_000]
    first = encoder.encode(texts)
    # 600,000 words, the thousand that begin a text as they stand without a space, and the long one.
    assert sum(asked) == 600_001 and len(encoder.held) == 600_000 and max(map(len, encoder.held)) == 7
    assert encoder.encode(texts) == first and sum(asked) == 600_002
    assert max(asked) <= 256 * 600


def test_ranges_follow_bytes_and_a_repeated_id_is_split(spark, monkeypatch):
    docs = spark.range(400).select(F.lit("same").alias("doc_id"), F.repeat(F.col("id").cast("string"), 50).alias("text"))
    folder = new_folder(spark, "t")
    monkeypatch.setattr(tf, "RANGE_BYTES", 2_000)
    assert tf.ranges_of(docs) > 3
    tf.write_tokens(docs, folder, PATH, parts=4)
    rows = tf.read_tokens(spark, folder)
    sizes = [r["count"] for r in rows.groupBy("part").count().collect()]
    assert len(sizes) == 4 and max(sizes) < 250 and {r.doc_id for r in rows.collect()} == {"same"}


def test_query_equals_the_library(spark, sf):
    tok = Tokenizer.from_file(PATH)
    start, want = 0, []
    for r in sorted(spark.read.parquet(f"{sf}/documents.parquet").collect(), key=lambda r: r.doc_id):
        ids = tok.encode(r.text or "", add_special_tokens=False).ids + [2]
        want.append((r.doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(tuple(r) for r in tf.op4_tokenfile(spark, sf).collect()) == want
