import hashlib

import corpus_pipeline as cp
import numpy as np
import public_tokenizers as P
from test_decontaminate import brute as contamination
from test_neardup import brute as groups
from test_quality import brute as measures
from collections import Counter

from chronoweave.llm import bpe


def cut(texts, depth=200):
    data = [t.encode() for t in texts]
    n = Counter(d[i : i + depth] for d in data for i in range(len(d) - depth + 1))
    out = []
    for d in data:
        hit = bytearray(len(d))
        for i in range(len(d) - depth + 1):
            if n[d[i : i + depth]] > 1:
                hit[i : i + depth] = b"\x01" * depth
        out.append(bytes(b for b, h in zip(d, hit) if not h).decode("utf-8", "ignore"))
    return out


def good(text):
    n_words, chars, symbols, dup, rep = measures(text)
    lines = sum(bool(x.strip(" \t\r\x0b\x0c")) for x in (text or "").split("\n"))
    return not (n_words < 10 or 100 * rep > 20 * n_words or chars < 2 * n_words or chars > 20 * n_words or 10 * symbols > n_words or (lines > 3 and 2 * dup > lines))


def test_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    rows = [(r.doc_id, r.text) for r in docs if good(r.text)]
    rows = [row for row, (_, n, _, kept) in zip(rows, groups(rows)) if kept]
    rows = list(zip((i for i, _ in rows), cut([t for _, t in rows])))
    rows = [(i, t) for i, t in rows if not contamination(t, items)[4]]
    enc = bpe.encoding(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    want = []
    for i, t in rows:
        packed = np.array(enc.encode_ordinary(t), "<u4").tobytes()
        want.append((i, len(packed) // 4, hashlib.sha256(packed).hexdigest(), hashlib.sha256(t.encode()).hexdigest(), packed))
    got = sorted((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256, bytes(r.ids)) for r in cp.run(spark, sf).collect())
    assert got == sorted(want)


def test_stages_keep_columns_and_survive_empty_tables(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    odd = spark.createDataFrame([(1, "word and more words in a text of some length here", "en", "s", 5, 1, "k"), (1, None, None, None, None, 2, "k")],
                                "doc_id long, text string, lang string, source string, n_chars long, n_words int, kept string")
    for name, stage in cp.STAGES[:-1]:
        assert stage(spark, docs, sf).columns == docs.columns
        out = stage(spark, odd, sf)
        assert out.columns == odd.columns and out.count() >= 1
    assert cp.STAGES[-1][1](spark, docs, sf).count() == 0
