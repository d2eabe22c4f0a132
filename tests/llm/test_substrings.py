import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa

from chronoweave.llm import substrings as ss


def brute(texts, depth):
    data = [(t or "").encode() for t in texts]
    n = Counter(d[i : i + depth] for d in data for i in range(len(d) - depth + 1))
    out = []
    for d in data:
        hit = bytearray(len(d))
        for i in range(len(d) - depth + 1):
            if n[d[i : i + depth]] > 1:
                hit[i : i + depth] = b"\x01" * depth
        spans = sum(hit[i] and not (i and hit[i - 1]) for i in range(len(d)))
        kept = bytes(b for b, h in zip(d, hit) if not h)
        out.append((len(d), sum(hit), spans, hashlib.sha256(kept).hexdigest()))
    return out


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: rng.choice(["ab", "é", "xyz", "the", "of", "日本", "q"])
    shared = [" ".join(word() for _ in range(60)) for _ in range(3)]
    texts = [None, "", "a" * 49, "a" * 50, "a" * 51, "a" * 300, "ab" * 120, "same text " * 3, shared[0], shared[0]]
    for _ in range(60):
        body = " ".join(word() for _ in range(rng.randint(1, 60)))
        k = rng.randint(0, 4)
        if k < 3:
            cut = rng.randint(0, 80)
            body = body[: rng.randint(0, len(body))] + shared[k][cut : cut + rng.randint(30, 200)] + body
        texts.append(body)
    return texts + texts[20:24]


def test_against_brute_force(spark):
    for seed, hot, gram in ((1, 4000, 12), (2, 2, 20)):
        texts = corpus(seed)
        docs = spark.createDataFrame([(k, t, "z") for k, t in enumerate(texts)], "doc_id int, text string, n_bytes string").repartition(3)
        got = sorted(tuple(r) for r in ss.removed_spans(spark, docs, 50, gram, hot).collect())
        assert got == [(k, *w) for k, w in enumerate(brute(texts, 50))]


def test_default_parameters_and_the_query(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    got = sorted(tuple(r) for r in ss.op7_substrings(spark, sf).collect())
    assert got == sorted((r.doc_id, *w) for r, w in zip(docs, brute([r.text for r in docs], ss.DEPTH)))
    rng = random.Random(4)
    base = "".join(rng.choices("abcdefgh \u00e9", k=1500))
    texts = []
    for k in range(120):
        copy = list(base)
        for i in rng.sample(range(1500), rng.randint(0, 6)):
            copy[i] = rng.choice("xyz")
        texts.append("".join(copy[rng.randint(0, 300) : rng.randint(600, 1500)]))
    texts += texts[:3] + ["ab" * 400, "ba" * 150, "a" * 199, "a" * 200, "a" * 201]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    want = [(k, *w) for k, w in enumerate(brute(texts, 200))]
    for hot in (ss.HOT, 20):
        assert sorted(tuple(r) for r in ss.removed_spans(spark, docs, hot=hot).collect()) == want


def test_groups_of_one_hash_and_different_bytes(monkeypatch):
    contents = [b"g" * 4 + b"abcd", b"g" * 4 + b"abce", b"h" * 4 + b"abcd", b"h" * 4 + b"abcd" + b"z", b"xg" + b"gggabcd"]
    again = ss.repeated_windows(np.zeros(5, int), np.array([1, 1, 1, 1, 1]), contents, [0, 0, 0, 0, 1], 8, 4)
    assert again.tolist() == [[True, *[False] * 4], [False] * 5, [True, *[False] * 4], [True, *[False] * 4], [True, *[False] * 4]]


def test_sorting_in_parts(spark, monkeypatch):
    texts = corpus(3)
    rows = []
    for k, t in enumerate(texts):
        for piece, g, c, s, n, at in zip(*(ss.runs([ss.encoded(t)], 50, 12) or [[]] * 6)):
            rows.append((int(g), int(c), 1, int(at), ss.encoded(t)[s : s + n - 1 + 50]))
    rows = sorted({r[:2]: r for r in rows}.values())
    batches = [pa.RecordBatch.from_pylist([dict(zip(("gram", "content", "copies", "anchor", "bytes"), r)) for r in rows[a : a + 9]]) for a in range(0, len(rows), 9)]
    collected = lambda: sorted(map(str, (r for b in ss.sort_groups(batches, 50, 12) for r in b.to_pylist())))
    want = collected()
    monkeypatch.setattr(ss, "SORTED", 3)
    assert want and collected() == want


def test_long_texts_and_buffers(spark, monkeypatch):
    rng = random.Random(9)
    block = "".join(rng.choices("abcdef ", k=700))
    texts = ["".join(rng.choices("abcdef ", k=1_500_000)) + block, block[100:500] + "tail", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    r = {x.doc_id: x for x in ss.removed_spans(spark, docs).collect()}
    assert r[0].n_removed == 400 and r[0].n_spans == 1 and r[1].n_removed == 400 and r[2].n_bytes == 0


def test_cut_documents_keeps_columns(spark):
    block = "0123456789abcdef" * 20 + "é"
    docs = spark.createDataFrame([(1, block + " one", 5, "a"), (2, "two " + block, 6, "b"), (None, None, 7, "c"), (3, "short", 8, "d")], "doc_id long, text string, n_chars long, h string")
    out = ss.cut_documents(spark, docs)
    assert out.columns == docs.columns
    rows = {r.doc_id: r for r in out.collect()}
    assert rows[1].text == " one" and rows[1].n_chars == 4 and rows[2].text == "two " and rows[None].text is None and rows[3].text == "short" and rows[3].h == "d"
    assert ss.removed_spans(spark, docs.limit(0)).count() == 0
