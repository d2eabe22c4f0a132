import hashlib
import random

import numpy as np
import public_tokenizers as P
import pytest

from chronoweave.llm import bpe

RANKS = P.path("byte_bpe_50k.tiktoken")


def brute(text):
    ids = bpe.encoding(RANKS, P.PATTERN).encode_ordinary(text or "")
    return len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()


def texts():
    rng = random.Random(5)
    parts = ["the ", "it's ", "we'll", " \n\n", "   ", "123 4", "éàü ", "日本語", "...!!", "\t", "x", "'re", "'", " don't", "<|endoftext|>", "😀"]
    out = [None, "", " ", "a", "'" * 300, "a" * 700, " " * 900, "\n" * 400 + "b", "word " * 200]
    out += ["".join(rng.choices(parts, k=rng.randint(1, 400))) for _ in range(60)]
    return out


def test_chunks_equal_the_whole_text(spark):
    rows = [(k, t, "extra") for k, t in enumerate(texts())] + [(None, "null id", "extra"), (3, "a", "extra"), (8, "word " * 200, "extra")]
    docs = spark.createDataFrame(rows, "doc_id int, text string, n_tokens string")
    for size, overlap in ((64, 16), (200, 40), (100_000, 1000)):
        got = bpe.encode_documents(docs, RANKS, P.PATTERN, size, overlap).collect()
        assert sorted(map(str, got)) == sorted(map(str, [type(got[0])(doc_id=i, n_tokens=n, ids_sha256=a, decoded_sha256=b) for i, t, _ in rows for n, a, b in [brute(t)]]))


def test_empty_table_and_bad_overlap(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.encode_documents(docs, RANKS, P.PATTERN).count() == 0
    with pytest.raises(ValueError):
        bpe.encode_documents(docs, RANKS, P.PATTERN, 100, 60)


def odd_texts():
    """Every character that the two libraries class differently, between characters of each class."""
    odd = list(map(chr, bpe.stand_ins()))
    assert len(odd) > 10_000
    random.Random(8).shuffle(odd)
    parts = []
    for k, c in enumerate(odd):
        parts.append(("a%s's ", "1%s2 ", "!%s'll", " %s\n ", "x %s%s", "%s")[k % 6].replace("%s", c))
    return ["".join(parts), "-" * 1200 + " word" * 800 + " x \u0c5c's end", " " * 20_000 + "".join(parts[:3000]) + "\t" * 12_000]


def test_classes_of_characters_are_the_library_s(spark):
    made = odd_texts()
    assert any(len(t) > bpe.CHUNK_CHARS for t in made)
    docs = spark.createDataFrame(list(enumerate(made)), "doc_id long, text string")
    want = sorted(str((k, *brute(t))) for k, t in enumerate(made))
    for size, overlap in ((bpe.CHUNK_CHARS, bpe.OVERLAP), (500, 100), (100_000, 2_000)):
        got = bpe.encode_documents(docs, RANKS, P.PATTERN, size, overlap).collect()
        assert sorted(str(tuple(r)) for r in got) == want


def test_long_white_space_is_split_as_the_library_splits_it(monkeypatch):
    made = [t for t in texts() if t] + odd_texts()
    want = [bpe.encoding(RANKS, P.PATTERN).encode_ordinary(t) for t in made]
    monkeypatch.setattr(bpe, "LONG_SPACE", 1)
    monkeypatch.setattr(bpe, "_SPACES", bpe.regex.compile(r"\s|."))
    assert [bpe.encode_piece(t, RANKS, P.PATTERN) for t in made] == want
    monkeypatch.undo()
    ids = bpe.encode_piece("a" + " " * 2_000_000 + "b", RANKS, P.PATTERN)
    assert bpe.encoding(RANKS, P.PATTERN).decode(ids) == "a" + " " * 2_000_000 + "b"


def test_query_equals_the_library(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    got = bpe.op1_bpe(spark, sf).collect()
    assert sorted(str(tuple(r)) for r in got) == sorted(str((r.doc_id, *brute(r.text))) for r in docs)


def test_ids_of_any_type(spark):
    docs = spark.createDataFrame([("a", "x"), (None, "y " * 100)], "doc_id string, text string")
    assert {r.doc_id for r in bpe.encode_documents(docs, RANKS, P.PATTERN, 64, 16).collect()} == {"a", None}


def test_patterns_with_other_classes_are_refused():
    with pytest.raises(ValueError):
        bpe.compiled(r"\p{Lu}+|\d")
