import math
import zlib

import pytest
import zstandard

from chronoweave.llm import toxicity as tx


def test_held_out_documents(spark):
    root = "/root/testdata/sf0.1"
    rows = {r.doc_id: r for r in tx.op2_toxicity(spark, root).collect()}
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{root}/labels.parquet").collect()}
    assert len(rows) == spark.read.parquet(f"{root}/documents.parquet").count()
    for i, r in rows.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
    fold = [(rows[i].predicted, y) for i, y in labels.items() if i in rows and rows[i].held_out]
    caught = [p for p, y in fold if y == 1]
    wrong = [p for p, y in fold if y == 0]
    # 350 toxic documents to learn from here; with five times as many 90 of 100 are caught.
    assert sum(caught) / len(caught) > 0.5, sum(caught) / len(caught)
    assert sum(wrong) / len(wrong) < 0.04, sum(wrong) / len(wrong)


def test_small_and_odd_inputs(spark):
    docs = spark.createDataFrame([(1, None, "a"), (2, "", "b"), (None, "x", "c"), (1, None, "a"), (3, "word " * 30_000, "d"), (4, "... !", "e")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(1, 1), (2, None), (7, 0), (None, 1)], "doc_id long, toxic int")
    for use in (labels, labels.limit(0)):
        sample, odds = tx.training_sample(docs, use)
        rows = tx.score_documents(docs, tx.train(sample, odds)).collect()
        assert len(rows) == 6 and all(0 <= r.score <= 1 for r in rows)
    assert [r.held_out for r in rows if r.doc_id is None] == [True]
    model = tx.train([("you idiot fool " * 3, 1)] * 5 + [("a calm and quiet day", 0)] * 8)
    assert model.score("well, you idiot fool there") > model.score("a calm and quiet day here")
    assert tx.score_documents(docs.limit(0), model).count() == 0


def slow_score(model, text):
    """The score by its definition, with compressors made anew for every window."""
    lower = "".join(c.lower() if "A" <= c <= "Z" else c if ord(c) > 127 or "a" <= c <= "z" or c.isdigit() else " " for c in text or "")
    words = [w.encode() for w in lower.split(" ") if w]
    saved = []
    for k in range(0, len(words), tx.WINDOW):
        data = model.ordinary[: tx.LEAD] + b" " + b" ".join(words[k : k + tx.WINDOW]) + b" "
        sizes = []
        for content in (model.ordinary, model.toxic):
            settings = zstandard.ZstdCompressionParameters.from_level(
                tx.LEVEL, dict_size=len(content), min_match=tx.MIN_MATCH, write_content_size=False, write_checksum=False, write_dict_id=False, format=zstandard.FORMAT_ZSTD1_MAGICLESS)
            held = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            sizes.append(len(zstandard.ZstdCompressor(dict_data=held, compression_params=settings).compress(data)))
        saved.append(sizes[0] - sizes[1])
    x = [0.0] * 6
    if saved and model.toxic:
        some, many = sum(v >= 3 for v in saved), sum(v >= 5 for v in saved)
        x = [100 * sum(max(v - 1, 0) for v in saved) / (len(words) + 10), some / (len(saved) + 1), math.log(1 + some), math.log(1 + many), max(-6, min(8, max(saved))), sum(saved) / len(saved)]
    return 1 / (1 + math.exp(-sum(a * b for a, b in zip(model.weights, [1.0, *x]))))


def test_query_against_a_slow_reference(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    sample, odds = tx.training_sample(docs.select("doc_id", "text"), spark.read.parquet(f"{sf}/labels.parquet"))
    model = tx.train(sample, odds)
    texts = {r.doc_id: r.text for r in docs.collect()}
    labelled = {r.doc_id for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert {t for t, _ in sample} <= {t for i, t in texts.items() if i in labelled and zlib.crc32(str(i).encode()) % 5}
    got = {r.doc_id: r.score for r in tx.op2_toxicity(spark, sf).collect()}
    assert got == pytest.approx({i: slow_score(model, t) for i, t in texts.items()}, abs=1e-9)


def test_both_dictionaries_are_trained_on_their_own_text():
    toxic = [[b"calm", b"day%d" % k, b"you", b"idiot", b"fool", b"green"] for k in range(60)]
    plain = [[b"calm", b"day%d" % k, b"green", b"field", b"you"] for k in range(90)]
    windows = tx.toxic_windows(toxic, plain)
    assert windows and all(b"idiot" in w or b"fool" in w for w in windows)
    model = tx.dictionaries(toxic, plain, tx.trained_content([w for d in plain for w in tx.windows_of(d)], tx.BASE_BYTES))
    assert b"idiot" in model.toxic and b"idiot" not in model.ordinary
    assert b"field" in model.ordinary[-tx.OWN_BYTES - 32 :] and len(model.toxic) > 0
