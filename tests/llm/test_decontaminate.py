import hashlib
import random
import re

from chronoweave.llm import decontaminate as dc

WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(t):
    return re.findall(WORDS, "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))


def brute(text, items, window=13):
    w = words(text)
    hit, found = set(), set()
    for item, t in items:
        iw = words(t)
        m = min(window, len(iw))
        for k in range(len(iw) - m + 1) if m else ():
            for i in range(len(w) - m + 1):
                if w[i : i + m] == iw[k : k + m]:
                    hit.update(range(i, i + m))
                    found.add(str(item))
    return len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)


def test_against_brute_force(spark):
    rng = random.Random(1)
    vocab = ["Aa", "b", "cé", "d1", "e", "ß"]
    long = " ".join(rng.choices(vocab, k=60))
    items = [(1, long), (2, "b e"), (30, "e"), (4, None), (5, "... !"), (6, long.upper()), (7, " ".join(["b"] * 20))]
    texts = [None, "", "b, E!", "b" * 10, " ".join(["b"] * 40), long, "x " * 30 + long[:90], "x " * 900 + "b e"]
    texts += [" ".join(rng.choices(vocab, k=rng.randint(1, 200))) for _ in range(40)]
    docs = spark.createDataFrame([(k, t, 0) for k, t in enumerate(texts)] + [(None, "b", 1), (2, "b, E!", 1)], "doc_id long, text string, n_words int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    for bound in (2_000_000, 30):
        got = dc.mark_contamination(docs, bench, max_words=bound).collect()
        assert len(got) == docs.count()
        want = sorted(str((r.doc_id, *brute(r.text, items))) for r in docs.collect())
        assert sorted(str(tuple(r)) for r in got) == want


def test_a_benchmark_of_several_blocks(spark, monkeypatch):
    rng = random.Random(2)
    vocab = [f"w{k}" for k in range(30)]
    items = [(k, " ".join(rng.choices(vocab, k=40))) for k in range(5)]
    bench = spark.createDataFrame(items, "item_id long, text string").coalesce(1)
    assert [len(b) for b in dc.pattern_blocks(bench, 45)] == [1] * 5
    # Blocks are read one by one: the second is not asked for before the first is used.
    assert next(iter(dc.pattern_blocks(bench, 45)))[0][0] in map(str, range(5))
    texts = [" ".join(rng.choices(vocab, k=9)) + " " + t[10:90] for _, t in items] * 2 + [items[0][1] + " " + items[4][1]]
    docs = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)], "doc_id string, text string, _hit string")
    got = dc.mark_contamination(docs, bench, max_words=45, with_rows=False).collect()
    assert sorted(str(tuple(r)) for r in got) == sorted(str((str(k), *brute(t, items))) for k, t in enumerate(texts))
    kept = dc.drop_contaminated(docs, bench, max_words=45)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {str(k) for k, t in enumerate(texts) if not brute(t, items)[4]}


def test_empty_benchmark_and_rows(spark):
    docs = spark.createDataFrame([(1, "a b", "z")], "doc_id long, text string, n_hit string")
    none = spark.createDataFrame([], "item_id long, text string")
    r = dc.mark_contamination(docs, none).collect()
    assert [(x.n_words, x.n_hit, x.contaminated) for x in r] == [(2, 0, False)]
    bench = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert dc.mark_contamination(docs.limit(0), bench).count() == 0 and dc.drop_contaminated(docs.limit(0), bench).count() == 0
