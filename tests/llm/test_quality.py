import re
from collections import Counter

from chronoweave.llm import quality

TEXTS = [None, "", " \n\t", "one", "a b c d e f g h i j", "x " * 40, "the cat sat on a mat the cat sat on a dog and more words here",
         "line one\nline one\n\nother\nline one\n", "## $$ %% && || << >> ** # $ % &", "é ü 日本 \x0b w\x0cz", "word " * 3000, "a" * 50_000,
         "a b c d e a b c d e f g h i j k l m n o p q r s t u v w x y z 1 2 3 4 5 6 7 8 9",
         "every morning the baker opens a small shop and sells fresh bread to people nearby"]


def brute(text):
    text = text or ""
    w = [x for x in re.split("[\x20\x09-\x0d]+", text) if x]
    grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    n = Counter(grams)
    rep = {p for i, g in enumerate(grams) if n[g] > 1 for p in range(i, i + 5)}
    lines = [x for x in text.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    return len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(rep)


def test_measurements(spark):
    rows = [(k, t, 1) for k, t in enumerate(TEXTS)] + [(None, "null id", 2), (0, None, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_words int").select("doc_id", "text")
    got = quality.ledger(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute(r.text), r.text
        assert bool(r.failures & quality.mask_of("base-v1")) == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)


def test_policies_and_ablations(spark):
    docs = spark.createDataFrame([(k, t, "q", 3) for k, t in enumerate(TEXTS)], "doc_id long, text string, failures string, n_words int")
    kept = quality.apply_rules(docs)
    assert kept.columns == docs.columns
    ids = {r.doc_id for r in kept.collect()}
    assert 13 in ids and 5 not in ids and 0 not in ids
    rows = quality.ledger(docs.select("doc_id", "text"))
    table = {r.rule: (r.n_failed, r.n_only) for r in quality.ablations(rows).collect()}
    failures = [r.failures for r in rows.collect()]
    mask = quality.mask_of(quality.PRODUCTION)
    assert set(table) == set(quality.POLICIES[quality.PRODUCTION])
    for k, (name, _) in enumerate(quality.RULES):
        if name not in table:
            continue
        assert table[name] == (sum(f >> k & 1 for f in failures), sum(f & mask == 1 << k for f in failures))
    assert quality.ledger(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_a_stored_ledger_serves_every_policy(spark):
    from chronoweave.llm.common import new_folder

    texts = TEXTS + ["one # two three four five six seven eight nine ten", "a ## b ## c ## d ## e ## f g h i j k l"]
    docs = spark.createDataFrame([(k, t, "own", 9, "w") for k, t in enumerate(texts)], "doc_id long, text string, failures string, n_words int, _words string")
    folder = new_folder(spark, "ledger")
    quality.store(docs, folder)
    rows = spark.read.parquet(folder)
    assert "text" not in rows.columns and rows.columns.count("n_words") == 1 and rows.schema["failures"].dataType.simpleString() == "bigint"
    for policy in quality.POLICIES:
        kept = {r.doc_id for r in rows.where(quality.passes(policy)).collect()}
        assert kept == {r.doc_id for r in quality.apply_rules(docs, policy).collect()}
    assert {r._words for r in rows.collect()} == {"w"}
    # Every rule of the production policy can be the only one that a text fails.
    assert "symbol_heavy" not in {r.rule for r in quality.ablations(rows).collect()}
