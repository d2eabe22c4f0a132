import random
import re

import numpy as np

from chronoweave.llm import neardup as nd


def sets(text):
    w = re.findall("[^\x20\x09-\x0d]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    k = min(5, len(w))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set()


def brute(rows):
    s = [sets(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if s[i] and s[j] and 100 * len(s[i] & s[j]) >= 75 * len(s[i] | s[j]):
                parent[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            low[find(i)] = min(low.get(find(i), d), d)
    out = []
    for i, (d, _) in enumerate(rows):
        c = low.get(find(i)) if s[i] else d
        out.append((d, len(s[i]), c, d == c))
    return out


def corpus():
    rng = random.Random(11)
    vocab = [f"w{k}" for k in range(400)] + ["É", "Ab"]
    rows = [(900, None), (901, ""), (902, " \n"), (903, "one two"), (904, "One  TWO"), (905, "x"), (None, "one two"), (906, "a b c d e")]
    for base in range(12):
        words = rng.choices(vocab, k=rng.choice([30, 80, 300]))
        for _ in range(rng.choice([1, 3, 25])):
            copy = list(words)
            for _ in range(rng.randint(0, max(1, len(words) // 40))):
                copy[rng.randrange(len(copy))] = rng.choice(vocab)
            rows.append((rng.randint(0, 800), " ".join(copy)))
    rows += rows[-3:]
    rng.shuffle(rows)
    return rows


def test_against_brute_force(spark):
    rows = corpus()
    docs = spark.createDataFrame([(d, t, "z") for d, t in rows], "doc_id long, text string, kept string")
    got = [tuple(r)[:4] for r in nd.components(spark, docs).collect()]
    assert sorted(map(str, got)) == sorted(map(str, brute(rows)))


def test_large_buckets_of_unlinked_near_copies(spark, monkeypatch):
    monkeypatch.setattr(nd, "HOT_BUCKET", 3)
    rng = random.Random(4)
    base = [f"w{k}" for k in range(150)]
    rows = []
    for k in range(90):
        copy = list(base)
        for i in rng.sample(range(150), rng.randint(1, 9)):
            copy[i] = f"x{rng.randint(0, 999)}"
        rows.append((k, " ".join(copy)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [tuple(r)[:4] for r in nd.components(spark, docs).collect()]
    assert sorted(map(str, got)) == sorted(map(str, brute(rows)))


def test_exact_setting(spark, monkeypatch):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(nd, "ESTIMATE", 2.0)
    monkeypatch.setattr(nd, "HOT_BUCKET", 3)
    got = [tuple(r)[:4] for r in nd.components(spark, docs, exact=True).collect()]
    assert sorted(map(str, got)) == sorted(map(str, brute(rows)))


def test_long_texts_in_a_large_bucket_without_ansi(spark, monkeypatch):
    monkeypatch.setattr(nd, "HOT_BUCKET", 2)
    monkeypatch.setattr(nd, "EARLY", 3)
    rng = random.Random(6)
    base = [f"w{k}" for k in range(2500)]
    rows = []
    for k in range(14):
        copy = list(base)
        for i in rng.sample(range(2500), rng.randint(60, 150)):
            copy[i] = f"x{rng.randint(0, 9999)}"
        rows.append((k, " ".join(copy)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    held = spark.conf.get("spark.sql.ansi.enabled")
    spark.conf.set("spark.sql.ansi.enabled", "false")
    try:
        got = [tuple(r)[:4] for r in nd.components(spark, docs).collect()]
    finally:
        spark.conf.set("spark.sql.ansi.enabled", held)
    assert sorted(map(str, got)) == sorted(map(str, brute(rows)))


def test_ties_are_decided_by_all_columns(spark):
    rows = [(1, "a b c d e f", k, {"x": k}) for k in range(6)] + [(2, "q r s t u v", 0, None)]
    kept = set()
    for order in (rows, rows[::-1], rows[3:] + rows[:3]):
        docs = spark.createDataFrame(order, "doc_id long, text string, n int, m map<string,int>").repartition(3)
        kept.add(str(sorted((r.doc_id, r.n) for r in nd.deduplicate(spark, docs).collect())))
    assert len(kept) == 1
    named = spark.createDataFrame([("b", "a b c d e f"), ("a", "a b c d e f")], "doc_id string, text string")
    assert [r.doc_id for r in nd.deduplicate(spark, named).collect()] == ["a"]


def test_deduplicate_keeps_columns(spark):
    rows = [(1, "a b c d e f", 5), (2, "a b c d e f", 6), (2, "other words in a text", 7), (3, None, 8), (3, None, 9), (1, "a b c d e f", 5)]
    docs = spark.createDataFrame(rows, "doc_id int, text string, node int")
    out = nd.deduplicate(spark, docs)
    assert out.schema == docs.schema
    got = sorted((tuple(r) for r in out.collect()), key=str)
    assert got == sorted([(1, "a b c d e f", 5), (2, "other words in a text", 7), (3, None, 8), (3, None, 9)], key=str)
    assert nd.components(spark, docs.limit(0)).count() == 0 and nd.deduplicate(spark, docs.limit(0)).count() == 0


def test_estimate_is_unbiased(spark):
    rng = np.random.default_rng(0)
    rows = []
    for j in (0.3, 0.6, 0.75, 0.9):
        for _ in range(40):
            n = 400
            k = round(2 * n * j / (1 + j))
            x = rng.integers(0, 2**63, 2 * n - k, np.uint64)
            a, b = nd.pack(nd.minima(x[:n])), nd.pack(nd.minima(x[n - k :]))
            rows.append((j, [int(v) for v in a], [int(v) for v in b]))
    df = spark.createDataFrame(rows, "j double, p array<long>, q array<long>")
    from pyspark.sql import functions as F

    df = df.select("j", F.struct(*[F.col("p")[k].alias(s) for k, s in enumerate(nd.SIGNATURE)]).alias("x"), F.struct(*[F.col("q")[k].alias(s) for k, s in enumerate(nd.SIGNATURE)]).alias("y"))
    for r in df.groupBy("j").agg(F.avg(nd.estimate("x", "y")).alias("e")).collect():
        assert abs(r.e - r.j) < 0.03


def test_plans_stay_small_and_stop_at_empty_tables(spark, monkeypatch):
    """The driver's memory goes with the exchanges of a plan and the number of plans."""
    plans = []
    for name in ("materialize", "materialize_counting"):
        plain = getattr(nd, name, None)

        def written(session, df, what, *more, plain=plain):
            plan = df._jdf.queryExecution().executedPlan().toString()
            plans.append((what, len(re.findall(r"(?<!Reused)Exchange ", plan))))
            return plain(session, df, what, *more)

        monkeypatch.setattr(nd, name, written, raising=False)
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [tuple(r)[:4] for r in nd.components(spark, docs).collect()]
    assert sorted(map(str, got)) == sorted(map(str, brute(rows)))
    assert max(n for _, n in plans) <= 15
    # Two copies of a base and two of another: after the first turn no bucket holds several components.
    plans.clear()
    base = [" ".join(f"{c}{k}" for k in range(60)) for c in "ab"]
    rows = [(k, base[k // 2] + " end" * (k % 2)) for k in range(4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [tuple(r)[:4] for r in nd.components(spark, docs).collect()]
    assert sorted(map(str, got)) == sorted(map(str, brute(rows)))
    assert [w for w, _ in plans].count("tested") == 1
