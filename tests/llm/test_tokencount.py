import random

import public_tokenizers as P
from tokenizers import Tokenizer

from chronoweave.llm import tokencount as tc

PATH = P.path("word_bpe_49k.json")


def texts():
    rng = random.Random(7)
    parts = ["the ", "It's ", "WE'LL", "'re", "'r x", "''s", "!'s", "\n\n", "\x0b\x1c", "　", "123", "½²", "éÀ", "é", "ΣΑΣ ", "İI", "J̌", "日本語", "...", "᠎", "​",
             "<|endoftext|>", "<|startoftext|", "<|", "😀", "ǅ", "ͅ", "ß", "x", "�", "\U0001e900"]
    out = [None, "", " ", "'", "a" * 500, "ab " * 300, "<|endoftext|>" * 40, "!" * 300]
    return out + ["".join(rng.choices(parts, k=rng.randint(1, 150))) for _ in range(150)]


def test_counts_equal_the_library(spark):
    tok = Tokenizer.from_file(PATH)
    rows = [(k, t, 1) for k, t in enumerate(texts())] + [(None, "null id", 1), (5, "ab " * 300, 1)]
    docs = spark.createDataFrame(rows, "doc_id int, text string, n_tokens int")
    want = []
    for i, t, _ in rows:
        n = len(tok.encode(t or "", add_special_tokens=False).ids)
        want.append(str((i, len((t or "").encode()), n, n > 100)))
    for size in (37, 200, 100_000):
        got = tc.count_tokens(docs, PATH, 100, size).collect()
        assert sorted(str(tuple(r)) for r in got) == sorted(want)
    assert tc.count_tokens(docs.limit(0), PATH).count() == 0


def test_full_table_is_compiled_anew(monkeypatch):
    monkeypatch.setattr(tc, "MAX_ARCS", 5)
    tok = Tokenizer.from_file(PATH)
    machine = tc.Transducer(PATH)
    many = [f"word{k} another{k} thing" for k in range(300)]
    want = [len(tok.encode(t, add_special_tokens=False).ids) for t in many]
    assert sum((machine.counts(many[k : k + 40]) for k in range(0, 300, 40)), []) == want
    assert [machine.run(machine.start, machine.normal(t))[1] for t in many] == want


def test_a_batch_is_read_in_bounded_groups(monkeypatch):
    tok, rng = Tokenizer.from_file(PATH), random.Random(5)
    machine = tc.Transducer(PATH)
    many = ["", "x" * 700, *("".join(rng.choices("abcdefg ", k=rng.randint(0, 120))) for _ in range(200)), "", "9" * 40]
    monkeypatch.setattr(tc, "GROUP_CHARS", 500, raising=False)
    monkeypatch.setattr(tc, "MAX_ARCS", 300)
    held, forget = [], machine.forget
    monkeypatch.setattr(machine, "forget", lambda: (held.append(machine.compiled), forget()))
    # One batch: the table of arcs is given up within it, whenever it is full.
    assert machine.counts(many) == [len(tok.encode(t, add_special_tokens=False).ids) for t in many]
    assert len(held) > 3 and max(held) < 1_500
    groups = list(tc.grouped(many))
    assert sum(groups, []) == many and all(len(g) == 1 or sum(map(len, g)) <= 500 for g in groups)


def test_chunk_maps_in_step_equal_one_by_one():
    machine = tc.transducer(PATH)
    lines = [machine.normal(t) for t in texts()[1:]] + ["", "x", " ", "a b", "two words"]
    lines = [x for t in lines for x in (t, t[: len(t) // 2])]
    for line, (head, n, left) in zip(lines, machine.chunk_maps(lines)):
        first = tc._RESET.search(line)
        assert head == (line[: first.end()] if first else line)
        if first is None:
            assert n is None and left is None
        else:
            state, count = machine.run(machine.start, line[first.end() :])
            assert (n, tc.pickle.loads(left)) == (count, state.key)


def test_neighbours_that_the_merges_leave_alone():
    merges = tc.transducer(PATH).merges
    rng = random.Random(3)

    def merged(symbols):
        word = [merges.symbols.index((s,)) for s in symbols]
        while pairs := [(merges.ranks[p], k) for k, p in enumerate(zip(word, word[1:])) if p in merges.ranks]:
            (_, made), k = min(pairs, key=lambda x: (x[0][0], x[1]))
            word[k : k + 2] = [made]
        return word

    plain = [t for t, s in enumerate(merges.symbols) if s[-1] < tc.FINAL]
    for few in (len(plain), 600):
        for _ in range(1500):
            a, b = rng.choice(plain[:few]), rng.randrange(few)
            assert merges.tolerates(a, b) == (merged(merges.symbols[a] + merges.symbols[b]) == [a, b])


def test_states_compose_over_any_cut():
    machine = tc.transducer(PATH)
    rng = random.Random(6)
    for text in texts()[1:60]:
        line = machine.normal(text)
        want = machine.run(machine.start, line)[1]
        cut = sorted(rng.randint(0, len(line)) for _ in range(3))
        state, total = machine.start, 0
        for a, b in zip([0, *cut], [*cut, len(line)]):
            state, n = machine.run(state, line[a:b])
            total += n
        assert total == want and state is machine.start
        head, n, exit_state = machine.chunk_map(line[: cut[1]])
        if exit_state is not None:
            assert machine.resume(None, head) + n + machine.resume(exit_state, line[cut[1] :]) == want


def test_query_equals_the_library(spark, sf):
    tok = Tokenizer.from_file(PATH)
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    got = sorted(tuple(r) for r in tc.op6_tokens(spark, sf).collect())
    want = [(r.doc_id, len((r.text or "").encode()), len(tok.encode(r.text or "", add_special_tokens=False).ids)) for r in docs]
    assert got == sorted((i, b, n, n > 2048) for i, b, n in want)
