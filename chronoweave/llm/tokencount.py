"""Token counts by a compiled finite-state transducer.

The tokenizer file is compiled into a deterministic transducer over characters whose arcs carry the number of
tokens that they emit. It does what the pre-tokeniser and the merges do together:

* Merges. A sequence of tokens is what the merges make of a word exactly if each two neighbours are what the
  merges make of the two together. So a word's bytes are spelled along a trie of the tokens, and a machine
  state is the set of ways to be on it: (place in the trie, token before, tokens so far). Ways that end a
  token which its predecessor does not tolerate die, and a way forgets its token before once every token that it
  can still become is tolerated, so that states merge. The number that all ways share is emitted on the arc, so
  the sets are finite. A word's last byte is a symbol of its own (the file's end-of-word suffix), which is
  why the machine holds one byte back until it knows whether the word goes on.
* Pre-tokeniser. Its literals (contractions, special strings) are states of their own where a match may begin;
  a literal that fails is taken again as characters. Runs of letters or of other characters go on in one
  state; a digit is a word; white space ends a word.

States are subsets, so the machine is determinised while it is used: an arc is compiled when a text first takes
it and is one table look-up from then on. Of ``MAX_ARCS`` compiled arcs a worker forgets all and goes on; no count
depends on that. Texts are read ``GROUP_CHARS`` at a time, so what a worker holds depends neither on the batches that
it is handed nor on their words. No ids are made to count a text. Characters have the classes that the file's own pre-tokeniser
gives them, and texts beyond ASCII pass the file's own normaliser before they reach the machine.

A chunk of a text is a map from the state it is entered in to the state it is left in and the tokens it emits.
White space sends every state to the first one, so the map of a chunk with white space is the same for all
entry states but for what is before the first: (characters up to there, tokens after it, exit state). Maps
compose associatively. Texts of over ``chunk_chars`` are cut into chunks whose maps are made in parallel; a prefix
scan over a text's chunks finds for each the state it is entered in (that of the last chunk before it with
white space, and the characters since), and the characters before its first white space are run from there.

Cases: a null text counts as empty with 0 tokens; the special strings count as one token each, as the
library has it; repeated rows each give a row; a null doc_id is carried through, and ids of any type keep it;
an empty table gives no rows; columns other than the id and the text are not read.
"""

from __future__ import annotations

import json
import os
import pickle
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import batch, id_types

CHUNK_CHARS = 32_768
MAX_ARCS = 400_000
#: A trie node with more tokens below keeps the token before it in the state.
FEW_BELOW = 64
#: A lane's characters, the steps that are fetched at a time, and how few lanes are read one by one.
LANE, BLOCK, FEW = 256, 32, 16
#: Characters of the texts that are read in step; a longer text is a group of its own.
GROUP_CHARS = 1 << 21
#: Stands for a special token. Normalised texts are lower case, so none has it.
SPECIAL = "A"
#: Added to a plain byte, the symbol of a byte that ends a word.
FINAL = 256
_RESET = regex.compile(r"[ A\t\n\r]")


def byte_alphabet() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: bytes that show as characters
    stand for themselves, the others have the characters from 256 on, in order."""
    shown = [b for b in range(256) if b != 32 and chr(b).isprintable()]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class Merges:
    """The tokens as symbols, the trie of them, and the merges."""

    def __init__(self, model: dict, added: set[str]):
        if model["type"] != "BPE" or model.get("dropout") or model.get("continuing_subword_prefix") or not model.get("end_of_word_suffix"):
            raise ValueError("only byte-level merges with an end-of-word suffix can be compiled")
        suffix, alphabet = model["end_of_word_suffix"], byte_alphabet()
        number: dict[str, int] = {}
        self.symbols: list[tuple[int, ...]] = []

        def token(text: str) -> int:
            if text not in number:
                body = text.removesuffix(suffix)
                spelled = [alphabet[c] for c in body]
                if body != text:
                    spelled[-1] += FINAL
                number[text] = len(number)
                self.symbols.append(tuple(spelled))
            return number[text]

        for c in alphabet:
            for text in (c, c + suffix):
                if text not in model["vocab"]:
                    raise ValueError(f"the vocabulary lacks {text!r}")
                token(text)
        self.ranks: dict[tuple[int, int], tuple[int, int]] = {}
        #: The two tokens that a merge makes a token of, and the merge's rank; tokens of one byte have none.
        self.made: dict[int, tuple[int, int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = map(token, pair.split(" ") if isinstance(pair, str) else pair)
            if any(x in self.made and self.made[x][2] >= rank for x in (a, b)):
                raise ValueError("a merge takes a token that only a later one makes")
            made = token("".join(pair.split(" ") if isinstance(pair, str) else pair))
            self.ranks[a, b] = (rank, made)
            if made in self.made:
                raise ValueError("two merges make the same token")
            self.made[made] = (a, b, rank)
        self.children: list[dict[int, int]] = [{}]
        self.ends: list[int] = [-1]
        for t, spelled in enumerate(self.symbols):
            node = 0
            for s in spelled:
                if s not in self.children[node]:
                    self.children[node][s] = len(self.children)
                    self.children.append({})
                    self.ends.append(-1)
                node = self.children[node][s]
            self.ends[node] = t
        #: The tokens further down from each node of the trie, where they are few.
        self.below: list[list[int] | None] = [[] for _ in self.ends]
        for node in range(len(self.ends) - 1, -1, -1):
            found: list[int] | None = []
            for child in self.children[node].values():
                more = self.below[child]
                found = None if found is None or more is None else found + more + ([self.ends[child]] if self.ends[child] >= 0 else [])
                if found is None or len(found) > FEW_BELOW:
                    found = None
                    break
            self.below[node] = found
        self.edges: tuple[dict, dict] = ({}, {})
        self.settled: dict[tuple[int, int], int | None] = {}

    def settle(self, node: int, before: int) -> int | None:
        """What the way (node, before) still has to know: nothing (-1) where every token further down may stand
        after ``before``, the token itself where some may, and None where the way is dead."""
        if before < 0 or self.below[node] is None:
            return before
        found = self.settled.get((node, before), before)
        if (node, before) not in self.settled:
            fits = [self.tolerates(before, t) for t in self.below[node]]
            found = self.settled[node, before] = -1 if all(fits) else before if any(fits) else None
        return found

    def forget(self) -> None:
        """Drop what is worked out again when it is asked for."""
        self.settled.clear()
        for side in self.edges:
            side.clear()

    def edge(self, t: int, side: int) -> list[tuple[int, int]]:
        """The tokens that stand at a token's end (side 1) or start (side 0) while it is made, last first, and
        the rank of the merge that takes each up."""
        found = self.edges[side].get(t)
        if found is None:
            found, until, part = [], len(self.ranks), t
            while True:
                found.append((part, until))
                if part not in self.made:
                    break
                until = self.made[part][2]
                part = self.made[part][side]
            self.edges[side][t] = found
        return found

    def tolerates(self, a: int, b: int) -> bool:
        """The merges leave these two tokens side by side: no merge across their border comes before one of
        the two merges that take its parts up on either side. Among equal ranks the leftmost comes first."""
        ranks, left = self.ranks, self.edge(a, 1)
        for y, above in self.edge(b, 0):
            for x, below in left:
                rank = ranks.get((x, y))
                if rank is not None and rank[0] < below and rank[0] <= above:
                    return False
        return True

    def advance(self, ways: tuple, symbol: int) -> tuple[tuple, int]:
        """The ways after one more symbol, deepest first, and the tokens that all of them have more."""
        out, whole, children = [], [], self.children
        for node, before, n in ways:
            at = children[node].get(symbol)
            if at is None:
                continue
            if children[at] and (needs := self.settle(at, before)) is not None:
                out.append((at, needs, n))
            t = self.ends[at]
            if t >= 0 and (before < 0 or self.tolerates(before, t)):
                whole.append((0, t, n + 1))
        if len(whole) != 1:
            raise ValueError("the merges do not split a word in exactly one way")
        out += whole
        low = min(n for _, _, n in out)
        return tuple([(node, before, n - low) for node, before, n in out] if low else out), low

    def finish(self, ways: tuple, byte: int) -> int:
        """The tokens still to come when this byte ends the word."""
        ways, n = self.advance(ways, byte + FINAL)
        return n + next(k for node, _, k in ways if node == 0)


#: Before a word's first symbol: at the root, after no token.
BEGIN = ((0, -1, 0),)


class State(dict):
    """Character -> (next state, tokens emitted); missing arcs are compiled.

    ``key`` is (kind, text, held byte, ways): kind is "" between words, "L" or "P" in a run of letters or of
    other characters, "=" while a literal that may be complete soon is read, which ``text`` is."""

    __slots__ = ("machine", "key", "number")

    def __init__(self, machine: Transducer, key: tuple, number: int):
        super().__init__()
        self.machine, self.key, self.number = machine, key, number

    def __missing__(self, char: str) -> tuple[State, int]:
        arc = self.machine.arc(self, char)
        self[char] = arc
        return arc


class Arcs:
    """The compiled arcs as an open-addressing table of (state, character), for many texts in step.

    A cell is a key, or -1, and the next state's number above the number of tokens emitted."""

    def __init__(self):
        self.clear(1 << 16)

    def clear(self, size: int) -> None:
        self.shift, self.used = np.uint64(65 - size.bit_length()), 0
        self.keys, self.targets = np.full(size, -1, np.int64), np.zeros(size, np.int64)

    def slots(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where each key is, or the empty slot where it would be, and what stands there."""
        at = ((keys.view(np.uint64) * _MULTIPLIER) >> self.shift).view(np.int64)
        there = self.keys.take(at)
        off = np.flatnonzero(there != keys)
        while len(off := off[there[off] >= 0]):
            at[off] = (at[off] + 1) & (len(self.keys) - 1)
            there[off] = self.keys.take(at[off])
            off = off[there[off] != keys[off]]
        return at, there

    def put(self, keys: np.ndarray, targets: np.ndarray) -> None:
        """Add different keys that are not there."""
        if 3 * (self.used + len(keys)) >= len(self.keys):
            held = self.keys >= 0
            keys, targets = np.concatenate([self.keys[held], keys]), np.concatenate([self.targets[held], targets])
            self.clear(1 << int(4 * len(keys)).bit_length())
        self.used += len(keys)
        while len(keys):
            at, _ = self.slots(keys)
            # Several keys may want one empty slot: the first gets it.
            _, mine = np.unique(at, return_index=True)
            self.keys[at[mine]], self.targets[at[mine]] = keys[mine], targets[mine]
            left = np.ones(len(keys), bool)
            left[mine] = False
            keys, targets = keys[left], targets[left]


_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


class Transducer:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        # The vocabulary is in the machine: the library is asked for classes and normal forms only.
        self.library = Tokenizer.from_str(json.dumps(spec | {"added_tokens": [], "model": {"type": "BPE", "vocab": {}, "merges": []}}))
        split, byte_level = spec["pre_tokenizer"]["pretokenizers"]
        kinds = [n["type"] for n in spec["normalizer"]["normalizers"]]
        if kinds != ["NFC", "Replace", "Lowercase"] or split["type"] != "Split" or not split["invert"] or byte_level["use_regex"] or byte_level["add_prefix_space"]:
            raise ValueError("only NFC, white space, lower case and an inverted split can be compiled")
        parts = regex.split(r"(?<!\\)\|", split["pattern"]["Regex"])
        classes = [r"[\p{L}]+", r"[\p{N}]", r"[^\s\p{L}\p{N}]+"]
        if parts[-3:] != classes:
            raise ValueError("only runs of letters, single digits and runs of other characters can be compiled")
        self.literals = {regex.sub(r"\\(.)", r"\1", p) for p in parts[:-3]}
        self.openings = {p[:k] for p in self.literals for k in range(1, len(p))}
        added = spec["added_tokens"]
        if any(t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] for t in added):
            raise ValueError("only added tokens that stand for their plain strings can be compiled")
        special = sorted((t["content"] for t in added), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None
        self.merges = Merges(spec["model"], set(special))
        self.kinds: dict[str, str] = {}
        self.states: dict[tuple, State] = {}
        #: Sets of ways and ways, each held once: states share them.
        self.shared: dict[tuple, tuple] = {}
        self.numbered: list[State] = []
        self.compiled = 0
        self.arcs = Arcs()
        self.start = self.state(("", "", -1, BEGIN))

    def kind(self, char: str) -> str:
        """The class that the file's pre-tokeniser gives a character: L, N, P, or " "."""
        found = self.kinds.get(char)
        if found is None:
            spans = lambda text: [span for _, span in self.library.pre_tokenizer.pre_tokenize_str(text)]
            if spans(f"a{char}a") == [(0, 3)]:
                found = "L"
            elif spans(f"!{char}!") == [(0, 3)]:
                found = "P"
            else:
                found = "N" if (1, 2) in spans(f"a{char}a") else " "
            self.kinds[char] = found
        return found

    def state(self, key: tuple) -> State:
        found = self.states.get(key)
        if found is None:
            *rest, ways = key
            if ways not in self.shared:
                ways = tuple(self.shared.setdefault(w, w) for w in ways)
            key = (*rest, self.shared.setdefault(ways, ways))
            found = self.states[key] = State(self, key, len(self.numbered))
            self.numbered.append(found)
        return found

    def word(self, text: str) -> int:
        """The tokens of a whole word."""
        *body, last = text.encode("utf-8", "replace")
        ways, total = BEGIN, 0
        for b in body:
            ways, n = self.merges.advance(ways, b)
            total += n
        return total + self.merges.finish(ways, last)

    def feed(self, key: tuple, char: str) -> tuple[tuple, int]:
        """One more character of a word."""
        kind, _, held, ways = key
        total = 0
        for b in char.encode("utf-8", "replace"):
            if held >= 0:
                ways, n = self.merges.advance(ways, held)
                total += n
            held = b
        return (kind, "", held, ways), total

    def arc(self, state: State, char: str) -> tuple[State, int]:
        self.compiled += 1
        kind, text, held, ways = state.key
        if kind == "=":
            if text + char in self.literals:
                return self.start, self.word(text + char)
            if text + char in self.openings:
                return self.state(("=", text + char, -1, BEGIN)), 0
            # No literal after all: its first character begins a word by its class, the others follow.
            at, total = self.begin(text[0], literal=False)
            for c in text[1:] + char:
                at, n = at[c]
                total += n
            return at, total
        if char == SPECIAL:
            return self.start, 1 + (self.merges.finish(ways, held) if kind else 0)
        found = self.kind(char)
        if found == kind:
            key, n = self.feed(state.key, char)
            return self.state(key), n
        closed = self.merges.finish(ways, held) if kind else 0
        if found == " ":
            return self.start, closed
        at, n = self.begin(char)
        return at, closed + n

    def begin(self, char: str, literal: bool = True) -> tuple[State, int]:
        """Where a match begins."""
        if literal and char in self.openings:
            return self.state(("=", char, -1, BEGIN)), 0
        kind = self.kind(char)
        if kind == "N":
            return self.start, self.word(char)
        key, n = self.feed((kind, "", -1, BEGIN), char)
        return self.state(key), n

    def forget(self) -> None:
        """Start again with the first state alone."""
        for s in self.numbered:
            s.clear()
        self.states, self.numbered = {self.start.key: self.start}, [self.start]
        self.arcs.clear(1 << 16)
        self.shared.clear()
        self.merges.forget()
        self.compiled = 0

    def normal(self, text: str) -> str:
        """The characters that the machine reads for a whole text; the space at the end ends its last word."""
        parts = self.special.split(text) if self.special else [text]
        return SPECIAL.join(p.lower() if p.isascii() else self.library.normalizer.normalize_str(p) for p in parts) + " "

    def run(self, state: State, text: str) -> tuple[State, int]:
        total = 0
        for char in text:
            state, n = state[char]
            total += n
        return state, total

    def counts(self, texts: list[str]) -> list[int]:
        """The tokens of whole texts."""
        return [n for group in grouped(texts) for n in self.in_step([self.normal(t) for t in group])[0]]

    def in_step(self, made: list[str]) -> tuple[list[int], list[int]]:
        """The tokens of normalised texts from the first state on, and the numbers of the states they are left in.

        The machine reads all texts in step. A text is a lane, or several that are cut where white space resets the
        machine; a step takes one character of every lane. What few lanes have left is read lane by lane."""
        if self.compiled > MAX_ARCS:
            self.forget()
        line = "".join(made)
        codes = np.frombuffer(line.encode("utf-32-le"), np.uint32)
        ends = np.cumsum([0, *map(len, made)])
        resets = np.append(np.flatnonzero((codes == 32) | (codes == ord(SPECIAL))) + 1, len(codes))
        cuts = resets[np.searchsorted(resets, np.arange(LANE, len(codes), LANE))]
        placed = np.unique(np.concatenate([ends[:-1], cuts]))
        placed = placed[placed < len(codes)]
        size = np.diff(np.append(placed, len(codes)))
        order = np.argsort(-size, kind="stable")
        first, size = placed[order], size[order]
        state, total = np.zeros(len(first), np.int64), np.zeros(len(first), np.int64)
        step, live = 0, len(first)
        while live >= FEW:
            ahead = codes.take(first[:live, None] + np.arange(step, step + BLOCK), mode="clip").T.astype(np.int64, order="C")
            for k in range(min(BLOCK, int(size[0]) - step)):
                live = int(np.searchsorted(-size, -step, "left"))
                if live < FEW:
                    break
                keys = state[:live] << 21 | ahead[k, :live]
                slots, there = self.arcs.slots(keys)
                if there.min() < 0:
                    new = np.unique(keys[there < 0])
                    arcs = [self.arc(self.numbered[key >> 21], chr(key & 0x1FFFFF)) for key in new.tolist()]
                    self.arcs.put(new, np.array([t.number << 24 | n for t, n in arcs], np.int64))
                    slots, _ = self.arcs.slots(keys)
                found = self.arcs.targets.take(slots)
                state[:live] = found >> 24
                total[:live] += found & 0xFFFFFF
                step += 1
            live = int(np.searchsorted(-size, -step, "left"))
        for lane in range(live):
            begin, end = int(first[lane]), int(first[lane] + size[lane])
            left, n = self.run(self.numbered[state[lane]], line[begin + step : end])
            state[lane], total[lane] = left.number, total[lane] + n
        counts = np.bincount(np.searchsorted(ends, first, "right") - 1, total, len(made)).astype(np.int64).tolist()
        in_place = np.zeros(len(placed) + 1, np.int64)
        in_place[order] = state
        # A text is left in the state of its last lane; an empty one has none.
        last = np.where(np.diff(ends) > 0, np.searchsorted(placed, ends[1:]) - 1, len(placed))
        return counts, in_place[last].tolist()

    def chunk_maps(self, texts: list[str]) -> list[tuple[str, int | None, bytes | None]]:
        """Of chunks of normalised texts: the characters up to the first reset, the tokens from there on, and the
        exit state. Without a reset all characters come first, and there is neither count nor state."""
        out: list[tuple[str, int | None, bytes | None]] = []
        for group in grouped(texts):
            heads = [first.end() if (first := _RESET.search(t)) else None for t in group]
            counts, exits = map(iter, self.in_step([t[h:] for t, h in zip(group, heads) if h is not None]))
            for t, h in zip(group, heads):
                out.append((t, None, None) if h is None else (t[:h], next(counts), pickle.dumps(self.numbered[next(exits)].key)))
        return out

    def chunk_map(self, text: str) -> tuple[str, int | None, bytes | None]:
        return self.chunk_maps([text])[0]

    def resume(self, entry: bytes | None, text: str) -> int:
        """The tokens of some characters from an entry state on."""
        return self.run(self.state(pickle.loads(entry)) if entry else self.start, text)[1]


def grouped(texts: list[str]) -> Iterator[list[str]]:
    """The texts in groups of at most GROUP_CHARS, or of one text."""
    begin = size = 0
    for k, text in enumerate(texts):
        if k > begin and size + len(text) > GROUP_CHARS:
            yield texts[begin:k]
            begin, size = k, 0
        size += len(text)
    if begin < len(texts):
        yield texts[begin:]


@lru_cache(maxsize=2)
def transducer(path: str) -> Transducer:
    return Transducer(path)


def count_tokens(docs: DataFrame, path: str, limit: int = 2048, chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit."""
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    arrow_id, sql_id = id_types(docs)
    out = pa.schema([("doc_id", arrow_id), ("n_bytes", pa.int64()), ("n_tokens", pa.int64())])

    def whole(batches):
        machine = transducer(path)
        for b in batches:
            counts = machine.counts(b.column("text").to_pylist())
            yield batch(out, doc_id=b.column("doc_id"), n_bytes=b.column("n_bytes"), n_tokens=counts)

    short = docs.where(F.length("text") <= chunk_chars).withColumn("n_bytes", F.octet_length("text").cast("long"))
    short = short.mapInArrow(whole, f"doc_id {sql_id}, n_bytes long, n_tokens long")

    keys = ["doc_id", "digest", "n_bytes", "copies"]
    long = docs.where(F.length("text") > chunk_chars).groupBy("doc_id", "text").agg(F.count("*").alias("copies"))
    long = long.select("doc_id", F.sha2("text", 256).alias("digest"), F.octet_length("text").cast("long").alias("n_bytes"), "copies", "text")
    ddl = f"doc_id {sql_id}, digest string, n_bytes long, copies long"
    own = [("doc_id", arrow_id), ("digest", pa.string()), ("n_bytes", pa.int64()), ("copies", pa.int64())]
    cut = pa.schema([*own, ("chunk", pa.int64()), ("text", pa.string())])

    def chunks(batches):
        machine = transducer(path)
        for b in batches:
            for *key, text in zip(*(b.column(c).to_pylist() for c in [*keys, "text"])):
                text = machine.normal(text)
                starts = range(0, len(text), chunk_chars)
                yield batch(cut, **{k: [v] * len(starts) for k, v in zip(keys, key)}, chunk=range(len(starts)), text=[text[s : s + chunk_chars] for s in starts])

    rows = long.mapInArrow(chunks, f"{ddl}, chunk long, text string").repartition("doc_id", "digest", "chunk")
    mapped = pa.schema([*own, ("chunk", pa.int64()), ("head", pa.string()), ("count", pa.int64()), ("exit", pa.binary())])

    def maps(batches):
        machine = transducer(path)
        for b in batches:
            head, count, exit_state = zip(*machine.chunk_maps(b.column("text").to_pylist())) if b.num_rows else ((), (), ())
            yield batch(mapped, **{c: b.column(c) for c in [*keys, "chunk"]}, head=head, count=count, exit=exit_state)

    rows = rows.mapInArrow(maps, f"{ddl}, chunk long, head string, count long, exit binary")
    # The scan: the number of resets before a chunk names the path that its head goes on with; the path's entry
    # state is the exit state of the chunk with that reset.
    before = Window.partitionBy(*keys).orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("path", F.coalesce(F.count("count").over(before), F.lit(0)))
    parts = rows.select(*keys, "chunk", F.inline(F.array(
        F.struct(F.col("path"), F.col("head").alias("text"), F.lit(None).cast("binary").alias("entry"), F.coalesce("count", F.lit(0)).alias("count")),
        F.struct((F.col("path") + 1).alias("path"), F.lit("").alias("text"), F.col("exit").alias("entry"), F.lit(0).cast("long").alias("count")),
    )))
    parts = parts.groupBy(*keys, "path").agg(
        F.expr("listagg(text, '') within group (order by chunk)").alias("text"), F.max("entry").alias("entry"), F.sum("count").alias("count"))
    joined = pa.schema([*own, ("n", pa.int64())])

    def paths(batches):
        machine = transducer(path)
        for b in batches:
            counts = [n + machine.resume(e, t or "") for n, e, t in zip(*(b.column(c).to_pylist() for c in ("count", "entry", "text")))]
            yield batch(joined, **{c: b.column(c) for c in keys}, n=counts)

    total = parts.mapInArrow(paths, f"{ddl}, n long").groupBy(*keys).agg(F.sum("n").alias("n_tokens"))
    total = total.withColumn("copy", F.explode(F.expr("sequence(1L, copies)"))).select("doc_id", "n_bytes", "n_tokens")
    return short.unionByName(total).withColumn("over_limit", F.col("n_tokens") > limit)


def op6_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as P

    from .common import table

    return count_tokens(table(spark, sf_dir, "documents"), P.path("word_bpe_49k.json"))
