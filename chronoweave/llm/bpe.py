"""Byte-level BPE encoding and decoding by overlapping chunks.

A text of more than ``chunk_chars`` is cut into chunks that overlap by ``overlap`` characters.
Every chunk is pre-tokenised on its own, as a row that any task may take. In the overlap of two
neighbours, a position where both see a pre-token boundary is where they resynchronise: the
pattern looks at nothing before a match, so from there on both see the same pre-tokens. The text
is cut at such positions into pieces, the pieces are encoded in parallel, and their ids and bytes
are concatenated in order. Where an overlap has no common boundary (a run of one kind of character
that is longer than the overlap), its chunks form one piece. A text of one chunk is one piece.
Pre-tokens are always tiktoken's: characters that its tables class otherwise than ours do are replaced by
a character of tiktoken's class before they are split here. So ``chunk_chars``, ``overlap`` and
``LONG_SPACE`` say how the work is dealt, and no id depends on them.

Cases: a null text counts as empty; empty texts have 0 ids and the digest of no bytes; repeated
rows each give a row; a null doc_id is carried through, and ids of any type keep it; an empty table
gives no rows; columns other than the id and the text are not read.
"""

from __future__ import annotations

import base64
import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import batch, id_types

CHUNK_CHARS = 32_768
OVERLAP = 1_024
#: The longest look beyond a match's start that decides among the pattern's fixed alternatives.
LOOKAHEAD = 4
#: A longer run of white space goes past the library, whose expressions overflow their stack on about a million.
LONG_SPACE = 10_000
_SPACES = regex.compile(rf"\s{{{LONG_SPACE}}}")


@lru_cache(maxsize=4)
def encoding(path: str, pattern: str) -> tiktoken.Encoding:
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=4)
def compiled(pattern: str) -> regex.Pattern:
    if used := set(_CLASSES.findall(pattern)) - {r"\p{L}", r"\p{N}", r"\s", r"\S"}:
        raise ValueError(f"no stand-ins for the character classes {sorted(used)}")
    return regex.compile(pattern)


_CLASSES = regex.compile(r"\\[pP]\{\^?\w+\}|\\[dDwWsShHvVXR]")
_STAND_INS = ((r"\p{L}", "x"), (r"\p{N}", "0"), (r"\s", "\u00a0"))


@lru_cache(maxsize=1)
def stand_ins() -> dict[int, str]:
    """A character of the same class for each one that tiktoken's tables class otherwise than ours do.

    The two libraries follow different versions of Unicode. An encoding whose pattern is one class and whose
    tokens are single bytes gives back the characters of that class, so tiktoken itself is asked."""
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    single = {bytes([b]): b for b in range(256)}
    theirs, ours = {}, {}
    for name, standing in _STAND_INS:
        probe = tiktoken.Encoding("class", pat_str=name, mergeable_ranks=single, special_tokens={})
        theirs |= dict.fromkeys(bytes(probe.encode_ordinary(every)).decode(), standing)
        ours |= dict.fromkeys(regex.findall(name, every), standing)
    return {ord(c): theirs.get(c, "$") for c in theirs.keys() | ours.keys() if theirs.get(c) != ours.get(c)}


def classed(text: str) -> str:
    """A text of the same length that our expressions split as tiktoken splits this one."""
    if text.isascii() or stand_ins().keys().isdisjoint(map(ord, set(text))):
        return text
    return text.translate(stand_ins())


def encode_piece(text: str, path: str, pattern: str) -> list[int]:
    """The library's ids. A run of white space that is too long for its stack is split here instead, into
    the same pre-tokens, each of which the library encodes."""
    enc = encoding(path, pattern)
    if len(text) <= LONG_SPACE or _SPACES.search(text) is None:
        return enc.encode_ordinary(text)
    ids: list[int] = []
    for m in compiled(pattern).finditer(classed(text)):
        ids += enc._core_bpe.encode_single_piece(text[m.start() : m.end()].encode("utf-8", "replace"))
    return ids


def boundaries(text: str, pattern: str, first: bool, last: bool, overlap: int) -> tuple[list[int], list[int]]:
    """Ends of pre-tokens in the overlaps at a chunk's start and end, as offsets in the chunk.

    Only ends after a character that is no white space count: a piece that ends there has the
    pre-tokens of the whole text. Ends near the chunk's own end are left out, as the text beyond
    could change them.
    """
    head: list[int] = []
    tail: list[int] = []
    n = len(text)
    text = classed(text)
    for m in compiled(pattern).finditer(text):
        e = m.end()
        if e > n - LOOKAHEAD:
            break
        if text[e - 1].isspace():
            continue
        if e <= overlap and not first:
            head.append(e)
        if e >= n - overlap and not last:
            tail.append(e)
    return head, tail


def encode_documents(
    docs: DataFrame,
    ranks_path: str,
    pattern: str,
    chunk_chars: int = CHUNK_CHARS,
    overlap: int = OVERLAP,
    with_ids: bool = False,
) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256; with_ids adds the packed ids and decoded bytes."""
    if not LOOKAHEAD < overlap < chunk_chars // 2:
        raise ValueError("the overlap must be over the lookahead and under half a chunk")
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    arrow_id, sql_id = id_types(docs)
    extra = [("ids", pa.binary()), ("decoded", pa.binary())]
    one = pa.schema(
        [("doc_id", arrow_id), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]
        + extra * with_ids
    )

    def whole(batches):
        enc = encoding(ranks_path, pattern)
        for b in batches:
            rows = {f.name: [] for f in one}
            for text in b.column("text").to_pylist():
                ids = encode_piece(text, ranks_path, pattern)
                packed = np.array(ids, "<u4").tobytes()
                decoded = enc.decode_bytes(ids)
                rows["n_tokens"].append(len(ids))
                rows["ids_sha256"].append(hashlib.sha256(packed).hexdigest())
                rows["decoded_sha256"].append(hashlib.sha256(decoded).hexdigest())
                if with_ids:
                    rows["ids"].append(packed)
                    rows["decoded"].append(decoded)
            rows["doc_id"] = b.column("doc_id")
            yield batch(one, **rows)

    ddl = f"doc_id {sql_id}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary, decoded binary" * with_ids
    short = docs.where(F.length("text") <= chunk_chars).mapInArrow(whole, ddl)

    # Equal long rows are worked on once; their number is in `copies`.
    long = docs.where(F.length("text") > chunk_chars).groupBy("doc_id", "text").agg(F.count("*").alias("copies"))
    long = long.withColumn("digest", F.sha2("text", 256))
    cut = pa.schema([("doc_id", arrow_id), ("digest", pa.string()), ("copies", pa.int64()), ("chunk", pa.int64()), ("start", pa.int64()), ("last", pa.bool_()), ("text", pa.string())])

    def chunks(batches):
        step = chunk_chars - overlap
        for b in batches:
            for doc_id, digest, copies, text in zip(*(b.column(c).to_pylist() for c in ("doc_id", "digest", "copies", "text"))):
                starts = list(range(0, max(1, len(text) - overlap), step))
                yield batch(
                    cut,
                    doc_id=[doc_id] * len(starts), digest=[digest] * len(starts), copies=[copies] * len(starts),
                    chunk=range(len(starts)), start=starts, last=[i + 1 == len(starts) for i in range(len(starts))],
                    text=[text[s : s + chunk_chars] for s in starts],
                )

    rows = long.mapInArrow(chunks, f"doc_id {sql_id}, digest string, copies long, chunk long, start long, last boolean, text string")
    rows = rows.repartition("doc_id", "digest", "chunk")
    seen = pa.schema([*cut, ("head", pa.list_(pa.int64())), ("tail", pa.list_(pa.int64()))])

    def pretokenise(batches):
        for b in batches:
            heads, tails = [], []
            for chunk, start, last, text in zip(*(b.column(c).to_pylist() for c in ("chunk", "start", "last", "text"))):
                head, tail = boundaries(text, pattern, chunk == 0, last, overlap)
                heads.append([start + x for x in head])
                tails.append([start + x for x in tail])
            yield batch(seen, **{f.name: b.column(f.name) for f in cut}, head=heads, tail=tails)

    rows = rows.mapInArrow(pretokenise, f"doc_id {sql_id}, digest string, copies long, chunk long, start long, last boolean, text string, head array<long>, tail array<long>")
    order = Window.partitionBy("doc_id", "digest", "copies").orderBy("chunk")
    rows = rows.withColumn("sync", F.array_min(F.array_intersect("head", F.lag("tail").over(order))))
    rows = rows.withColumn("sync", F.when(F.col("chunk") == 0, F.lit(0)).otherwise(F.col("sync")))
    rows = rows.withColumn("begin", F.coalesce("sync", "start"))
    rows = rows.withColumn("until", F.coalesce(F.lead("begin").over(order), F.col("start") + F.length("text")))
    rows = rows.withColumn("piece", F.count("sync").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("text", F.expr("substring(text, int(begin - start + 1), int(until - begin))"))
    pieces = rows.groupBy("doc_id", "digest", "copies", "piece").agg(F.expr("listagg(text, '') within group (order by chunk)").alias("text"))
    made = pa.schema([("doc_id", arrow_id), ("digest", pa.string()), ("copies", pa.int64()), ("piece", pa.int64()), ("n", pa.int64()), ("ids", pa.binary()), ("decoded", pa.binary())])

    def encode(batches):
        enc = encoding(ranks_path, pattern)
        for b in batches:
            ids = [encode_piece(t, ranks_path, pattern) for t in b.column("text").to_pylist()]
            yield batch(
                made, **{c: b.column(c) for c in ("doc_id", "digest", "copies", "piece")},
                n=[len(x) for x in ids], ids=[np.array(x, "<u4").tobytes() for x in ids], decoded=[enc.decode_bytes(x) for x in ids],
            )

    pieces = pieces.mapInArrow(encode, f"doc_id {sql_id}, digest string, copies long, piece long, n long, ids binary, decoded binary")
    joined = pieces.groupBy("doc_id", "digest", "copies").agg(
        F.sum("n").alias("n_tokens"),
        F.expr("listagg(ids) within group (order by piece)").alias("ids"),
        F.expr("listagg(decoded) within group (order by piece)").alias("decoded"),
    )
    joined = joined.withColumn("copy", F.explode(F.expr("sequence(1L, copies)"))).select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"),
        *(["ids", "decoded"] if with_ids else []),
    )
    return short.unionByName(joined)


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as P

    from .common import table

    return encode_documents(table(spark, sf_dir, "documents"), P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
