"""Toxicity by compression distance: two zstandard dictionaries, one trained on toxic and one on ordinary text.

Training takes a bounded sample of labelled documents (``PER_CLASS`` of each label, those with the
smallest hashes of their ids, of at most ``SAMPLE_CHARS`` characters each). A toxic document is ordinary text
for the most part, so its toxic text is picked first: the places whose word, or beginning of a word, is many
times likelier in toxic documents than in ordinary ones, each with the words beside it. zstandard's trainer makes
one dictionary of these windows and one of as many windows of ordinary documents. A base, trained on ordinary
documents, goes before both, so that the two explain ordinary words alike and differ by what they were trained on.

Every window of a text is compressed with both; the savings of its windows (per word, share and number of
windows over two thresholds, largest, mean) are calibrated to a score by logistic regression. The savings that the
calibration sees are those of documents that the dictionaries were not trained on: each half of the sample is
measured with dictionaries of the other half.

Only the text is scored; ids and labels choose the sample. Rows held out are never in it.

Cases: null and empty texts and texts without words have windows without savings, and the score of
those; repeated rows each give a row; a null doc_id is held out, and ids of any type keep it; repeated or null labels count as they
stand or not at all; without both labels in the sample every score is the share of label 1 (0 without
labels); an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import math
import random
from collections import Counter
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batch, id_types

PER_CLASS = {1: 2_000, 0: 4_000}
SAMPLE_CHARS = 100_000
#: Words of a window that is scored, and words on either side of a telling word in training.
WINDOW, BESIDE = 12, 1
BASE_BYTES, OWN_BYTES = 30_000, 1_000
#: How many times likelier in toxic documents a telling unit is, in how many of them it stands at least, and
#: the share of that of the commonest.
RATIO, LEAST, SHARE = 8, 2, 0.1
LEVEL, MIN_MATCH, SEGMENT, GRAM = 6, 6, 16, 6
LEAD = 64
FOLDS = 5
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 or 48 <= b <= 57 else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").translate(_TABLE).split()


def windows_of(words: list[bytes]) -> list[bytes]:
    return [b" " + b" ".join(words[i : i + WINDOW]) + b" " for i in range(0, len(words), WINDOW)]


def units(word: bytes) -> list[bytes]:
    """A word with the spaces around it, and its beginnings."""
    padded = b" " + word + b" "
    return [*(padded[:k] for k in range(5, min(len(padded), 12) + 1)), padded]


def toxic_windows(toxic: list[list[bytes]], ordinary: list[list[bytes]]) -> list[bytes]:
    """The windows of toxic documents around the words that tell them from ordinary ones."""
    pos, neg = Counter(), Counter()
    for tally, docs in ((pos, toxic), (neg, ordinary)):
        for words in docs:
            tally.update({u for w in set(words) for u in units(w)})
    n, m = len(toxic), len(ordinary)
    telling = {u: c for u, c in pos.items() if c >= LEAST and (c + 0.5) / (n + 1) > RATIO * (neg[u] + 0.5) / (m + 1)}
    least = SHARE * max(telling.values(), default=0)
    telling = {u for u, c in telling.items() if c >= least}
    known = {w: any(u in telling for u in units(w)) for w in set().union(*toxic)}
    return [beside(words, i) for words in toxic for i, w in enumerate(words) if known[w]]


def beside(words: list[bytes], i: int) -> bytes:
    return b" " + b" ".join(words[max(0, i - BESIDE) : i + BESIDE + 1]) + b" "


@lru_cache(maxsize=4)
def compressor(content: bytes) -> zstandard.ZstdCompressor:
    params = zstandard.ZstdCompressionParameters.from_level(
        LEVEL, dict_size=len(content), min_match=MIN_MATCH, write_content_size=False, write_checksum=False, write_dict_id=False, format=zstandard.FORMAT_ZSTD1_MAGICLESS)
    return zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT), compression_params=params)


@dataclass(frozen=True)
class Model:
    ordinary: bytes
    toxic: bytes
    weights: tuple[float, ...]

    def features(self, words: list[bytes]) -> tuple[float, ...]:
        windows = windows_of(words)
        if not windows or not self.toxic:
            return (0.0,) * FEATURES
        plain, other = compressor(self.ordinary).compress, compressor(self.toxic).compress
        # A block that would hardly shrink is stored as it is; with a lead that both dictionaries hold,
        # every block shrinks, and small savings show.
        lead = self.ordinary[:LEAD]
        saved = np.array([len(plain(lead + w)) - len(other(lead + w)) for w in windows])
        some, many = int((saved >= 3).sum()), int((saved >= 5).sum())
        return (100 * np.maximum(saved - 1, 0).sum() / (len(words) + 10), some / (len(windows) + 1), math.log1p(some), math.log1p(many),
                float(np.clip(saved.max(), -6, 8)), float(saved.mean()))

    def score(self, text: str | None) -> float:
        z = self.weights[0] + sum(w * f for w, f in zip(self.weights[1:], self.features(words_of(text))))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


FEATURES = 6
#: Ends the tables at the head of a trained dictionary: the first three match offsets, as zstandard sets them.
_OFFSETS = b"\x01\0\0\0\x04\0\0\0\x08\0\0\0"


def trained_content(windows: list[bytes], size: int, **settings) -> bytes:
    """The content of the dictionary that zstandard trains on the windows, without its tables."""
    try:
        made = zstandard.train_dictionary(size + 2_000, windows, **settings).as_bytes()
    except zstandard.ZstdError:  # too few samples to train on
        made = b"".join(windows)
    return made[made.find(_OFFSETS) + len(_OFFSETS) if _OFFSETS in made else 0 :][-size:]


def dictionaries(toxic: list[list[bytes]], ordinary: list[list[bytes]], base: bytes) -> Model:
    """The two dictionaries, without weights."""
    bad = toxic_windows(toxic, ordinary)
    if not bad:
        return Model(b"", b"", ())
    good = [beside(d, i) for d in ordinary for i in range(BESIDE, len(d), 2 * BESIDE + 1)]
    good = random.Random(0).sample(good, min(len(good), len(bad)))
    own = [trained_content(w, OWN_BYTES, k=SEGMENT, d=GRAM, level=LEVEL) for w in (good, bad)]
    # The compressor does not index a dictionary's last bytes.
    return Model(*(base + x + bytes(32) for x in own), ())


def train(sample: list[tuple[str | None, int]], odds: float | None = None) -> Model:
    """A model from (text, label) pairs; odds of label 1 to 0 among all labels."""
    words = [(words_of(t), y) for t, y in sample]
    toxic, ordinary = [w for w, y in words if y], [w for w, y in words if not y]
    if not toxic or not ordinary:
        share = len(toxic) / len(words) if words else 0.0
        return Model(b"", b"", (math.log(max(share, 1e-12) / max(1 - share, 1e-12)), *[0.0] * FEATURES))
    base = trained_content([w for d in ordinary for w in windows_of(d)], BASE_BYTES)
    rows, labels = [], []
    for k in (0, 1):
        half = dictionaries(toxic[k::2], ordinary[k::2], base)
        for docs, label in ((toxic[1 - k :: 2], 1.0), (ordinary[1 - k :: 2], 0.0)):
            rows += [half.features(w) for w in docs]
            labels += [label] * len(docs)
    x, y = np.array(rows), np.array(labels)
    middle, spread = x.mean(0), x.std(0) + 1e-9
    x = np.c_[np.ones(len(x)), (x - middle) / spread]
    odds = odds or len(toxic) / len(ordinary)
    # Between even odds and the labels' own: catching toxic text counts for more than its rarity.
    weight = np.where(y == 1, math.sqrt(odds) / len(toxic), 1 / len(ordinary))
    weight *= len(y) / weight.sum()
    beta = np.zeros(x.shape[1])
    ridge = 0.01 * np.eye(len(beta))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + ridge, x.T @ (weight * (y - p)) - ridge @ beta)
        beta += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    slopes = beta[1:] / spread
    model = dictionaries(toxic, ordinary, base)
    return Model(model.ordinary, model.toxic, (float(beta[0] - slopes @ middle), *map(float, slopes)))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(True))


def training_sample(docs: DataFrame, labels: DataFrame) -> tuple[list[tuple[str | None, int]], float | None]:
    """The bounded sample, from labels outside the held-out fold, and the odds of label 1 there."""
    usable = labels.where("toxic in (0, 1) and doc_id is not null").where(~held_out(F.col("doc_id"))).select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    counts = {r["toxic"]: r["n"] for r in usable.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    ids = []
    for label, most in PER_CLASS.items():
        n = counts.get(label, 0)
        if not n:
            continue
        rows = usable.where(F.col("toxic") == label).withColumn("h", F.xxhash64("doc_id"))
        if n > 4 * most:  # hashes are even, so a share of their range has about that share of the rows
            rows = rows.where(F.col("h") < int(-(2**63) + 2**64 * min(1.0, 3 * most / n)))
        ids += rows.orderBy("h", "doc_id").limit(most).select("doc_id", "toxic").collect()
    if not ids:
        return [], None
    spark = docs.sparkSession
    wanted = spark.createDataFrame(sorted({(r["doc_id"], r["toxic"]) for r in ids}), usable.schema)
    texts = docs.select("doc_id", "text").where(F.coalesce(F.length("text"), F.lit(0)) <= SAMPLE_CHARS)
    # The sample's ids are bounded by PER_CLASS, so they may be broadcast.
    rows = texts.join(F.broadcast(wanted), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).collect()
    odds = counts[1] / counts[0] if counts.get(1) and counts.get(0) else None
    return [(r["text"], r["toxic"]) for r in sorted(rows, key=lambda r: (r["doc_id"], r["toxic"]))], odds


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    arrow_id, sql_id = id_types(docs)
    schema = pa.schema([("doc_id", arrow_id), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32())])

    def score(batches):
        for b in batches:
            scores = [model.score(t.as_py()) for t in b.column("text")]
            yield batch(schema, doc_id=b.column("doc_id"), held_out=b.column("held_out"), score=scores, predicted=[int(s >= 0.5) for s in scores])

    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    return rows.mapInArrow(score, f"doc_id {sql_id}, held_out boolean, score double, predicted int")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .common import table

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    sample, odds = training_sample(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic"))
    return score_documents(docs, train(sample, odds))
