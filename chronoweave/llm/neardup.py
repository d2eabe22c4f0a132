"""Near-duplicate groups by b-bit MinHash.

1. Every document's distinct shingles of five words are hashed and give ``HASHES`` minima. The low
   ``BITS`` bits of each are packed into a signature; ``ROWS`` full minima at a time give a band key.
   Documents with equal shingle sets are one class from here on, so copies are never paired.
2. Buckets of equal band keys with two classes or more give candidates. A pair's similarity is estimated
   from the signatures by counting bits, corrected for low bits that agree by chance, and pairs well
   under the threshold are dropped. What remains is confirmed on the full shingle sets.
3. Links are found in rounds, each of which merges what it confirms before the next one starts. In the
   first, a bucket's centre is the member that meets most others in all its buckets (of near copies, the
   one that was changed least); in two more it is drawn at random. Each class is tested against the most
   similar of its centres from another component. The last round takes, in the buckets that still hold
   several components, the pairs of classes of different components that the estimate lets through; for
   the members of large buckets an exact filter on rare shingles and a longer signature come first. So a
   bucket of thousands of near copies costs a few rows per member.

With 32 bands of 4 minima a pair of similarity 0.75 shares no bucket with a chance of 5e-6. The estimates' bounds
lie 5 standard deviations below 0.75: by the binomial tail ESTIMATE loses such a pair with a chance of 1.4e-6
and LONG_ESTIMATE with one of 2.2e-6. Pairs of higher similarity are lost more rarely by far. With ``exact=True`` nothing is
estimated: every two classes of different components that share a bucket are confirmed, whatever the bucket's size.
Large families of documents that are all just under the threshold of each other cost a candidate for almost
every pair: no filter here tells 0.70 from 0.75 without a look at both.

Classes are named by 64-bit hashes of their sets. Tables that several steps read are written to the
shared folder. Nothing is collected but counts, most of them taken while a table is written. A turn is a few small
plans with a table between them, and ends where a table is empty: the driver's memory goes with the number of exchanges
of a plan, which adaptive execution plans anew after each of them, and not with the rows.

Cases: null and empty texts have no shingles and stay alone; with fewer than five words the whole
sequence is the one shingle; repeated rows and equal ids each give a row; a null doc_id takes part, is
kept only if its component has no other id, and never names a component with one; ids of any type keep it (the
smallest is that of its order); an empty table
gives no rows; other columns are not read by ``components`` and passed through by ``deduplicate``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.storage import materialize_counting
from .common import WORD_SEPARATORS, batch, id_types, materialize, release

SHINGLE = 5
HASHES, ROWS, BITS = 128, 4, 2
PERCENT = 75
ESTIMATE = 0.52
#: Larger buckets give their last candidates by rare shingles instead of pair by pair.
HOT_BUCKET = 32
#: For their members: hashes of the longer signature, its estimate's bound (again 5 standard deviations
#: under 0.75), cells of the count sketch, and how many shingles a row carries to know a pair's first.
LONG_HASHES, LONG_ESTIMATE, CELLS, EARLY = 512, 0.64, 1 << 16, 256
BLOCK = 4_096
_MULTIPLIERS = np.random.default_rng(20_240_601).integers(0, 2**64, HASHES, np.uint64) | np.uint64(1)
_LONG = np.random.default_rng(20_240_608).integers(0, 2**64, LONG_HASHES, np.uint64) | np.uint64(1)
_P = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def shingle_set(text: str | None) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a text's shingles."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    k = min(SHINGLE, len(words))
    total = np.full(len(words) - k + 1, k, np.uint64)
    for j in range(k):
        total = mix(total * _P + h[j : len(words) - k + 1 + j])
    return np.unique(total)


def class_of(shingles: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(shingles.tobytes()) - 2**63


def minima(shingles: np.ndarray, multipliers: np.ndarray = _MULTIPLIERS) -> np.ndarray:
    low = np.full(len(multipliers), 2**64 - 1, np.uint64)
    for at in range(0, len(shingles), BLOCK):
        np.minimum(low, (multipliers[:, None] * shingles[None, at : at + BLOCK]).min(axis=1), out=low)
    return low


def pack(low: np.ndarray) -> np.ndarray:
    """The low bits of the minima, as four signed 64-bit integers."""
    bits = (mix(low) & np.uint64(2**BITS - 1)).reshape(-1, 64 // BITS)
    return np.bitwise_or.reduce(bits << (np.arange(64 // BITS, dtype=np.uint64) * np.uint64(BITS)), axis=1).view(np.int64)


def band_keys(low: np.ndarray) -> np.ndarray:
    rows = low.reshape(-1, ROWS)
    key = np.arange(len(rows), dtype=np.uint64)
    for j in range(ROWS):
        key = mix(key * _P + rows[:, j])
    return key.view(np.int64)


SIGNATURE = [f"s{k}" for k in range(HASHES * BITS // 64)]


LONG_SIGNATURE = [f"l{k}" for k in range(LONG_HASHES * BITS // 64)]


def estimate(a: str, b: str, signature: list[str] = SIGNATURE) -> Column:
    """Similarity from two packed signatures: low bits agree by chance in one of 2**BITS cases."""
    unequal = F.lit(0)
    for s in signature:
        x = F.col(f"{a}.{s}").bitwiseXOR(F.col(f"{b}.{s}"))
        unequal = unequal + F.bit_count(x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(F.lit(0x5555555555555555)))
    chance = 1 / 2**BITS
    return (1 - unequal / (len(signature) * 64 // BITS) - chance) / (1 - chance)


def likely(a: str, b: str, exact: bool) -> Column:
    """The sets' sizes allow a link and, unless exact, the estimate is not well under the threshold."""
    p, q = F.col(f"{a}.n_shingles"), F.col(f"{b}.n_shingles")
    sizes = 100 * F.least(p, q) >= PERCENT * F.greatest(p, q)
    return sizes if exact else sizes & (estimate(a, b) >= ESTIMATE)


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, n_shingles, node, the packed signature and band keys (null without shingles)."""
    arrow_id, sql_id = id_types(docs)
    schema = pa.schema([("doc_id", arrow_id), ("text_hash", pa.int64()), ("n_shingles", pa.int64()), ("node", pa.int64()), *[(s, pa.int64()) for s in SIGNATURE], ("bands", pa.list_(pa.int64()))])

    def sign(batches):
        for b in batches:
            rows = {f.name: [] for f in schema}
            for text in b.column("text"):
                found = shingle_set(text.as_py())
                rows["n_shingles"].append(len(found))
                if not len(found):
                    for c in ("node", *SIGNATURE, "bands"):
                        rows[c].append(None)
                    continue
                low = minima(found)
                rows["node"].append(class_of(found))
                for s, v in zip(SIGNATURE, pack(low)):
                    rows[s].append(int(v))
                rows["bands"].append(band_keys(low))
            rows["doc_id"], rows["text_hash"] = b.column("doc_id"), b.column("text_hash")
            yield batch(schema, **rows)

    ddl = f"doc_id {sql_id}, text_hash long, n_shingles long, node long, " + ", ".join(f"{s} long" for s in SIGNATURE) + ", bands array<long>"
    return docs.select("doc_id", "text", text_hash().alias("text_hash")).mapInArrow(sign, ddl)


def connect(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """(node, label) for the nodes of the edges (a, b): the smallest node of each component.

    Each round takes the smallest label among neighbours and then the label's own label; it ends when
    a round changes nothing."""
    both = materialize(spark, edges.select("a", "b").union(edges.select("b", "a")).distinct(), "edges")
    labels = materialize(spark, both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("low"))
        step = labels.join(near, "node").select("node", "label", F.least("label", "low").alias("low"))
        jump = labels.select(F.col("node").alias("low"), F.col("label").alias("further"))
        step = step.join(jump, "low", "left").select("node", F.coalesce(F.least("further", "low"), "low").alias("next"), "label")
        made, changed = materialize_counting(spark, step, "labels", F.col("next") != F.col("label"))
        release(spark, labels)
        labels = made.select("node", F.col("next").alias("label"))
        labels.written_to = made.written_to
        if not changed:
            release(spark, both)
            return labels


class Links:
    """The state of the search: classes, buckets, sets, pairs that were looked at, components."""

    def __init__(self, spark: SparkSession, docs: DataFrame, exact: bool):
        self.spark = spark
        self.exact = exact
        self.docs = docs
        self.rows = materialize(spark, signatures(docs), "signatures")
        own = self.rows.where("n_shingles > 0")
        one = own.dropDuplicates(["node"])
        bands = one.select("node", F.explode("bands").alias("key"))
        # A table of its own: a join of two plain exchanges is one whose hot keys can be split.
        many = materialize(spark, bands.groupBy("key").agg(F.count("*").alias("members")).where("members > 1"), "keys")
        self.buckets, self.found = materialize_counting(spark, bands.join(many, "key").select("key", "node", "members"), "buckets", F.lit(True))
        active = self.buckets.groupBy("node").agg(F.sum("members").alias("meets"))
        classes = own.groupBy("node", "n_shingles", *SIGNATURE).agg(F.min("doc_id").alias("first_id")).join(active, "node")
        self.classes = materialize(spark, classes, "classes")
        self.sets = self._sets()
        self.tested = None
        self.labels = None
        self.mixed = None

    def _sets(self) -> DataFrame:
        """The full shingle sets of the classes that share a bucket with another."""
        schema = pa.schema([("node", pa.int64()), ("shingles", pa.binary())])

        def shingles(batches):
            for b in batches:
                out = {"node": [], "shingles": []}
                for node, text in zip(b.column("node").to_pylist(), b.column("text")):
                    found = shingle_set(text.as_py())
                    if len(found) and class_of(found) == node:
                        out["node"].append(node)
                        out["shingles"].append(found.tobytes())
                yield batch(schema, **out)

        texts = self.docs.select("doc_id", "text")
        # Texts are dealt out at every size: the wanted ids grow with the input.
        wanted = self.classes.select("node", "first_id").hint("merge")
        texts = texts.join(wanted, F.col("doc_id").eqNullSafe(F.col("first_id"))).select("node", "text")
        sets = texts.mapInArrow(shingles, "node long, shingles binary")
        return materialize(self.spark, sets, "sets")

    def members(self) -> DataFrame:
        """key, node, comp of the buckets that hold several components."""
        if self.labels is None:
            return self.buckets.select("key", "node", F.col("node").alias("comp"))
        if self.mixed is None:
            rows = self.buckets.join(self.labels, "node", "left").select("key", "node", F.coalesce("label", "node").alias("comp"))
            mixed = rows.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("key")
            self.mixed = materialize(self.spark, rows.join(mixed, "key"), "mixed")
        return self.mixed

    def signed(self, rows: DataFrame) -> DataFrame:
        return rows.join(self.classes.select("node", "n_shingles", "meets", *SIGNATURE), "node")

    def with_centres(self, members: DataFrame, turn: int) -> DataFrame:
        """(a, b): each member with the most similar centre of its buckets that is of another component."""
        rank = F.col("meets") if turn == 0 else F.xxhash64("node", F.lit(turn))
        drawn = F.max(F.struct(rank.alias("r"), "node", "comp"))
        ranked = members.join(self.classes.select("node", "meets"), "node") if turn == 0 else members
        centre = ranked.groupBy("key").agg(drawn.alias("c")).select("key", F.col("c.node").alias("centre"), F.col("c.comp").alias("centre_comp"))
        rows = members.join(centre, "key").where("comp <> centre_comp").select("node", "centre").distinct()
        sig = self.classes.select("node", "n_shingles", *SIGNATURE)
        rows = rows.join(sig.alias("x"), "node").join(sig.select(F.col("node").alias("centre"), "n_shingles", *SIGNATURE).alias("y"), "centre")
        rows = rows.where(likely("x", "y", self.exact)).select(F.col("node"), F.col("centre"), estimate("x", "y").alias("e"))
        best = rows.groupBy("node").agg(F.max(F.struct("e", "centre")).alias("c")).select("node", F.col("c.centre").alias("centre"))
        return best.select(F.least("node", "centre").alias("a"), F.greatest("node", "centre").alias("b")).distinct()

    def across(self, members: DataFrame) -> DataFrame:
        """(a, b): pairs of different components that share a bucket and may be linked."""
        size = members.groupBy("key").agg(F.count("*").alias("n"))
        sized = members.join(size, "key")
        rows = self.signed(sized if self.exact else sized.where(F.col("n") <= HOT_BUCKET))
        on = (F.col("x.key") == F.col("y.key")) & (F.col("x.node") < F.col("y.node")) & (F.col("x.comp") != F.col("y.comp"))
        pairs = rows.alias("x").join(rows.alias("y"), on & likely("x", "y", self.exact)).select(F.col("x.node").alias("a"), F.col("y.node").alias("b"))
        if self.exact:
            return pairs.distinct()
        return pairs.union(self.across_hot(sized.where(F.col("n") > HOT_BUCKET).select("node", "comp").distinct())).distinct()

    def across_hot(self, nodes: DataFrame) -> DataFrame:
        """(a, b) among the members of large buckets, by an exact filter instead of their buckets.

        With all shingles in one order, two sets of similarity 0.75 have their first common one so early in
        each that enough can follow. Rare shingles come first in the order, by a sketch of counts of a
        fixed size: what a heavily changed copy shares with nobody fills its beginning, so it meets few
        others or none. A longer signature, made for these members only, sharpens the estimate."""
        weight = nodes.groupBy("comp").agg(F.count("*").alias("size"))
        single = nodes.join(weight, "comp").join(self.sets.dropDuplicates(["node"]), "node").select("node", "comp", "size", "shingles")
        single = materialize(self.spark, single, "members")
        cells = pa.schema([("cell", pa.int64()), ("n", pa.int64())])

        def tally(batches):
            for b in batches:
                counts = np.zeros(CELLS, np.int64)
                for x in b.column("shingles"):
                    counts += np.bincount((np.frombuffer(x.as_buffer(), np.uint64) & np.uint64(CELLS - 1)).astype(np.int64), minlength=CELLS)
                used = np.flatnonzero(counts)
                yield batch(cells, cell=used, n=counts[used])

        # The sketch has CELLS rows at most, whatever the input.
        sketch = single.mapInArrow(tally, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
        counts = np.zeros(CELLS, np.int64)
        counts[sketch["cell"].to_numpy()] = sketch["n"].to_numpy()
        counts = counts.clip(max=2**31 - 1).astype(np.int32)
        schema = pa.schema([("node", pa.int64()), ("comp", pa.int64()), ("size", pa.int64()), ("n_shingles", pa.int64()), ("shingle", pa.int64()), ("nth", pa.int64()),
                            ("early", pa.list_(pa.int64())), *[(c, pa.int64()) for c in LONG_SIGNATURE]])

        def prefixes(batches):
            for b in batches:
                for node, comp, size, x in zip(*(b.column(c).to_pylist() for c in ("node", "comp", "size")), b.column("shingles")):
                    found = np.frombuffer(x.as_buffer(), np.uint64)
                    often = counts[(found & np.uint64(CELLS - 1)).astype(np.int64)]
                    first = np.lexsort((found, often))[: len(found) // 4 + 1]
                    at = np.flatnonzero(often[first] > 1)
                    if not len(at):
                        continue
                    early = found[first].view(np.int64)
                    long = {c: np.full(len(at), v) for c, v in zip(LONG_SIGNATURE, pack(minima(found, _LONG)))}
                    yield batch(schema, node=np.full(len(at), node), comp=np.full(len(at), comp), size=np.full(len(at), size), n_shingles=np.full(len(at), len(found)),
                                shingle=early[at], nth=at + 1, early=[early[: k + 1] if k < EARLY else None for k in at], **long)

        ddl = "node long, comp long, size long, n_shingles long, shingle long, nth long, early array<long>, " + ", ".join(f"{c} long" for c in LONG_SIGNATURE)
        rows = materialize(self.spark, single.mapInArrow(prefixes, ddl), "prefixes")
        rows = rows.withColumn("rank", F.struct("size", "comp"))
        largest = rows.groupBy("shingle").agg(F.max("rank").alias("top"))
        # One side of each pair is of the smaller component.
        left = rows.join(largest, "shingle").where("rank < top")
        x, y = "x", "y"
        total = 3 * (F.col("x.n_shingles") + F.col("y.n_shingles"))
        enough = (7 * (F.col("x.n_shingles") - F.col("x.nth") + 1) >= total) & (7 * (F.col("y.n_shingles") - F.col("y.nth") + 1) >= total)
        # A pair is taken at its first common shingle, where both rows know theirs up to here.
        first = F.col("x.early").isNull() | F.col("y.early").isNull() | (F.size(F.array_intersect("x.early", "y.early")) == 1)
        on = (F.col("x.shingle") == F.col("y.shingle")) & (F.col("x.rank") < F.col("y.rank")) & enough
        pairs = left.alias(x).join(rows.alias(y), on & (estimate(x, y, LONG_SIGNATURE) >= LONG_ESTIMATE) & first)
        return pairs.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b"))

    def confirm(self, pairs: DataFrame) -> None:
        """Test the pairs, which are of different components, on the full sets, keep them as tested, merge the confirmed ones."""
        if self.tested is not None:
            pairs = pairs.join(self.tested, ["a", "b"], "left_anti")
        pairs, wanted = materialize_counting(self.spark, pairs, "pairs", F.lit(True))
        if not wanted:
            release(self.spark, pairs)
            return
        schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("linked", pa.bool_())])

        def test(batches):
            for b in batches:
                linked = []
                for x, y in zip(b.column("x"), b.column("y")):
                    p, q = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                    common = len(np.intersect1d(p, q, assume_unique=True))
                    linked.append(100 * common >= PERCENT * (len(p) + len(q) - common))
                yield batch(schema, a=b.column("a"), b=b.column("b"), linked=linked)

        sets = self.sets
        joined = pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("y")), "b")
        tested = joined.select("a", "b", "x", "y").mapInArrow(test, "a long, b long, linked boolean")
        found, linked = materialize_counting(self.spark, tested, "tested", F.col("linked"))
        release(self.spark, pairs)
        seen = found.select("a", "b")
        self.tested = seen if self.tested is None else self.tested.union(seen)
        if linked:
            self.merge(found.where("linked").select("a", "b"))

    def merge(self, links: DataFrame) -> None:
        """The components after links between classes of different ones."""
        if self.labels is not None:
            for c in ("a", "b"):
                links = links.join(self.labels.select(F.col("node").alias(c), F.col("label").alias(f"l{c}")), c, "left")
            links = links.select(F.coalesce("la", "a").alias("a"), F.coalesce("lb", "b").alias("b")).where("a <> b")
        new = connect(self.spark, links)
        if self.mixed is not None:
            release(self.spark, self.mixed)
            self.mixed = None
        if self.labels is None:
            self.labels = new
            return
        moved = self.labels.join(new.select(F.col("node").alias("label"), F.col("label").alias("to")), "label", "left").select("node", F.coalesce("to", "label").alias("label"))
        added = new.join(self.labels.select("node"), "node", "left_anti")
        self.labels = materialize(self.spark, moved.union(added), "components")

    def find(self) -> DataFrame:
        """doc_id, text_hash, n_shingles, node, comp of every row."""
        if self.found:
            for turn in range(3):
                self.confirm(self.with_centres(self.members(), turn))
            self.confirm(self.across(self.members()))
        rows = self.rows.select("doc_id", "text_hash", "n_shingles", "node")
        if self.labels is None:
            return rows.withColumn("comp", F.col("node"))
        return rows.join(self.labels, "node", "left").select("doc_id", "text_hash", "n_shingles", "node", F.coalesce("label", "node").alias("comp"))


def components(spark: SparkSession, docs: DataFrame, exact: bool = False) -> DataFrame:
    """doc_id, n_shingles, component_id, kept, comp (the component's internal name)."""
    rows = Links(spark, docs, exact).find()
    least = materialize(spark, rows.where("comp is not null").groupBy("comp").agg(F.min("doc_id").alias("least")), "least")
    rows = rows.join(least, "comp", "left").withColumn("component_id", F.when(F.col("comp").isNull(), F.col("doc_id")).otherwise(F.col("least")))
    return rows.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"), "comp", "node", "text_hash")


def deduplicate(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The input's rows and columns, one row of each group; rows without shingles all stay.

    Of equal kept ids in a group, and of repeated rows, one stays: that with the least hash of all its columns."""
    rows = components(spark, docs).where("kept and comp is not null")
    chosen = rows.groupBy("comp").agg(F.min(F.struct("doc_id", "text_hash")).alias("k"))
    chosen = chosen.select(_key(F.col("k.doc_id")).alias("_key"), F.col("k.text_hash").alias("_hash"))
    names = docs.columns
    own = [f"_row_{k}" for k in range(len(names))]
    ours = docs.select(
        *[F.col(f"`{c}`").alias(o) for c, o in zip(names, own)], _key(F.col("doc_id")).alias("_key"),
        text_hash().alias("_hash"), row_hash(docs).alias("_row"), F.coalesce(F.col("text").rlike(f"[^{WORD_SEPARATORS}]"), F.lit(False)).alias("_words"),
    )
    # The join leaves equal keys in one partition, so numbering them needs no further exchange.
    some = ours.where("_words").join(chosen, ["_key", "_hash"]).withColumn("_nth", F.row_number().over(Window.partitionBy("_key", "_hash").orderBy("_row")))
    out = [F.col(o).alias(c) for c, o in zip(names, own)]
    return some.where("_nth = 1").select(*out).union(ours.where("not _words").select(*out))


def _key(doc_id: Column) -> Column:
    return F.coalesce(doc_id.cast("string"), F.lit(""))


def row_hash(docs: DataFrame) -> Column:
    """A hash of all columns; maps, which have no hash, by their JSON."""
    plain = lambda f: F.to_json(F.struct(F.col(f"`{f.name}`"))) if "map<" in f.dataType.simpleString() else F.col(f"`{f.name}`")
    return F.xxhash64(*map(plain, docs.schema))


def text_hash() -> Column:
    return F.xxhash64(F.coalesce("text", F.lit("")))


def op3_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .common import table

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return components(spark, docs).select("doc_id", "n_shingles", "component_id", "kept")


OP3_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + k - 1], ' ') AS g FROM (
    SELECT doc_id, w, least(5, len(w)) AS k, unnest(range(1, len(w) - least(5, len(w)) + 2)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
r AS (SELECT a AS id, b AS other FROM e UNION SELECT r.id, e.b FROM r JOIN e ON r.other = e.a),
m AS (SELECT id, min(other) AS low FROM r GROUP BY 1)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(low, d.doc_id)) AS component_id,
    d.doc_id = least(d.doc_id, coalesce(low, d.doc_id)) AS kept
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN m ON m.id = d.doc_id
"""
