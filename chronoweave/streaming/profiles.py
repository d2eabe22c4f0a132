"""Keeping exact profiles up to date, batch by batch.

State is the newest edge per pair and, per (id, hop, nbr), the best time of a path of that many edges,
dominated entries included: so merging is a maximum, and the answer after a number of batches is that of
one batch with all their edges. An update joins only what a batch improved: new edges with the level
below, and all edges with the rows of the level below that changed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.edges import endpoints
from ..operators.profile import latest
from ..sources.storage import delete_folder, folders, materialize, release, write_table

PAIR = "id long, nbr long, ts long"
ROW = "id long, hop int, nbr long, ts long"


def empty_state(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    return spark.createDataFrame([], PAIR), spark.createDataFrame([], ROW)


def _improved(new: DataFrame, old: DataFrame, keys: list[str]) -> DataFrame:
    before = old.select(*keys, F.col("ts").alias("_old"))
    return new.join(before, keys, "left").where("_old is null or _old < ts").drop("_old")


def _merged(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    return old.unionByName(new).groupBy(*keys).agg(F.max("ts").alias("ts"))


def update(pairs: DataFrame, profile: DataFrame, batch: DataFrame, hops: int) -> tuple[DataFrame, DataFrame]:
    """The state after a batch of (src, dst, ts) edges."""
    spark = batch.sparkSession
    fresh = materialize(spark, _improved(latest(batch), pairs, ["id", "nbr"]), "fresh")
    pairs = materialize(spark, _merged(pairs, fresh, ["id", "nbr"]).select("id", "nbr", "ts"), "pairs")
    change = fresh
    spent = [fresh]
    levels = [_merged(profile.where("hop = 1").drop("hop"), fresh, ["id", "nbr"])]
    edge = lambda f: f.select("id", F.col("nbr").alias("via"), F.col("ts").alias("edge_ts"))
    below = lambda f: f.select(F.col("id").alias("via"), "nbr", "ts")
    for hop in range(2, hops + 1):
        step = edge(fresh).join(below(levels[-1]), "via").unionByName(edge(pairs).join(below(change), "via"))
        step = step.where("nbr <> id").groupBy("id", "nbr").agg(F.max(F.least("ts", "edge_ts")).alias("ts"))
        old = profile.where(F.col("hop") == hop).drop("hop")
        change = materialize(spark, _improved(step, old, ["id", "nbr"]), "change")
        levels.append(materialize(spark, _merged(old, change, ["id", "nbr"]), "level"))
        spent += [change, levels[-1]]
    out = None
    for hop, level in enumerate(levels, 1):
        rows = level.select("id", F.lit(hop).alias("hop"), "nbr", "ts")
        out = rows if out is None else out.unionByName(rows)
    profile = materialize(spark, out, "profile")
    for table in spent:
        release(spark, table)
    return pairs, profile


def undominated(profile: DataFrame) -> DataFrame:
    """Without entries that a lower hop has at least as new."""
    low = profile.select("id", "nbr", F.col("hop").alias("low"), F.col("ts").alias("low_ts"))
    return profile.join(low, ["id", "nbr"]).groupBy("id", "hop", "nbr", "ts").agg(F.count_if((F.col("low") < F.col("hop")) & (F.col("low_ts") >= F.col("ts"))).alias("n")).where("n = 0").drop("n")


class ProfileStream:
    """Maintains a profile from a stream of edges; `profile` holds the state after the last batch.

    Started with a checkpoint folder, the state after each batch is written under it by the batch's number. A
    restarted stream goes on from there; a batch that is run again, because the stream ended before it was
    committed, starts from the state before it. The states of the last two batches are kept."""

    def __init__(self, spark: SparkSession, hops: int = 3, folder: str | None = None):
        self.spark, self.hops, self.folder, self.number = spark, hops, folder, -1
        self.pairs, self.profile = empty_state(spark)
        if folder:
            self._load(2**62)

    def _kept(self) -> list[int]:
        """The numbers of the batches whose state is complete."""
        return sorted(int(n) for n in folders(self.spark, self.folder) if n.isdigit() and "_SUCCESS" in folders(self.spark, f"{self.folder}/{n}/profile"))

    def _load(self, before: int) -> None:
        """The state after the last batch before a number."""
        found = [n for n in self._kept() if n < before]
        self.number = found[-1] if found else -1
        if found:
            self.pairs, self.profile = (self.spark.read.schema(s).parquet(f"{self.folder}/{self.number}/{t}") for t, s in (("pairs", PAIR), ("profile", ROW)))
        else:
            self.pairs, self.profile = empty_state(self.spark)

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        if self.folder and self.number >= batch_id:
            self._load(batch_id)
        pairs, profile = update(self.pairs, self.profile, batch, self.hops)
        if self.folder:
            # The profile is written last: with it the state is complete.
            made = [write_table(self.spark, t, f"{self.folder}/{batch_id}/{n}") for n, t in (("pairs", pairs), ("profile", profile))]
            for t in (pairs, profile):
                release(self.spark, t)
            pairs, profile = made
            for old in self._kept():
                if old < batch_id - 1:
                    delete_folder(self.spark, f"{self.folder}/{old}")
        self.pairs, self.profile, self.number = pairs, profile, batch_id

    def start(self, edges: DataFrame, checkpoint: str, **trigger) -> StreamingQuery:
        if not self.folder:
            self.folder = f"{checkpoint.rstrip('/')}/profile-state"
            self._load(2**62)
        return edges.writeStream.foreachBatch(self).option("checkpointLocation", checkpoint).trigger(**trigger or {"availableNow": True}).start()


def activity_stream(edges: DataFrame) -> DataFrame:
    """id, activity so far, for an update or complete sink."""
    return endpoints(edges.select("src", "dst")).groupBy("id").agg(F.count("*").alias("activity"))
