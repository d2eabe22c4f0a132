"""Temporal neighbourhood profiles: who is within k hops by a path whose edges are all newer than a horizon.

Exact profiles are rows (id, hop, nbr, ts): ts is the greatest, over paths of that many edges, of the oldest
edge on the path. An entry is left out where a lower hop has one at least as new. Approximate profiles are
sliding sketches as rows (id, hop, bucket, rank, ts): the newest time at which a bucket saw a rank. Inserting
and merging are the same group-by maximum, in any order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import bucket_of, rank_of
from ..functions.sketch import cardinality
from ..sources.storage import materialize
from . import walks
from .edges import both_ways


def latest(edges: DataFrame) -> DataFrame:
    """id, nbr, ts: the newest edge between two vertices, either way; no self loops."""
    pairs = both_ways(edges.where("src <> dst").select("src", "dst", "ts"))
    return pairs.groupBy(F.col("src").alias("id"), F.col("dst").alias("nbr")).agg(F.max("ts").alias("ts"))


def exact(edges: DataFrame, hops: int = 3) -> DataFrame:
    """id, hop, nbr, ts without dominated entries; by walks from a packed graph where the edges can be packed."""
    packed = walks.pack(edges)
    return exact_by_tables(edges, hops) if packed is None else walks.profiles(packed, hops)


def exact_by_tables(edges: DataFrame, hops: int = 3) -> DataFrame:
    """As exact, with a table for each hop."""
    spark = edges.sparkSession
    near = materialize(spark, latest(edges), "pairs")
    level = near.select("id", F.lit(1).alias("hop"), "nbr", "ts")
    found = level
    for hop in range(2, hops + 1):
        # The neighbour's entries, no newer than the edge to it. Grouping comes before the comparison with
        # lower hops, so that both sides of that join are one row per (id, nbr).
        step = near.select("id", F.col("nbr").alias("via"), F.col("ts").alias("edge_ts")).join(level.select(F.col("id").alias("via"), "nbr", "ts"), "via")
        step = step.where("nbr <> id").groupBy("id", "nbr").agg(F.max(F.least("ts", "edge_ts")).alias("ts"))
        lower = found.groupBy("id", "nbr").agg(F.max("ts").alias("best"))
        step = step.join(lower, ["id", "nbr"], "left").where("best is null or best < ts")
        level = materialize(spark, step.select("id", F.lit(hop).alias("hop"), "nbr", "ts"), "hop")
        found = found.unionByName(level)
    return found


def sizes(profile: DataFrame, horizon: int, inclusive: bool = False) -> DataFrame:
    """id, size: distinct neighbours newer than the horizon (at it too, if inclusive)."""
    newer = F.col("ts") >= horizon if inclusive else F.col("ts") > horizon
    return profile.where(newer).select("id", "nbr").distinct().groupBy("id").agg(F.count("*").alias("size"))


def update_counts(profile: DataFrame) -> DataFrame:
    """id, updates: the rounds of one batch in which a vertex's profile changed, one a hop with new entries."""
    return profile.select("id", "hop").distinct().groupBy("id").agg(F.count("*").alias("updates"))


def summaries(edges: DataFrame, hops: int = 3, horizon: int = 0, inclusive: bool = False) -> DataFrame:
    """id, size, updates of every vertex of the exact profile, without the profile's rows; size 0 where nothing is
    newer than the horizon."""
    return _summaries(edges, hops, horizon, inclusive, walks.pack(edges))


def window_sizes(edges: DataFrame, hops: int = 3, horizon: int = 0, inclusive: bool = False) -> DataFrame:
    """The sizes of the exact profile: a neighbour is newer than the horizon if all edges of a walk to it are, so
    only those edges are packed."""
    packed = walks.pack(edges, None, horizon if inclusive else horizon + 1)
    return _summaries(edges, hops, horizon, inclusive, packed).where("size > 0").select("id", "size")


def _summaries(edges: DataFrame, hops: int, horizon: int, inclusive: bool, packed: walks.Packed | None) -> DataFrame:
    if packed is None:
        profile = exact_by_tables(edges, hops)
        rows = update_counts(profile).join(sizes(profile, horizon, inclusive), "id", "left")
        rows = rows.select("id", F.coalesce("size", F.lit(0)).alias("size"), "updates")
    else:
        rows = walks.summaries(packed, hops, horizon, inclusive)
    return materialize(edges.sparkSession, rows, "summaries")


# Sliding sketches.

def elements(rows: DataFrame, h: Column, buckets: int, top_bit: int = 63) -> DataFrame:
    """Adds bucket and rank of a hash to rows."""
    return rows.withColumns({"bucket": bucket_of(h, buckets), "rank": rank_of(h, buckets, top_bit)})


def merge_sketches(rows: DataFrame, *keys: str) -> DataFrame:
    """keys, bucket, rank, ts: one row for each rank that a bucket saw."""
    return rows.groupBy(*keys, "bucket", "rank").agg(F.max("ts").alias("ts"))


def prune(sketch: DataFrame, *keys: str) -> DataFrame:
    """Without entries that a larger rank with a time at least as new makes useless: the frontier."""
    higher = Window.partitionBy(*keys, "bucket").orderBy(F.desc("rank")).rowsBetween(Window.unboundedPreceding, -1)
    rows = sketch.withColumn("newest", F.max("ts").over(higher))
    return rows.where("newest is null or ts > newest").drop("newest")


def registers(sketch: DataFrame, horizon: int | None, *keys: str) -> DataFrame:
    """keys, bucket, register: the largest rank at or after the horizon."""
    rows = sketch if horizon is None else sketch.where(F.col("ts") >= horizon)
    return rows.groupBy(*keys, "bucket").agg(F.max("rank").alias("register"))


def estimate(sketch: DataFrame, horizon: int | None, buckets: int, *keys: str) -> DataFrame:
    """keys, estimate: about how many distinct elements are at or after the horizon."""
    rows = registers(sketch, horizon, *keys).groupBy(*keys).agg(F.sum(F.pow(F.lit(2.0), -F.col("register").cast("double"))).alias("power"), F.count("*").alias("filled"))
    return rows.select(*keys, cardinality(F.col("power"), F.col("filled"), buckets).alias("estimate"))


def approximate(edges: DataFrame, hops: int = 3, buckets: int = 256, h: Column | None = None, top_bit: int = 63) -> DataFrame:
    """id, hop, bucket, rank, ts. h: the hash of column nbr; 64 bits by default. Bucket and rank travel,
    not ids, so a level has at most buckets * 64 rows for each vertex."""
    h = F.xxhash64("nbr") if h is None else h
    packed = walks.pack(edges, bucket_of(h, buckets) * (1 << walks.RANK_BITS) + rank_of(h, buckets, top_bit))
    return approximate_by_tables(edges, hops, buckets, h, top_bit) if packed is None else walks.sketches(packed, hops, buckets)


def approximate_by_tables(edges: DataFrame, hops: int, buckets: int, h: Column, top_bit: int = 63) -> DataFrame:
    """As approximate, with a table for each hop."""
    spark = edges.sparkSession
    near = materialize(spark, latest(edges), "pairs")
    level = merge_sketches(elements(near, h, buckets, top_bit).withColumn("hop", F.lit(1)), "id", "hop")
    found = level = materialize(spark, prune(level, "id", "hop"), "sketch")
    for hop in range(2, hops + 1):
        step = near.select("id", F.col("nbr").alias("via"), F.col("ts").alias("edge_ts"))
        step = step.join(level.select(F.col("id").alias("via"), "bucket", "rank", "ts"), "via")
        step = step.select("id", F.lit(hop).alias("hop"), "bucket", "rank", F.least("ts", "edge_ts").alias("ts"))
        level = materialize(spark, prune(merge_sketches(step, "id", "hop"), "id", "hop"), "sketch")
        found = found.unionByName(level)
    return found
